"""Answers of language models and written settings, read leniently."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# The keys of an answer's entry.
ENTRY = ("related_query", "unrelated_query")


def json_value(text: str):
    """The first JSON list that decodes anywhere in a text, else the first object; of a
    text with fences, within the first fenced part that begins with either. An error
    if there is none."""
    fenced = (re.sub(r"^json\s*", "", part.strip()) for part in text.split("```")) if "```" in text else ()
    text = next((part for part in fenced if part[:1] in ("[", "{") and part), text)
    decode = json.JSONDecoder().raw_decode
    for opener in "[{":
        for m in re.finditer(re.escape(opener), text):
            try:
                return decode(text, m.start())[0]
            except json.JSONDecodeError:
                continue
    raise ValueError("no JSON in the answer")


def query_entries(text: str | None, expected: int) -> list[dict] | None:
    """The ``expected`` entries of an answer, normalised; None if the answer is null,
    has no JSON, another number of entries, or one that lacks a text."""
    try:
        found = json_value(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    found = [found] if isinstance(found, dict) else found
    if not isinstance(found, list) or len(found) != expected or not all(isinstance(e, dict) for e in found):
        return None
    out = [{k: str(e.get(k) or "").strip().lower() for k in ENTRY} for e in found]
    return out if all(all(e.values()) for e in out) else None


def parsed_answer(text: Column, expected: int = 1) -> Column:
    """:func:`query_entries` of a column: an array of (related_query, unrelated_query)."""

    @pandas_udf("array<struct<related_query:string,unrelated_query:string>>")
    def read(answers: pd.Series) -> pd.Series:
        return answers.map(lambda a: query_entries(a if isinstance(a, str) else None, expected))

    return read(text)


def source_spec(spec: str | None, defaults: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """(dataset, config, weight) of ``dataset[:config[:weight]],...``; of two parts the
    second is a weight if it is a number, a bad weight is 1, and an empty text, ``mix``
    or ``default`` gives the defaults."""

    def number(x: str) -> float | None:
        try:
            return float(x)
        except ValueError:
            return None

    out = []
    for part in (spec or "").split(","):
        name, *rest = (bit.strip() for bit in part.split(":"))
        if not part.strip() or (spec or "").strip().lower() in ("mix", "default"):
            continue
        if len(rest) > 1:
            weight = number(rest[1])
            out.append((name, rest[0], 1.0 if weight is None else weight))
        elif rest and number(rest[0]) is None:
            out.append((name, rest[0], 1.0))
        else:
            out.append((name, "pair", number(rest[0]) if rest else 1.0))
    return out or list(defaults)
