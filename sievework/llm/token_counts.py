"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once, as a whole. A byte-level vocabulary gives each
token's length in bytes, running sums give its span, and spans are joined to
sections by an interval join (both are sorted, so it is a binary search). The
rule for tokens that cross a boundary: a token belongs to the section that holds
its first byte; tokens before, between or after sections go to section -1.

Defined results: a null or empty text has one empty section with no tokens; null
ids keep their rows; repeated rows each give rows; a very long text is encoded
whole; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import encoder, id_type, tokenizer_file

SCHEMA = "id long, none boolean, section int, start long, end long, n_tokens long, n_crossing long"


def lines(text: str) -> list[tuple[int, int]]:
    """Sections (start, end) in code points: lines, each with its line feed."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    cuts = [0, *ends.tolist(), *([len(text)] if not len(ends) or ends[-1] < len(text) else [])]
    return list(zip(cuts, cuts[1:]))


def token_bytes(path: str) -> np.ndarray:
    """Bytes of each id's token; in the byte-level alphabet a byte is a character."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    out = np.zeros(tok.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        out[i] = len(token)
    for i, t in tok.get_added_tokens_decoder().items():
        out[i] = len(t.content.encode())
    return out


def attribute(text: str, ids: np.ndarray, lengths: np.ndarray, sections: list[tuple[int, int]]) -> list[tuple]:
    """(section, start, end, n_tokens, n_crossing) for each section in order, and
    for -1 if a token is outside. Sections do not overlap and are in order."""
    size = lengths[ids]
    start = np.cumsum(size) - size
    bounds = np.array(sections, np.int64).reshape(-1, 2)
    if text.isascii():
        b = bounds
    else:  # code points to bytes
        wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        b = np.concatenate([[0], np.cumsum(1 + (wide > 0x7F).astype(np.int64) + (wide > 0x7FF) + (wide > 0xFFFF))])[bounds]
    at = np.searchsorted(b[:, 0], start, "right") - 1
    # An empty section shares its start with the next one, which the search returns.
    inside = (at >= 0) & (start < b[np.maximum(at, 0), 1]) if len(b) else np.zeros(len(start), bool)
    n = np.bincount(at[inside], minlength=len(b))
    crossing = np.bincount(at[inside & (start + size > b[np.maximum(at, 0), 1])], minlength=len(b)) if len(b) else n
    out = [(i, *s, int(n[i]), int(crossing[i])) for i, s in enumerate(sections)]
    outside = int(len(start) - inside.sum())
    return out + ([(-1, None, None, outside, 0)] if outside else [])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[str], list[tuple[int, int]]] = lines, path: str | None = None) -> DataFrame:
    """A row per section of each document, by a byte-level tokenizer."""
    path = path or tokenizer_file()
    dtype = id_type(path)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, lengths = encoder(path, dtype), token_bytes(path)
        for f in frames:
            rows, ids, none = [], [], []
            for d, null, t in zip(f["id"], f["none"], f["text"]):
                t = t if isinstance(t, str) else ""
                found = attribute(t, np.frombuffer(encode(t), dtype), lengths, (sections(t) if t else []) or [(0, 0)])
                rows += found
                ids += [d] * len(found)
                none += [null] * len(found)
            out = pd.DataFrame(rows, columns=["section", "start", "end", "n_tokens", "n_crossing"])
            out["id"], out["none"] = ids, none
            yield out[["id", "none", "section", "start", "end", "n_tokens", "n_crossing"]]

    own = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(F.coalesce(own, F.lit(0).cast("long")).alias("id"), own.isNull().alias("none"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInPandas(count, SCHEMA).withColumn("id", F.when(~F.col("none"), F.col("id"))).drop("none")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of all documents."""
    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumnRenamed("id", "doc_id")
