"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so that a question with
other values keeps its template: '5km' is a number and a unit, a run of names is
one placeholder, and a name is a capitalised word that is not a common one. A text
that also has common words as names ('then Will went') gets a second template in
which these are names wherever they are capitalised. A window with slots and under
``LITERAL`` other words has no template to speak of and matches by its values
too. Hashes of ``WINDOW`` template words of documents
and items are joined. Matches of one text and item are read as occurrences: a
diagonal (place in the text less place in the item) with the matches on it or
near it, an item window once; last, all matches together. An item is a leak if one
occurrence has at least ``COVERAGE`` of its windows and consistent slots: over the
occurrence a value of the item meets one value of the document, and the reverse,
each in at least ``CONSISTENT`` of the slots.

Items shorter than a window are matched whole, those of under ``SHORT`` words and no
slot against whole documents only. Defined results: null and wordless texts match
nothing; null ids of documents never match in :func:`leaks` (they carry no id to
report), while :func:`clean` goes by texts alone; repeated rows with one id count
once, other texts of an id by themselves; ties between occurrences go to the one
that comes first; very long texts are scanned whole, a text in one call; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from .shared import forget, fresh, join_salted, table

WINDOW = 8
COVERAGE = 0.5
CONSISTENT = 0.8
#: Literal words that make a window's template.
LITERAL = 2
#: Items of fewer words and no slot ("yes") are no leak but as a whole document.
SHORT = 4

# Units.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches feet foot mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "mph kph kmh percent % dollars dollar cents cent euros euro usd eur gbp degrees degree c f k w kw v a hz khz mhz ghz".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?$")
JOINED = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)-?([^\W\d_]+)$")
# Words that are no names where they begin a sentence; and titles, whose dot ends none.
COMMON = frozenset(
    "a about above across after again against all almost alone along already also although always am among an and another any anyone anything are "
    "around as ask at away back be because been before began begin behind being below beside between both bring but buy by call came can cannot choose "
    "come compare compute consider could count create decide define describe determine did do does done down draw during each either else enough even "
    "ever every everyone everything evaluate example explain few finally find first following for found from get give given go got had half has have he "
    "her here hers herself hi him himself his how however i if imagine in indeed inside instead into is it its itself just keep kept know last later "
    "least let like list long look made make many mark may maybe me meanwhile might more most much must my name near neither never next no none nor not "
    "nothing now of off often ok on once one only onto or other others our out outside over own perhaps please prove put question answer quite rather "
    "read really round said same say second see select several shall she should show simplify since so solve some someone something sometimes soon state "
    "still such suppose take than thank that the their them then there therefore these they thing think this those though three through thus to today "
    "together tomorrow too toward two under unless until up upon us use using very was we well went were what whatever when where whether which while "
    "who whom whose why will with within without would write yes yesterday yet you your hope grace rose art bill jack pat sue drew dawn faith summer "
    "el la los las un una de del en que se no es por para con como al lo le les il elle on nous vous ils dans et est pour sur au aux des du ce cette "
    "qui der die das ein eine und ist in zu den dem mit von auf er sie es wir ihr ich nicht im auch wie".split()
)
TITLES = frozenset(("mr.", "mrs.", "ms.", "dr.", "st.", "prof."))
PRIME = 0x9E3779B97F4A7C15
# A word's code: 58 bits of hash, then whether it is capitalised, ends a sentence,
# is a number or unit, ends a run of names, is common, is a number with its unit.
CAPITAL, END, SLOT, STOP, USUAL, PAIR = 1, 2, 4, 8, 16, 32
FLAGS = 63


MARKS = ".,;:!?\"'()[]{}*#$&%|«»“”…"


UPPER, LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"


def _kind(text: str) -> tuple[str, int]:
    """What a word's hash is of, and its flags."""
    bare = text.strip(MARKS) or text
    low, last = bare.lower(), text.rstrip("\"')*#$&%")[-1:]
    flags = (CAPITAL if bare[:1].isupper() and bare[1:].islower() else 0) | (USUAL if low in COMMON else 0)
    if text.lower() not in TITLES:
        flags |= (END if last in (".", "!", "?", ":", "") else 0) | (STOP if last in (".", "!", "?", ":", "", ",", ";", ")") else 0)
    joined = _joined(low)
    if joined or NUMBER.match(bare):
        return "<number>", flags | SLOT | (PAIR if joined else 0)
    return ("<unit>", flags | SLOT) if low in UNITS else (low, flags)


def _hash(kinds: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(kinds, hash_key="template windows", categorize=False) & np.uint64(~FLAGS & (1 << 64) - 1)


def _codes(words: pa.Array) -> np.ndarray:
    """Codes of different words: by columns for plain ones (lower case or Latin
    letters, marks at the end only), else one by one."""
    isin = lambda x, values: pc.is_in(x, value_set=pa.array(sorted(values), words.type)).to_numpy(zero_copy_only=False)
    bare = pc.utf8_rtrim(words, ".,;:!?")
    plain = pc.and_(pc.utf8_is_alpha(bare), pc.or_(pc.utf8_is_lower(bare), pc.match_substring_regex(bare, f"^[{UPPER}{LOWER}]+$"))).to_numpy(zero_copy_only=False)
    low = pc.utf8_lower(bare)
    marked = pc.not_equal(pc.binary_length(bare), pc.binary_length(words)).to_numpy(zero_copy_only=False) & ~isin(pc.utf8_lower(words), TITLES)
    last, unit = pc.utf8_slice_codeunits(words, -1), isin(low, UNITS)
    flags = np.where(pc.match_substring_regex(bare, f"^[{UPPER}][{LOWER}]+$").to_numpy(zero_copy_only=False), CAPITAL, 0) | np.where(isin(low, COMMON), USUAL, 0)
    flags |= np.where(marked, STOP, 0) | np.where(marked & isin(last, ".!?:"), END, 0) | np.where(unit, SLOT, 0)
    kinds = low.to_numpy(zero_copy_only=False).astype(object)
    kinds[unit] = "<unit>"
    for i in np.flatnonzero(~plain).tolist():
        kinds[i], flags[i] = _kind(words[i].as_py())
    return _hash(kinds) | flags.astype(np.uint64)


def _joined(low: str) -> tuple[str, str] | None:
    """A number and the unit that is written to it, in lower case."""
    m = JOINED.match(low)
    return (m[1], m[2]) if m and m[2] in UNITS else None


class Template:
    """One form of the templates of several texts, end to end: ``h`` hashes, ``slot``,
    ``first`` word of each and the ``end`` of its words, ``second`` of a joined pair,
    ``doc`` the text's number."""

    def __init__(self, h, slot, first, end, second, doc):
        self.h, self.slot, self.first, self.end, self.second, self.doc = h, slot, first, end, second, doc
        self.lengths = np.bincount(doc, minlength=int(doc.max()) + 1 if len(doc) else 0)
        self.starts = np.cumsum(self.lengths) - self.lengths


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null: none), and how many each text has."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)  # before leading and after trailing white space
    if empty.any():
        sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        words = words.filter(pa.array(~empty))
    return words, sizes


def templates(words: pa.Array, sizes: np.ndarray) -> Iterator[Template]:
    """The templates of texts of ``sizes`` words, in one or two forms; the second has
    only texts with common words that are names."""
    coded = words.dictionary_encode()
    c = _codes(coded.dictionary)[coded.indices.to_numpy()]
    at, doc = np.arange(len(c)), np.repeat(np.arange(len(sizes)), sizes)
    starts = np.zeros(len(c), bool)
    starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    begins = starts | np.concatenate([[True], (c[:-1] & np.uint64(END)) > 0])[: len(c)]
    second = np.zeros(len(c), bool)
    if (c & np.uint64(PAIR)).any():
        at = np.repeat(at, np.where(c & np.uint64(PAIR), 2, 1))
        second = np.concatenate([[False], at[1:] == at[:-1]])
        c, doc, begins, starts = c[at], doc[at], begins[at] & ~second, starts[at] & ~second
    unit = _hash(np.array(["<unit>"], object))[0]
    h = np.where(second, unit, c & np.uint64(~FLAGS & (1 << 64) - 1))
    slot, usual, stop = ((c & np.uint64(x)) > 0 for x in (SLOT, USUAL, STOP))
    capital = ((c & np.uint64(CAPITAL)) > 0) & ~slot

    def form(name: np.ndarray, of: np.ndarray | slice) -> Template:
        n, s = name[of], starts[of]
        first = np.flatnonzero(np.concatenate([[True], ~(n[1:] & n[:-1] & ~stop[of][:-1]) | s[1:]])[: len(n)])
        word, text = at[of][first], doc[of][first]
        end = np.cumsum(sizes)[text]
        end[:-1] = np.where(text[1:] == text[:-1], word[1:], end[:-1])
        return Template(np.where(n, np.uint64(NAME), h[of])[first], (n | slot[of])[first], word, end, second[of][first], text)

    plain = capital & ~usual
    yield form(plain, slice(None))
    seen = capital & usual & ~begins
    if seen.any():
        own = h ^ (doc.astype(np.uint64) * np.uint64(PRIME))  # a word of one text
        maybe = np.flatnonzero(capital & usual)
        name = plain.copy()
        name[maybe[np.isin(own[maybe], own[seen])]] = True
        texts = np.zeros(len(sizes), bool)
        texts[doc[seen]] = True
        yield form(name, np.flatnonzero(texts[doc]))


NAME = 0x6E616D6500000000


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` template words."""
    if len(h) < size:
        return np.zeros(0, np.int64)
    x = h ^ (h >> np.uint64(31))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out *= np.uint64(PRIME)
        out += x[i : len(h) - size + 1 + i]
    return ((out ^ (out >> np.uint64(29))) * np.uint64(PRIME) + np.uint64(size)).astype(np.int64)


class Wanted:
    """A Bloom filter of window hashes: two bits each of 2 ** ``power``."""

    def __init__(self, power: int, bits: np.ndarray):
        self.power, self.bits = power, bits

    def within(self, w: np.ndarray) -> np.ndarray:
        u, out = w.view(np.uint64), None
        for at in (u >> np.uint64(64 - self.power), u & np.uint64((1 << self.power) - 1)):
            hit = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            out = hit if out is None else out & hit
        return out.astype(bool)


def _hits(texts: pa.Array, ids: np.ndarray, sizes: list[int] | None, wanted: Wanted | None) -> pd.DataFrame:
    """Rows of ``SCHEMA``: windows of the texts, the wanted ones if given, with the
    text's hash and 8 bytes of hash for each slot's value. With no ``sizes`` each text
    has windows of the size that suits it: it is an item. A negative size is that of
    a whole text of under ``SHORT`` words without slots."""
    words, counts = split_words(texts)
    ends = np.cumsum(counts)
    parts, of_text = [], {}
    for k, t in enumerate(templates(words, counts) if len(words) else ()):
        value: dict[int, bytes] = {}

        def digest(i: int, t=t, value=value) -> bytes:
            if i not in value:
                value[i] = xxh64_digest(_value(words, int(t.first[i]), int(t.end[i]), bool(t.second[i])), 3)
            return value[i]

        filled = np.concatenate([[0], np.cumsum(t.slot)])
        has_slot = np.bincount(t.doc, t.slot, len(counts)) > 0
        lengths = np.append(t.lengths, np.zeros(len(counts) - len(t.lengths), np.int64))
        short = (counts < SHORT) & ~has_slot
        own = np.where(short, -lengths, np.minimum(lengths, WINDOW))
        for size in sizes if sizes is not None else sorted({int(x) for x in own if x}):
            w = windows(t.h, abs(size))
            n = len(w)
            if not n:
                continue
            ok = t.doc[:n] == t.doc[abs(size) - 1 :]
            if sizes is None or size < 0:
                ok &= own[t.doc[:n]] == size
            inside = filled[abs(size) :] - filled[: -abs(size)]
            weak = np.flatnonzero(ok & (inside > 0) & (abs(size) - inside < LITERAL))
            if len(weak):  # by its values, too
                change = np.zeros(len(t.h) + 1, np.int64)
                np.add.at(change, weak, 1)
                np.add.at(change, weak + abs(size), -1)
                v = np.zeros(len(t.h), np.uint64)
                for i in np.flatnonzero((np.cumsum(change)[:-1] > 0) & t.slot).tolist():
                    v[i] = np.frombuffer(digest(i), np.uint64)[0]
                w[weak] ^= windows(v, abs(size))[weak]
            if wanted is not None:
                ok &= wanted.within(w)
            p = np.flatnonzero(ok)
            if not len(p):
                continue
            d = t.doc[p]
            for i in set(d.tolist()):
                if (i, k) not in of_text:
                    of_text[i, k] = int(np.uint64(xxh64_intdigest(" ".join(words[ends[i] - counts[i] : ends[i]].to_pylist()), 5 + k)).astype(np.int64))
            slots = [b"".join(map(digest, (i + np.flatnonzero(t.slot[i : i + abs(size)])).tolist())) if f else b"" for i, f in zip(p.tolist(), inside[p].tolist())]
            parts.append(pd.DataFrame({"id": ids[d], "ver": [of_text[i, k] for i in d.tolist()], "h": w[p], "pos": p - t.starts[d], "size": size, "slots": slots}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


def _value(words: pa.Array, a: int, b: int, second: bool) -> bytes:
    """The value of the placeholder of the words from ``a`` to ``b``; ``b`` is ``a``
    for the number of a joined pair, whose unit follows in the same word."""
    text = " ".join(words[a : max(b, a + 1)].to_pylist()).lower().strip(MARKS)
    joined = _joined(text)
    return (joined[second] if joined else text).encode()


SCHEMA = "id long, ver long, h long, pos int, size int, slots binary"
ARROW = pa.schema([("id", pa.int64()), ("ver", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("slots", pa.binary())])
#: Bytes of texts that are scanned together.
TOGETHER = 1_000_000


def template_windows(df: DataFrame, id_col: str, text_col: str, sizes=None, wanted: Wanted | None = None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((wanted.power, wanted.bits)) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("pieces")
        keep = Wanted(*shared.value) if shared else None
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            length = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            for a, b in _runs(length // TOGETHER):
                found = _hits(texts.slice(a, b - a), ids[a:b], sizes, keep)
                if len(found):
                    yield pa.RecordBatch.from_pandas(found, ARROW, preserve_index=False)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL").mapInArrow(run, SCHEMA)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


#: Bits of the filter for a window of the items, and the most of all (32 MB): beyond
#: it the filter lets more through and the join, which decides, has more to do.
FILTER_BITS, MOST_BITS = 256, 1 << 28


def wanted_windows(theirs: DataFrame, most_bits: int = MOST_BITS) -> Wanted:
    """The filter of the items' windows, summed up by 64-bit words of it."""
    hashes = theirs.select("h").distinct()
    bits = min(most_bits, max(64, FILTER_BITS * hashes.count()))
    power = bits.bit_length() - 1
    at = hashes.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - power), F.col("h").bitwiseAND(F.lit((1 << power) - 1)))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()  # at most 2 ** 22 rows
    out = np.zeros(1 << max(0, power - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return Wanted(power, out.view(np.uint8))


def _consistency(islots: list[bytes], slots: list[bytes]) -> tuple[float, int]:
    """Share of slots in which a value meets its most frequent partner, the lesser of
    both directions, and the item's distinct values."""
    a, b = (np.unique(np.frombuffer(b"".join(x), np.int64), return_inverse=True) for x in (islots, slots))
    if not len(a[1]):
        return 1.0, 0
    pairs, n = np.unique(a[1] * len(b[0]) + b[1], return_counts=True)
    shares = []
    for side, size in ((pairs // len(b[0]), len(a[0])), (pairs % len(b[0]), len(b[0]))):
        top = np.zeros(size, np.int64)
        np.maximum.at(top, side, n)
        shares.append(top.sum() / n.sum())
    return min(shares), len(a[0])


def _best(pos: np.ndarray, ipos: np.ndarray, h: np.ndarray, slots: np.ndarray, islots: np.ndarray, n: int) -> tuple | None:
    """(n_matched, n_slots, consistency) of the occurrence with most windows that
    passes, of all matches between a text and an item with ``n`` windows."""
    order = np.lexsort((ipos, pos - ipos))
    pos, ipos, h, slots, islots = (x[order] for x in (pos, ipos, h, slots, islots))
    d = pos - ipos
    h = np.unique(h, return_inverse=True)[1]
    found = [(-(int(h.max()) + 1), 3, 0, np.arange(len(d)))]
    for a in np.unique(d).tolist():
        for k, slack in enumerate((0, WINDOW, max(2 * WINDOW, n))):
            lo, hi = np.searchsorted(d, [a - slack, a + slack + 1])
            at = np.arange(lo, hi)
            at = at[np.lexsort((d[at], np.abs(d[at] - a), ipos[at]))]
            at = at[np.concatenate([[True], ipos[at[1:]] != ipos[at[:-1]]])]  # the match nearest to the diagonal
            found.append((-len(np.unique(h[at])), k, a, at))
    for m, _, _, at in sorted(found, key=lambda x: x[:3]):
        if round(-m / n, 6) < COVERAGE:
            return None
        share, n_slots = _consistency(islots[at].tolist(), slots[at].tolist())
        if round(share, 6) >= CONSISTENT:
            return -m, n_slots, share
    return None


BOTH = ["id", "ver", "item", "iver"]
#: Texts with items that are scored in one call.
SCORED = 200


def _score(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values(BOTH, ignore_index=True)
    keys, out = f[BOTH].to_numpy(), []
    cols = [f[c].to_numpy() for c in ("pos", "ipos", "h", "slots", "islots")]
    cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        n = int(f["n_windows"].iat[a])
        best = _best(*(c[a:b] for c in cols), n)
        if best:
            out.append((keys[a][0], keys[a][2], best[0], n, *best[1:]))
    return pd.DataFrame(out, columns=["id", "item", "n_matched", "n_windows", "n_slots", "consistency"])


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """A row per leak: id, item, matched and all windows of the item, coverage,
    slots seen and their consistency, of the occurrence with most windows."""
    theirs = table(template_windows(items, item_id, item_text).select(F.col("id").alias("item"), F.col("ver").alias("iver"), "h", F.col("pos").alias("ipos"), "size", F.col("slots").alias("islots")), "item-windows")
    sizes = [r.size for r in theirs.select("size").distinct().orderBy("size").collect()]  # at most WINDOW + SHORT rows
    ours = table(template_windows(docs, id_col, text_col, sizes or [WINDOW], wanted_windows(theirs, most_bits)), "text-windows")
    pairs = table(join_salted(ours, theirs, ["h", "size"]).select(*BOTH, "h", "pos", "ipos", "slots", "islots").distinct(), "window-pairs")
    # Item windows with one hash (a repeated phrase) count once.
    per_item = theirs.groupBy("item", "iver").agg(F.count_distinct("h").alias("n_windows"))
    hit = pairs.groupBy(*BOTH).agg(F.count_distinct("h").alias("n")).join(per_item, ["item", "iver"]).filter(F.round(F.col("n") / F.col("n_windows"), 6) >= COVERAGE)
    hit = table(hit.select(*BOTH, "n_windows"), "window-hits")
    calls = max(1, hit.count() // SCORED)
    scored = pairs.join(hit, BOTH).withColumn("call", F.pmod(F.xxhash64(*BOTH), F.lit(calls)))
    scored = scored.groupBy("call").applyInPandas(_score, "id long, item long, n_matched long, n_windows long, n_slots long, consistency double")
    out = scored.withColumns({"coverage": F.round(F.col("n_matched") / F.col("n_windows"), 6), "consistency": F.round("consistency", 6)})
    best = out.groupBy("id", "item").agg(F.max(F.struct("coverage", "consistency", "n_matched", "n_windows", "n_slots")).alias("x"))
    return best.select("id", "item", *[f"x.{c}" for c in ("n_matched", "n_windows", "coverage", "n_slots", "consistency")])


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """All leaks of ``benchmark`` items in ``documents``: doc_id and item_id pairs."""
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text leaks an item, whatever their ids: a text
    is known by its hash."""
    key = fresh(docs.columns, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{text_col}`")))
    name = fresh([*docs.columns, key], "leaking")
    bad = leaks(keyed, items, key, text_col).select(F.col("id").alias(name)).distinct()
    return keyed.join(bad, F.col(key) == F.col(name), "left_anti").drop(key)
