"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id (or by another order); a partition is one
file of token ids, one of offsets, one of document ids and one of the places whose
id is null, each written under a name of the attempt and then renamed, so that a
repeated task leaves whole files only. Partition bases are prefix sums of the
partitions' totals. The manifest, a JSON line per part, is written last: parts are
committed by it, and it is all that a reader needs. Readers map the files into
memory.

Defined results: a null or empty text is the end id alone; null ids come first
and are listed; equal ids are ordered by a hash of their text and each give a row;
a very long text is encoded whole; an empty table gives an empty manifest and no
rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, worker_cache

END_ID = 2
#: Entries of a worker's memory of encoded pieces, about 200 bytes each.
MEMORY = 700_000
OTHER_SPACE = re.compile(r"[^\S \n]")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_type(path: str) -> str:
    """``<u2`` where all ids of the vocabulary fit, else ``<u4``."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 65536 else "<u4"


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    rest for the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Pieces(dict):
    """Ids, as bytes, of pieces between single spaces, encoded when first met.

    A key is a piece that follows a space; a leading null character marks one
    that does not. A byte-level BPE cuts before and after runs of letters, so a
    word, its closing mark and a line's end are looked up each for itself.
    """

    def __init__(self, tok, kind: str):
        self.tok, self.model, self.kind, self.letters = tok, tok.model, kind, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        bare = piece[:1] == "\0"
        w = piece[1:] if bare else piece
        if w[:-1].isalpha() and w[-1] in ".,;:!?":
            ids = self[piece[:-1]] + self["\0" + w[-1]]
        elif w[:1] == "\n" and w[1:2].isalpha() and not bare:
            ids = self["\0\n"] + self["\0" + w[1:]]
        elif w.isalpha():
            text = w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode()))
            ids = array(self.kind, [t.id for t in self.model.tokenize(text if bare else self.letters[32] + text)]).tobytes()
        else:
            text = w if bare or w[:1] == "\n" else " " + w
            ids = array(self.kind, self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        self[piece] = ids
        return ids


def encoder(path: str, dtype: str):
    """A function from a text to its ids as bytes.

    A byte-level BPE without prefix space cuts a text before any white space that
    follows another character, so the pieces there encode alike in every text.
    Texts with runs of white space or a special token's string, and texts for
    other tokenizers, are encoded whole.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(path)
    spec = json.loads(tok.to_str())
    pre = spec.get("pre_tokenizer") or {}
    pieces = (
        spec["model"]["type"] == "BPE" and not any(spec["model"].get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    )
    unsplit = ["  ", " \n", "\n ", "\n\n", "\0", *(x["content"] for x in spec.get("added_tokens", []))]
    kind = {"<u2": "H", "<u4": "I"}[dtype]
    # The worker process keeps its pieces from task to task, by tokenizer file.
    seen = worker_cache("pieces", dict).setdefault((path, dtype), Pieces(tok, kind))

    def encode(t: str) -> bytes:
        if not pieces or not t or t[0] in " \n" or OTHER_SPACE.search(t) or any(x in t for x in unsplit):
            return array(kind, tok.encode(t, add_special_tokens=False).ids).tobytes()
        if len(seen) > MEMORY:
            seen.clear()
        p = t.replace("\n", " \n").split(" ")
        p[0] = "\0" + p[0]
        return b"".join(map(seen.__getitem__, p))

    return encode


def _batches(batch: pa.RecordBatch, n: int = 256):
    """The columns of an Arrow batch as lists of at most ``n`` rows."""
    for k in range(0, batch.num_rows, n):
        yield tuple(c.to_pylist() for c in batch.slice(k, n).columns)


def file_system(uri: str):
    """The file system of a folder and its path there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a://") else uri)


FILES = ("bin", "off", "ids", "nul")


def _writer(out: str, path: str, dtype: str, end_id: int):
    def write(batches):
        fs, root = file_system(out)
        encode, end = encoder(path, dtype), np.array([end_id], dtype).tobytes()
        task = TaskContext.get()
        name, own = f"{root}/part-{task.partitionId():06d}", f"{root}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        docs = tokens = 0
        files = None
        for batch in batches:
            for ids, texts in _batches(batch):
                if files is None:
                    files = [fs.open_output_stream(f"{own}.{x}") for x in FILES]
                    files[1].write(np.zeros(1, "<i8").tobytes())
                blobs = [encode(t) + end for t in texts]
                ends = tokens + np.cumsum([len(b) for b in blobs], dtype="<i8") // int(dtype[-1])
                nulls = [docs + k for k, i in enumerate(ids) if i is None]
                for f, b in zip(files, (b"".join(blobs), ends.tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(nulls, "<i8").tobytes())):
                    f.write(b)
                docs, tokens = docs + len(ids), int(ends[-1])
        if files:
            for f, x in zip(files, FILES):
                f.close()
                fs.move(f"{own}.{x}", f"{name}.{x}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "docs": [docs], "tokens": [tokens]})

    return write


MANIFEST = "part int, docs long, tokens long, base long, dtype string, end_id int"


def write_token_files(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, order: list[Column] | None = None) -> None:
    """Write the files to ``out``, then their manifest: (part, docs, tokens, base,
    dtype, end_id) a line, where base is the number of ids in all parts before.
    ``order`` are columns to go by instead of the id."""
    path = path or tokenizer_file()
    dtype = id_type(path)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = F.col(f"`{id_col}`").cast("long")
    keys = [*(order or []), own, F.xxhash64(text)]
    names = [f"k{i}" for i in range(len(keys))]
    ordered = docs.select(own.alias("i"), text.alias("t"), *[k.alias(n) for k, n in zip(keys, names)]).repartitionByRange(*names).sortWithinPartitions(*names).select("i", "t")
    jvm, conf = docs.sparkSession._jvm.org.apache.hadoop.fs.Path, docs.sparkSession._jsc.hadoopConfiguration()
    fs = jvm(out).getFileSystem(conf)
    fs.mkdirs(jvm(out))
    parts = sorted(tuple(r) for r in ordered.mapInArrow(_writer(out, path, dtype, end_id), "part int, docs long, tokens long").collect())  # a row per file
    bases = accumulate((p[2] for p in parts), initial=0)
    lines = "".join(json.dumps({"part": p, "docs": d, "tokens": n, "base": b, "dtype": dtype, "end_id": end_id}) + "\n" for (p, d, n), b in zip(parts, bases))
    stream = fs.create(jvm(f"{out}/.manifest"))
    stream.write(bytearray(lines.encode()))
    stream.close()
    fs.rename(jvm(f"{out}/.manifest"), jvm(f"{out}/manifest.json"))


def open_array(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory on a local path, else read."""
    from pyarrow.fs import LocalFileSystem

    fs, p = file_system(uri)
    if isinstance(fs, LocalFileSystem):
        return np.memmap(p, dtype, "r") if fs.get_file_info(p).size else np.zeros(0, dtype)
    with fs.open_input_file(p) as f:
        return np.frombuffer(f.read(), dtype)


def open_part(out: str, part: int, dtype: str) -> tuple[np.ndarray, np.ndarray, list]:
    """A part's token ids, its documents' offsets (one more than documents), and
    their ids."""
    ids, off, doc, nul = (open_array(f"{out}/part-{part:06d}.{x}", dtype if x == "bin" else "<i8") for x in FILES)
    names = doc.tolist()
    for k in nul.tolist():
        names[k] = None
    return ids, off, names


def read_manifest(out: str) -> list[dict]:
    """The manifest's lines, without Spark."""
    fs, p = file_system(f"{out}/manifest.json")
    with fs.open_input_stream(p) as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def _reader(out: str):
    def read(batches):
        for batch in batches:
            for part, base, dtype in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "dtype"))):
                ids, off, doc = open_part(out, part, dtype)
                for k in range(0, len(doc), 4096):
                    o = np.asarray(off[k : k + 4097])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc[k : k + 4096], pa.int64()),
                        "start": pa.array(base + o[:-1], pa.int64()), "n_tokens": pa.array(np.diff(o), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(o[:-1].tolist(), o[1:].tolist())], pa.int64()),
                    })

    return read


def read_token_files(spark, out: str) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    lines = spark.read.schema(MANIFEST).json(f"{out}/manifest.json")
    parts = lines.select("part", "base", "dtype").repartition(max(1, lines.count()), "part")
    return parts.mapInArrow(_reader(out), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, order: list[Column] | None = None) -> DataFrame:
    """Write all documents' files to the shared folder and read them back."""
    out = shared_dir(docs.sparkSession, "tokens")
    write_token_files(docs, out, path=path, end_id=end_id, order=order)
    return read_token_files(docs.sparkSession, out)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """:func:`token_files` over all documents."""
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
