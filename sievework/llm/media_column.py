"""Media columns: payloads as progressive JPEGs, read back as coefficients and RGB.

A JPEG's lossless unit is its quantised coefficient. A payload byte b becomes the
AC coefficient 256 + b (63 to a block, DC is 0, all quantisers are 1) of a 4:2:0
image; scans send the upper bits by spectral band and then the last bit, and
reading accumulates them. The comment segment holds the payload's length.

Defined results: a null or empty text is 576 bytes of 255; null ids and repeated
rows keep their rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .jpeg import Component, Image, Scan

UNIT = 576
BASE = 256
#: Blocks of one run of correction bits: 14 extra bits at most.
RUN = 32767


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def _layout(n: int) -> Image:
    """A 4:2:0 image with room for ``n`` payload bytes."""
    mcus = max(1, -(-n // (63 * 6)))
    cols = math.isqrt(mcus - 1) + 1
    rows = -(-mcus // cols)
    return Image(16 * cols, 16 * rows, [Component(1, 2, 2), Component(2, 1, 1), Component(3, 1, 1)], {0: np.ones(64, np.int32)})


def _first(values: np.ndarray, low: int, size: int) -> np.ndarray:
    """Bits of a first AC scan: the code's zero, then the value."""
    v = (values >> low).astype(">u2").reshape(-1, 1)
    bits = np.unpackbits(v.view(np.uint8), axis=1)[:, 16 - size :]
    return np.concatenate([np.zeros((len(bits), 1), np.uint8), bits], 1).ravel()


def _last(values: np.ndarray, n: int) -> tuple[int, np.ndarray]:
    """The symbol and bits of the scan of the last bit, of ``n`` blocks."""
    runs = -(-n // RUN)
    cuts = [n * i // runs for i in range(runs + 1)]
    power = min(b - a for a, b in zip(cuts, cuts[1:])).bit_length() - 1
    out = []
    for a, b in zip(cuts, cuts[1:]):
        extra = [int(x) for x in f"{b - a - (1 << power):0{power}b}"] if power else []
        out += [np.array([0, *extra], np.uint8), (values[a * 63 : b * 63] & 1).astype(np.uint8)]
    return power << 4, np.concatenate(out)


def store(payload: bytes) -> bytes:
    """The payload as a progressive JPEG."""
    im = _layout(len(payload))
    im.comment = struct.pack(">Q", len(payload))
    mcus = im.width * im.height // 256
    values = np.full(mcus * 6 * 63, BASE, np.int32)
    values[: len(payload)] += np.frombuffer(payload, np.uint8)
    out = [jpeg.head(im), jpeg.scan_head(im, Scan([0, 1, 2], 0, 0, 0, 0), *jpeg.one_code(0)), jpeg._pack(np.zeros(mcus * 6, np.uint8))]
    at = 0
    for i, n in enumerate((4 * mcus, mcus, mcus)):
        v = values[at : at + n * 63]
        at += n * 63
        for a, b in ((1, 5), (6, 63)) if i == 0 else ((1, 63),):
            out += [jpeg.scan_head(im, Scan([i], a, b, 0, 1), *jpeg.one_code(8)), jpeg._pack(_first(v.reshape(n, 63)[:, a - 1 : b], 1, 8))]
        symbol, bits = _last(v, n)
        out += [jpeg.scan_head(im, Scan([i], 1, 63, 1, 0), *jpeg.one_code(symbol)), jpeg._pack(bits)]
    return b"".join([*out, b"\xff\xd9"])


def load(media: bytes) -> tuple[bytes, Image]:
    """The payload and the image of a stored JPEG."""
    im = jpeg.decode(media)
    n = struct.unpack(">Q", im.comment)[0]
    values = np.concatenate([c.coefs[:, :, 1:].ravel() for c in im.components])[:n]
    return (values - BASE).astype(np.uint8).tobytes(), im


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text's padded UTF-8 as a JPEG."""

    @F.pandas_udf("binary")
    def write(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([store(pad(x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"")) for x in t], dtype=object)

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), write(F.col(text_col)).alias("media"))


def rgb_tensors(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with the column ``tensor``: (height, width, rgb bytes) of any
    progressive JPEG, null for a null one."""

    @F.pandas_udf("height int, width int, rgb binary")
    def read(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for m in column:
            t = [jpeg.rgb(jpeg.decode(bytes(x))) if x is not None else None for x in m]
            yield pd.DataFrame({"height": [x.shape[0] if x is not None else None for x in t], "width": [x.shape[1] if x is not None else None for x in t], "rgb": [x.tobytes() if x is not None else None for x in t]})

    return media.withColumn("tensor", read(F.col(media_col)))


def features(media: DataFrame) -> DataFrame:
    """``media`` (id, n_bytes, media) with what is read back from the stored bytes."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def read(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for m in column:
            rows = []
            for x in m:
                x = bytes(x)
                payload, im = load(x)
                t = jpeg.rgb(im)
                mean = t.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (t.shape[0] * t.shape[1])
                feature = f"{t.shape[1]}x{t.shape[0]}:{mean[0]}:{mean[1]}:{mean[2]}:{zlib.crc32(t.tobytes()):08x}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(x), hashlib.sha256(x).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.withColumn("r", read(F.col("media"))).select("id", "n_bytes", "r.*")


def op3_media_column(spark, sf_dir: str) -> DataFrame:
    """All documents stored as JPEGs and read back."""
    return features(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("id", "doc_id")
