"""What finding repeated spans has in common: hashing all windows, anchors, and texts worth a closer look.

Texts are compared by content: of equal ones a single representative goes on, and how many there are
is counted. Each text is reduced to content-defined anchors, the smallest hashes of a sliding window,
so that equal windows have equal anchors. Only texts with an anchor that occurs twice go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import keep, same

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 18), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def prefix_hashes(data: bytes) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, modulo 2**64."""
    a = np.frombuffer(data, np.uint8)
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_TABLE[a] * _grown(len(a) + 1)[0][: len(a)], out=out[1:])
    return out


def slice_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every data[start:end]; equal slices have equal hashes wherever they stand."""
    h = (prefix[end] - prefix[start]) * _grown(len(prefix))[1][start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding(best: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """best (minimum or maximum) over each run of ``width`` values."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = best(x[: len(x) - step], x[step:])
        span += step
    return x


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def scan(docs: DataFrame, profile: Callable, name: str) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, what, size, whole, hashes, starts, ends (a kept table).

    ``profile`` maps a text's bytes to (content, size, hashes, starts, ends): what is compared, in which
    units it is long, and its anchors. ``what`` is a digest of the content, ``whole`` its SHA-256.
    """
    lists = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for text in part.column(2).to_pylist():
                    content, size, *found = profile(text or b"")
                    rows.append((digest(content), size, hashlib.sha256(content).hexdigest(), *found))
                cols = list(zip(*rows))
                packed = []
                for kind, col in zip(lists, cols[3:]):
                    ends = np.cumsum([0, *map(len, col)]).astype(np.int32)
                    packed.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(col).astype(kind.value_type.to_pandas_dtype()))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *packed],
                    names=["doc_id", "text_hash", "what", "size", "whole", "hashes", "starts", "ends"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    kinds = "doc_id long, text_hash long, what binary, size long, whole string, hashes array<long>, starts array<int>, ends array<int>"
    return keep(rows.mapInArrow(run, kinds), name)


def suspects(docs: DataFrame, scanned: DataFrame, name: str) -> DataFrame:
    """One row per different content that holds an anchor occurring twice: id, what, text, and its such ``places``
    (structs of hash, start, end). A kept table."""
    one = scanned.groupBy("what").agg(F.min(F.struct("doc_id", "text_hash", "hashes", "starts", "ends")).alias("one"))
    texts = keep(one.select(F.monotonically_increasing_id().alias("id"), "what", "one.*"), f"{name}-texts")
    places = texts.select("id", F.explode(F.arrays_zip("hashes", "starts", "ends")).alias("p")).select("id", F.col("p.hashes").alias("hash"), F.col("p.starts").alias("start"), F.col("p.ends").alias("end"))
    twice = places.groupBy(F.col("hash").alias("of")).agg(F.count("*").alias("n")).filter("n > 1").select("of")
    held = places.join(twice, F.col("hash") == F.col("of")).groupBy("id").agg(F.collect_list(F.struct("hash", "start", "end")).alias("places"))
    held = held.join(texts.select(F.col("id").alias("t_id"), "what", F.col("doc_id").alias("t_doc"), F.col("text_hash").alias("t_hash")), F.col("id") == F.col("t_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("d_doc"), F.xxhash64("text").alias("d_hash"), F.col("text").cast("binary").alias("text"))
    joined = rows.join(held, same(rows, held, [("d_doc", "t_doc"), ("d_hash", "t_hash")]))
    return keep(joined.select("id", "what", "text", "places"), f"{name}-suspects")


def spread(found: DataFrame, scanned: DataFrame, least: int, empty: dict) -> DataFrame:
    """Every row of ``scanned`` with its result: the one of its content in ``found`` (what, and the columns of
    ``empty``), all gone where the content occurs more than once and has ``least`` units, else nothing gone.

    ``empty`` gives for each result column its expression when nothing and when everything is gone."""
    counts = scanned.groupBy(F.col("what").alias("c_what")).agg(F.count("*").alias("n")).filter("n > 1")
    # repeated input rows may have brought equal results more than once
    found = found.groupBy(F.col("what").alias("f_what")).agg(*[F.min(c).alias(f"f_{c}") for c in empty])
    rows = scanned.select("doc_id", "what", "size", "whole")
    rows = rows.join(found, F.col("what") == F.col("f_what"), "left").join(counts, F.col("what") == F.col("c_what"), "left")
    gone = F.col("n").isNotNull() & (F.col("size") >= least)
    return rows.select("doc_id", "size", *[F.when(gone, every).otherwise(F.coalesce(F.col(f"f_{c}"), none)).alias(c) for c, (none, every) in empty.items()])
