"""Ranked lexical search over bit-sliced Bloom signatures.

Documents are dealt into blocks of like size. A block holds one bitmap per signature bit, with one bit
per document; a document sets HASHES bits for each of its terms and for each step of LEVELS that the
term's count reaches. ANDing a term's bitmaps gives the documents that may hold it so often, never too
few. The weighted sum of these slices, level by level, is an upper bound of the score. The bound's best
documents are scored exactly and give each item a threshold; then every document whose bound reaches
it is scored exactly, so nothing that belongs to the result is lost.

Nulls and texts without a term hold no term and never rank. Repeated document rows rank each on their own;
rows that share an item_id (null is an id too) are one item with all their terms. Equal scores go by
ascending doc_id, null first. Empty tables give an empty result. Only doc_id, item_id and text are read,
so other columns may have any name. Long texts get wider signatures in smaller blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import keep, same

LEVELS = (1, 2, 3, 5, 9, 17)  # a term sets the keys of all levels up to its count
HASHES = 4
BITS = 8  # signature bits for each key, before rounding up to a power of two
CELLS = 1 << 25  # documents times bits of a block
BLOCK_DOCS = 4096
HELD = 2_000_000  # terms of documents (8 bytes each, and a word) that a task holds before it gives out its fullest block
CHUNK_TERMS = 200_000  # terms of the items that are asked at once
BROADCAST_PAIRS = 500_000  # candidates (16 bytes a document, 4 a pair) up to which they are broadcast

# what a term is: digits, letters and all bytes of characters beyond ASCII; only A-Z are lower-cased
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()

INDEX = (
    "bits int, ids array<bigint>, keys array<bigint>, n array<bigint>, most array<bigint>, slices binary, "
    "terms array<string>, df array<bigint>"
)


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _hashed(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _positions(hashed: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Rows of the signature that a key sets: one row of HASHES numbers per term."""
    key = (hashed + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(29)
    step = (key >> np.uint64(32)) | np.uint64(1)
    return ((key[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


class _Block:
    """Documents of one signature width on their way into an index row."""

    def __init__(self, bits: int):
        self.bits, self.room = bits, max(8, min(BLOCK_DOCS, CELLS // bits))
        self.docs: list[tuple] = []
        self.codes: dict[bytes, int] = {}
        self.held = 0

    def add(self, ident, key, counts: Counter) -> bool:
        codes = np.fromiter((self.codes.setdefault(t, len(self.codes)) for t in counts), np.int32, len(counts))
        self.docs.append((ident, key, codes, np.fromiter(counts.values(), np.int32, len(counts))))
        self.held += len(counts)
        return len(self.docs) == self.room

    def row(self) -> dict:
        words = list(self.codes)
        hashed, df = _hashed(words), np.zeros(len(words), np.int64)
        slices = np.zeros((self.bits, (len(self.docs) + 7) // 8), np.uint8)
        for d, (_, _, codes, tf) in enumerate(self.docs):
            df[codes] += 1
            for level, least in enumerate(LEVELS):
                held = codes[tf >= least]
                if not len(held):
                    break
                slices[_positions(hashed[held], level, self.bits).ravel(), d >> 3] |= np.uint8(128 >> (d & 7))
        return {
            "bits": self.bits, "ids": [x[0] for x in self.docs], "keys": [x[1] for x in self.docs],
            "n": [int(x[3].sum(dtype=np.int64)) for x in self.docs], "most": [int(x[3].max()) for x in self.docs],
            "slices": slices.tobytes(), "terms": [w.decode() for w in words], "df": df.tolist(),
        }


def index(docs: DataFrame) -> DataFrame:
    """One row per block of documents (INDEX); documents without a term are left out."""
    schema = pa.schema([("bits", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("ids", "keys", "n", "most")], ("slices", pa.binary()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, _Block] = {}
        held = 0
        for batch in batches:
            for ident, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                counts = Counter(terms(text.as_py()))
                if not counts:
                    continue
                most = max(counts.values())
                keys = len(counts) if most == 1 else sum(sum(v >= least for least in LEVELS) for v in counts.values())
                bits = max(512, 1 << math.ceil(math.log2(BITS * keys)))
                block = open_blocks.setdefault(bits, _Block(bits))
                full = block.add(ident, key, counts)
                held += len(counts)
                if full or held > HELD:
                    block = open_blocks.pop(bits if full else max(open_blocks, key=lambda b: open_blocks[b].held))
                    held -= block.held
                    yield pa.RecordBatch.from_pylist([block.row()], schema)
        batch = text = None  # the last texts need not stay while the blocks are packed
        for bits in list(open_blocks):
            yield pa.RecordBatch.from_pylist([open_blocks.pop(bits).row()], schema)

    return _keyed(docs).mapInArrow(build, INDEX)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each term of an item once."""

    def split(batches):
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = sorted(set(terms(text.as_py())))
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([ident] * len(found), pa.int64()), "term": pa.array([t.decode() for t in found], pa.string())})

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).mapInArrow(split, "item_id bigint, term string").distinct()


def weighted(asked: DataFrame, built: DataFrame, total: int) -> DataFrame:
    """item_id, term, w for the terms that any document holds."""
    df = built.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    df = df.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log((2.0 * total + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    return asked.join(df, "term").select("item_id", "term", w.alias("w"))


def length_part(n, total: int, length: int):
    """m of documents with ``n`` terms, in whole numbers."""
    return 10 + (90 * n * total) // length


def bounds(built: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], total: int, length: int, least: list[int] | None, k: int) -> DataFrame:
    """item, doc_id, key: documents whose bound reaches ``least`` of the item, or a task's ``k`` highest bounds."""

    def slices_of(row) -> Iterator[tuple[int, np.ndarray]]:
        slices = np.frombuffer(row["slices"], np.uint8).reshape(row["bits"], -1)
        n, most = np.array(row["n"], np.int64), np.array(row["most"], np.int64)
        m = np.array([length_part(int(x), total, length) for x in n], np.int64)
        gains, before = [], np.zeros(len(n), np.int64)
        for after in [*LEVELS[1:], None]:
            tf = most if after is None else np.minimum(after - 1, most)
            value = (10**9 * tf) // (1000 * tf + 8 * m)
            gains.append((value - before).astype(float))
            before = value
        for item, (hashed, w) in enumerate(asked):
            bound, held, rest = np.zeros(len(n)), None, np.arange(len(w))
            for level, gain in enumerate(gains):
                at = _positions(hashed[rest], level, row["bits"])
                now = slices[at[:, 0]]
                for i in range(1, HASHES):
                    now &= slices[at[:, i]]
                if held is not None:
                    now &= held
                some = now.any(axis=1)
                rest, held = rest[some], now[some]
                if not len(rest):
                    break
                bound += (w[rest] @ np.unpackbits(held, axis=1, count=len(n))) * gain
            yield item, bound

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found: tuple[list, list, list] = ([], [], [])
                for item, bound in slices_of(row):
                    if least is None:
                        at = np.argpartition(-bound, k - 1)[:k] if len(bound) > k else np.arange(len(bound))
                        new = [(bound[d], row["ids"][d], row["keys"][d]) for d in at if bound[d] > 0]
                        best[item] = sorted([*best.get(item, []), *new], key=lambda x: -x[0])[:k]
                    else:
                        at = np.flatnonzero((bound >= least[item]) & (bound > 0))
                        found[0].extend([item] * len(at))
                        found[1].extend(row["ids"][d] for d in at)
                        found[2].extend(row["keys"][d] for d in at)
                if found[0]:
                    yield out(found[0], found[1], found[2], [0.0] * len(found[0]))
        for item, rows in best.items():
            yield out([item] * len(rows), [r[1] for r in rows], [r[2] for r in rows], [float(r[0]) for r in rows])

    def out(item, ids, keys, bound):
        return pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "bound": pa.array(bound, pa.float64())})

    found = built.select("bits", "ids", "keys", "n", "most", "slices").mapInArrow(scan, "item int, doc_id bigint, key bigint, bound double")
    if least is None:
        top = Window.partitionBy("item").orderBy(F.desc("bound"))
        found = found.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= k)
    return found.select("item", "doc_id", "key")


def exact(docs: DataFrame, pairs: DataFrame, asked: list[dict[bytes, int]], total: int, length: int) -> DataFrame:
    """item, doc_id, score > 0 of all document rows that ``pairs`` (item, doc_id, key) name."""
    wanted = keep(pairs.distinct().groupBy("doc_id", "key").agg(F.collect_list("item").alias("items")), "candidates")
    size = wanted.agg(F.coalesce(F.sum(F.size("items") + 4), F.lit(0))).first()[0]
    wanted = wanted.withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    texts = _keyed(docs)
    hit = texts.join(F.broadcast(wanted) if size <= BROADCAST_PAIRS else wanted, same(texts, wanted, [("doc_id", "_d"), ("key", "_k")]))

    def score(batches):
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for ident, text, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                counts = Counter(terms(text.as_py()))
                m = length_part(sum(counts.values()), total, length)
                for item in items:
                    got = 0
                    for term, w in asked[item].items():
                        tf = counts.get(term)
                        if tf:
                            got += w * ((10**9 * tf) // (1000 * tf + 8 * m))
                    if got > 0:
                        rows[0].append(item)
                        rows[1].append(ident)
                        rows[2].append(got)
            yield pa.RecordBatch.from_pydict({"item": pa.array(rows[0], pa.int32()), "doc_id": pa.array(rows[1], pa.int64()), "score": pa.array(rows[2], pa.int64())})

    return hit.select("doc_id", "text", "items").mapInArrow(score, "item int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of every item.

    Items are a stated query set: they are asked in chunks of at most about CHUNK_TERMS terms, which the
    driver holds one at a time.
    """
    spark = docs.sparkSession
    result = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    built = keep(index(docs), "signatures")
    total, length = built.agg(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    if not total:
        return result
    terms_of = keep(weighted(item_terms(items), built, total), "asked")
    chunks = max(1, math.ceil(terms_of.count() / CHUNK_TERMS))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    best = lambda found: found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    for chunk in range(chunks):
        sets: dict = {}
        for row in terms_of.filter(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == chunk).collect():
            sets.setdefault(row["item_id"], {})[row["term"].encode()] = row["w"]
        if not sets:
            continue
        ids, asked = list(sets), list(sets.values())
        packed = [(_hashed(list(s)), np.array(list(s.values()), float)) for s in asked]
        first = best(exact(docs, bounds(built, packed, total, length, None, 2 * k), asked, total, length))
        least = [0] * len(ids)
        for row in first.filter(F.col("rank") == k).collect():  # one row an item of this chunk
            least[row["item"]] = row["score"]
        final = best(exact(docs, bounds(built, packed, total, length, least, k), asked, total, length))
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id bigint")
        result = result.unionByName(final.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return result
