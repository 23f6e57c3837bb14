"""Substring dedup on a compacted de Bruijn graph of token k-mers.

Every window of ``width`` words is an edge from its first to its last width - 1 words. Edges that occur
once cannot repeat; anchors rule most of them out before they are made. A repeated edge that always
follows the same edge, which it alone always follows, continues a path without branches. Joins of the
edges with their neighbours mark where such paths begin and end; only those marks go back to the
source coordinates, where each begin is paired with the next end. The words of every such stretch are
then digested, and a stretch counts only if another one has the same words.

Null texts have no words. Words are runs of bytes other than the six ASCII blanks. Repeated rows and
rows without doc_id are treated by their text. Shorter texts than a window have nothing removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import keep
from wellspring.llm.spans import digest, prefix_hashes, scan, slice_hashes, sliding, spread, suspects

WIDTH = 35
SEED = 8  # words of an anchor


def _words(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which words start and end in words joined by single spaces."""
    blanks = np.flatnonzero(np.frombuffer(content, np.uint8) == 32)
    return np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(content)]])


def window_hashes(content: bytes, width: int) -> np.ndarray:
    start, end = _words(content)
    if len(start) < width:
        return np.empty(0, np.uint64)
    return slice_hashes(prefix_hashes(content), start[: len(start) - width + 1], end[width - 1 :])


def profile(text: bytes, width: int, seed: int) -> tuple:
    """Anchors as runs of windows with one smallest seed: (hash, first window, last window).

    A run that holds its smallest seed more than once is given twice: its windows may equal each other."""
    words = text.split()
    content = b" ".join(words)
    if len(words) < width:
        return content, len(words), *[np.empty(0, np.int64)] * 3
    seeds, reach = window_hashes(content, seed), width - seed + 1
    least = sliding(np.minimum, seeds, reach)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    if len(np.unique(seeds)) < len(seeds):
        again = [k for k, (a, b) in enumerate(zip(first, last)) if (seeds[a : b + reach] == least[a]).sum() > 1]
        first, last = np.append(first, first[again]), np.append(last, last[again])
    return content, len(words), least[first].view(np.int64), first, last


def edges(found: DataFrame, width: int) -> DataFrame:
    """Occurrences (id, at, h, before, after) of windows whose anchor repeats, with the windows beside them.

    Missing neighbours get a number of their own, so that no two ends of texts look alike."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                h = window_hashes(b" ".join((batch.column(1)[k].as_py() or b"").split()), width).view(np.int64)
                runs = sorted((p["start"], p["end"]) for p in batch.column(2)[k].as_py())
                out, first = [], []
                for a, b in runs:
                    if first and a <= first[-1][1] + 1:
                        first[-1][1] = max(first[-1][1], b)
                    else:
                        first.append([a, b])
                ident = batch.column(0)[k].as_py()
                around = np.concatenate([[digest_long(ident, 0)], h, [digest_long(ident, 1)]])
                out = [around[a : b + 3] for a, b in first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ident] * len(out), pa.int64()), pa.array([a for a, _ in first], pa.int32()), pa.array(out, pa.list_(pa.int64()))],
                    names=["id", "first", "hs"],
                )

    stretches = keep(found.select("id", "text", "places").mapInArrow(run, "id long, first int, hs array<long>"), "stretches")
    step = lambda i: F.struct((F.col("first") + i).alias("at"), F.get("hs", i + 1).alias("h"), F.get("hs", i).alias("before"), F.get("hs", i + 2).alias("after"))
    return stretches.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("hs") - 3), step)).alias("e")).select("id", "e.*")


def digest_long(ident: int, side: int) -> int:
    return int.from_bytes(digest(b"%d %d" % (ident, side))[:8], "little", signed=True)


def marks(occurrences: DataFrame) -> DataFrame:
    """(id, at, opens, closes): where nonbranching paths of repeated edges begin and end in the texts."""
    met = occurrences.groupBy("h").agg(
        F.count("*").alias("n"), F.min("before").alias("p"), F.max("before").alias("p_max"), F.min("after").alias("s"), F.max("after").alias("s_max")
    )
    graph = keep(met.filter("n > 1").select("h", F.when(F.col("p") == F.col("p_max"), F.col("p")).alias("p"), F.when(F.col("s") == F.col("s_max"), F.col("s")).alias("s")), "graph")
    # an edge goes on into the next one if each is the other's only neighbour
    into = graph.filter("s IS NOT NULL").select(F.col("h").alias("from_h"), F.col("s").alias("to_h"))
    back = graph.filter("p IS NOT NULL").select(F.col("p").alias("from_p"), F.col("h").alias("to_p"))
    inner = into.join(back, (F.col("from_h") == F.col("from_p")) & (F.col("to_h") == F.col("to_p"))).select("from_h", "to_h")
    inner = keep(inner, "inner")
    ends = graph.select("h").join(inner.select(F.col("to_h")), F.col("h") == F.col("to_h"), "left").select("h", F.col("to_h").isNull().alias("opens"))
    ends = ends.join(inner.select(F.col("from_h")), F.col("h") == F.col("from_h"), "left").select("h", "opens", F.col("from_h").isNull().alias("closes"))
    ends = keep(ends.filter("opens OR closes"), "ends").withColumnRenamed("h", "e_h")
    return occurrences.join(ends, F.col("h") == F.col("e_h")).select("id", "at", "opens", "closes")


def _covered(n: int, spans: list[tuple[int, int]], width: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b + width] -= 1
    return np.cumsum(edge[:n]) > 0


def removals(found: DataFrame, marked: DataFrame, width: int) -> DataFrame:
    """what, n_removed, kept_sha256 and the digests of the spans, from texts and the marks in them."""
    per_text = marked.groupBy(F.col("id").alias("m_id")).agg(F.collect_list(F.struct("at", "opens", "closes")).alias("marks"))
    joined = found.select("id", "what", "text").join(per_text, F.col("id") == F.col("m_id")).select("what", "text", "marks")

    def run(batches):
        for batch in batches:
            out = []
            for what, text, marks in zip(*(batch.column(k) for k in range(3))):
                words, at = text.as_py().split(), sorted((m["at"], m["opens"], m["closes"]) for m in marks.as_py())
                spans = list(zip([a for a, opens, _ in at if opens], [a for a, _, closes in at if closes]))
                gone = _covered(len(words), spans, width)
                kept = b" ".join([w for w, g in zip(words, gone) if not g])
                out.append((what.as_py(), int(gone.sum()), hashlib.sha256(kept).hexdigest(), [digest(b" ".join(words[a : b + width])) for a, b in spans], [a for a, _ in spans], [b for _, b in spans]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, (pa.binary(), pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())))],
                names=["what", "n_removed", "kept_sha256", "spans", "froms", "tos"],
            )

    return joined.mapInArrow(run, "what binary, n_removed long, kept_sha256 string, spans array<binary>, froms array<int>, tos array<int>")


def verified(results: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """``results`` (a kept table); texts in which a span has no equal are done again without it."""
    each = results.select("what", F.explode(F.arrays_zip("spans", "froms", "tos")).alias("s")).select("what", "s.spans", "s.froms", "s.tos")
    single = keep(each.groupBy("spans").agg(F.count("*").alias("n"), F.min("what").alias("s_what")).filter("n = 1").select(F.col("spans").alias("s_span"), "s_what"), "single")
    wrong = single.select("s_what").distinct()
    fine = results.join(wrong, F.col("what") == F.col("s_what"), "left_anti")
    again = results.join(wrong, F.col("what") == F.col("s_what"), "left_semi").select("what", F.explode(F.arrays_zip("spans", "froms", "tos")).alias("s"))
    again = again.join(single.select("s_span"), F.col("s.spans") == F.col("s_span"), "left_anti")
    ids = found.select("id", F.col("what").alias("i_what"))
    rows = again.join(ids, F.col("what") == F.col("i_what"))
    begins = rows.select("id", F.col("s.froms").alias("at"), F.lit(True).alias("opens"), (F.col("s.froms") == F.col("s.tos")).alias("closes"))
    ends = rows.filter("s.froms <> s.tos").select("id", F.col("s.tos").alias("at"), F.lit(False).alias("opens"), F.lit(True).alias("closes"))
    return fine.unionByName(removals(found, begins.union(ends), width))


def deduplicated(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    scanned = scan(docs, lambda text: profile(text, width, seed), "words")
    found = suspects(docs, scanned, "words")
    results = keep(removals(found, marks(edges(found, width)), width), "removals")
    results = verified(results, found, width)
    nothing = hashlib.sha256(b"").hexdigest()
    out = spread(results, scanned, width, {"n_removed": (F.lit(0).cast("long"), F.col("size")), "kept_sha256": (F.col("whole"), F.lit(nothing))})
    return out.select("doc_id", F.col("size").alias("n_words"), "n_removed", "kept_sha256")
