"""Line deduplication by pairwise alignment.

An anchor is a line of at least ``MIN_WORDS`` words or, where lines are shorter, the shortest run of short
lines from one on that holds as many. Its j-th occurrence in a document is a token, so every token is
unique in its document, which is what patience diff needs. A token that one document has alone cannot
overlap; each of the others links its documents to the first that holds it, so even a line found
everywhere costs one link per document. A document and each of its partners are aligned on the tokens
that link them (longest increasing run of positions). Where that leaves tokens because the first holder
has them in another order, the document is also aligned with the first holder of every pair of consecutive
shared tokens, on all tokens both have: each order meets the earliest document that has it, again with
one link per pair and document. Each aligned anchor is
extended over equal neighbouring lines of any length, blank ones too, and the aligned lines go from the
later document. A text that equals an earlier document's loses every line, whatever its lines hold.

Scripts without blanks count a word for each 12 bytes beyond ASCII. Null texts are empty and have no
lines; they stay null. Rows without a doc_id are neither earlier nor later than others and stay whole.
Repeated rows of one id are treated alike. A document whose lines all go keeps an empty text.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import keep

MIN_WORDS = 5
ASCII = bytes(range(128))
PLACE = ("line", "before", "after")  # where a document has a token


def n_words(line: bytes, enough: int) -> int:
    """Words of a line; counting may stop at ``enough``."""
    words = line.split(None, enough - 1)
    if len(words) < enough and not line.isascii():
        return sum(max(1, len(w.translate(None, ASCII)) // 12) for w in words)
    return len(words)


def reach(words: list[int], k: int, step: int, min_words: int) -> int:
    """The line at which the lines from ``k`` on, forwards or backwards, hold ``min_words`` words, or the last one."""
    n, last = 0, len(words) - 1 if step > 0 else 0
    while (n := n + words[k]) < min_words and k != last:
        k += step
    return k


def anchors(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """First and last line of each anchor, in order; those of several lines hold short ones only."""
    out = []
    for k, n in enumerate(words):
        if n:
            end = reach(words, k, 1, min_words)
            if end == k and n >= min_words or end > k and words[end] < min_words and sum(words[k : end + 1]) >= min_words:
                out.append((k, end))
    return out


def tokens(text: bytes, min_words: int = MIN_WORDS) -> list[tuple[int, bytes, bytes, bytes]]:
    """Line number (from 0), 16-byte token and 8-byte hashes of the lines before and after, per anchor.

    Either side holds as many lines as have ``min_words`` words: where more of them are shared, they are or hold an
    anchor too. The last entry is for the whole text: less its number of lines, its token, and no neighbours.
    """
    import xxhash

    lines = text.split(b"\n")
    words = [n_words(line, min_words) for line in lines]
    marks = b"".join(map(xxhash.xxh64_digest, lines))
    seen: dict = defaultdict(int)
    out = []
    for k, end in anchors(words, min_words):
        what = b"\n".join(lines[k : end + 1])
        seen[what] += 1
        first = reach(words, k - 1, -1, min_words) if k else 0
        last = reach(words, k + 1, 1, min_words) if k + 1 < len(lines) else k
        token = hashlib.blake2b(what, digest_size=16, salt=seen[what].to_bytes(8, "little")).digest()
        out.append((k, token, marks[8 * first : 8 * k], marks[8 * k + 8 : 8 * last + 8]))
    if text.strip():
        out.append((-len(lines), hashlib.blake2b(text, digest_size=16, person=b"whole").digest(), b"", b""))
    return out


def patience(later: list[int], earlier: list[int]) -> list[int]:
    """Positions in ``later`` of a longest increasing run of ``earlier``, taken in the order of ``later``."""
    pairs = sorted(zip(later, earlier))
    tops, piles, back = [], [], []  # smallest last card per pile, its index, each card's predecessor
    for k, (_, card) in enumerate(pairs):
        pile = bisect.bisect_left(tops, card)
        back.append(piles[pile - 1] if pile else -1)
        tops[pile : pile + 1], piles[pile : pile + 1] = [card], [k]
    run, k = [], piles[-1] if piles else -1
    while k >= 0:
        run.append(pairs[k][0])
        k = back[k]
    return run[::-1]


def alike(a: bytes, b: bytes) -> int:
    """How many 8-byte hashes two sequences have in common at their start."""
    n = min(len(a), len(b)) // 8
    if a[: 8 * n] == b[: 8 * n]:
        return n
    return next(k for k in range(n) if a[8 * k : 8 * k + 8] != b[8 * k : 8 * k + 8])


def alike_at_end(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // 8
    if a[len(a) - 8 * n :] == b[len(b) - 8 * n :]:
        return n
    return next(k for k in range(n) if a[len(a) - 8 * k - 8 : len(a) - 8 * k] != b[len(b) - 8 * k - 8 : len(b) - 8 * k])


def aligned(links: list[dict]) -> set[int]:
    """Lines of the later document that are aligned with one partner; ``links`` are the tokens both hold."""
    for s in links:
        if s["line"] < 0:
            return set(range(-s["line"]))
    by = {(s["line"], s["partner_line"]): s for s in links}
    at = {line: partner_line for line, partner_line in sorted(by, reverse=True)}
    run = patience(*zip(*at.items()))
    gone, done, partner_done = set(), -1, -1  # the last lines aligned so far
    for n, k in enumerate(run):
        s, p = by[k, at[k]], at[k]
        back = min(alike_at_end(s["before"], s["partner_before"]), k - done - 1, p - partner_done - 1)
        room = min(run[n + 1] - k, at[run[n + 1]] - p) - 1 if n + 1 < len(run) else len(s["after"])
        on = min(alike(s["after"], s["partner_after"]), room)
        gone.update(range(k - max(0, back), k + on + 1))
        done, partner_done = max(done, k + on), max(partner_done, p + on)
    return gone


def kept_runs(removed: list[int]) -> list[dict]:
    """Runs of lines that stay, as 1-based (start, length); the last is open."""
    out, start = [], 0
    for k in sorted(set(removed)):
        if k > start:
            out.append({"start": start + 1, "length": k - start})
        start = k + 1
    return [*out, {"start": start + 1, "length": 2**31 - 2 - start}]


def cuts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, n_removed and the ``runs`` of lines that stay, for documents that lose some."""

    def split(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [tokens(t or b"", min_words) for t in part.column(2).to_pylist()]
                index = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
                values = [[x[k] for f in found for x in f] for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(index), part.column(1).take(index), pa.array(values[0], pa.int32()), *[pa.array(v, pa.binary()) for v in values[1:]]],
                    names=["doc_id", "text_hash", "line", "token", "before", "after"],
                )

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    lines = keep(rows.mapInArrow(split, "doc_id long, text_hash long, line int, token binary, before binary, after binary"), "lines")
    first = lines.groupBy(F.col("token").alias("of")).agg(F.min(F.struct("doc_id", *PLACE)).alias("first"), F.max("doc_id").alias("last"))
    first = first.filter("last > first.doc_id").select("of", F.col("first.doc_id").alias("partner"), *[F.col(f"first.{c}").alias(f"partner_{c}") for c in PLACE])
    held = keep(lines.join(first, F.col("token") == F.col("of")).drop("of"), "held")
    found = keep(alignments(held.filter("doc_id > partner").withColumn("again", F.lit(False))), "aligned")
    if found.filter("crossed").isEmpty():
        return found.drop("crossed")
    crossed = found.filter("crossed").select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")).distinct()
    todo = keep(held.join(crossed, (F.col("doc_id") == F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")), "left_semi"), "crossed")
    both = todo.filter("doc_id > partner").withColumn("again", F.lit(False)).unionByName(pair_links(held, todo).withColumn("again", F.lit(True)))
    return found.filter("NOT crossed").unionByName(alignments(both)).drop("crossed")


def pair_links(held: DataFrame, todo: DataFrame) -> DataFrame:
    """Rows of ``todo`` with their place in each earlier document that is the first to hold a pair of the document's consecutive tokens."""
    of_text = Window.partitionBy("doc_id", "text_hash").orderBy("line")
    distinct = held.filter("line >= 0").select("doc_id", "text_hash", "line", "token").distinct()
    pairs = distinct.withColumn("next", F.lead("token").over(of_text)).filter("next IS NOT NULL").select("doc_id", "text_hash", "token", "next")
    pairs = keep(pairs.select("doc_id", "text_hash", F.concat("token", "next").alias("pair")), "pairs")
    first = pairs.groupBy(F.col("pair").alias("of")).agg(F.min("doc_id").alias("partner"), F.max("doc_id").alias("last")).filter("last > partner").drop("last")
    ids = todo.select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash")).distinct()
    asked = pairs.join(ids, (F.col("doc_id") == F.col("t_id")) & (F.col("text_hash") == F.col("t_hash")), "left_semi")
    links = asked.join(first, F.col("pair") == F.col("of")).filter("doc_id > partner")
    links = keep(links.select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash"), F.col("partner").alias("other")).distinct(), "pair_links")
    own = todo.filter("line >= 0").select("doc_id", "text_hash", "token", *PLACE)
    own = own.join(links, (F.col("doc_id") == F.col("l_id")) & (F.col("text_hash") == F.col("l_hash"))).select("doc_id", "text_hash", "token", *PLACE, F.col("other").alias("partner"))
    others = held.filter("line >= 0").join(links.select("other").distinct(), F.col("doc_id") == F.col("other"), "left_semi")
    others = others.groupBy(F.col("doc_id").alias("o_id"), F.col("token").alias("o_token")).agg(F.min(F.struct(*PLACE)).alias("place"))
    others = others.select("o_id", "o_token", *[F.col(f"place.{c}").alias(f"partner_{c}") for c in PLACE])
    return own.join(others, (F.col("partner") == F.col("o_id")) & (F.col("token") == F.col("o_token"))).drop("o_id", "o_token")


def alignments(links: DataFrame) -> DataFrame:
    """Per document of ``links``: n_removed, ``runs``, and ``crossed``, whether a linked line stays; rows ``again`` are aligned apart from others."""
    per_doc = links.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("partner", "again", *PLACE, *[f"partner_{c}" for c in PLACE])).alias("shared"))

    def align(batches):
        for batch in batches:
            removed, runs, crossed = [], [], []
            for shared in (s for at in range(0, batch.num_rows, 50) for s in batch.column(2).slice(at, 50).to_pylist()):
                by = defaultdict(list)
                for s in shared:
                    by[s["partner"], s["again"]].append(s)
                gone = {k for links in by.values() for k in aligned(links)}
                removed.append(len(gone))
                runs.append(kept_runs(list(gone)))
                crossed.append(any(s["line"] >= 0 and s["line"] not in gone for s in shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(crossed, pa.bool_())],
                names=["doc_id", "text_hash", "n_removed", "runs", "crossed"],
            )

    return per_doc.mapInArrow(align, "doc_id long, text_hash long, n_removed long, runs array<struct<start:int,length:int>>, crossed boolean")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of ``docs`` with their columns, ``text`` without the lines that an earlier document holds, ``n_lines`` and ``n_removed``."""
    cut = cuts(docs, min_words).select(F.col("doc_id").alias("_cut_id"), F.col("text_hash").alias("_cut_hash"), F.col("n_removed").alias("_gone"), F.col("runs").alias("_runs"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    joined = rows.join(cut, (F.col("_id") == F.col("_cut_id")) & (F.col("_hash") == F.col("_cut_hash")), "left")
    lines = F.split("_row.text", "\n")
    left = F.array_join(F.flatten(F.transform("_runs", lambda r: F.slice(lines, r.start, r.length))), "\n")
    return joined.select(
        F.col("_row").withField("text", F.when(F.col("_runs").isNull(), F.col("_row.text")).otherwise(left)).alias("_row"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("_gone", F.lit(0)).cast("long").alias("n_removed"),
    )
