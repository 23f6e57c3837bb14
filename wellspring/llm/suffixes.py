"""Suffix-array dedup: a sparse suffix array built by a distributed merge sort that knows common prefixes.

Every string of ``least`` bytes holds an anchor, a position whose next SEED bytes have the smallest
hash for some window around it, and equal strings hold equal anchors. Suffixes are sorted at anchors
whose seed occurs twice; an anchor's record is its seed with the bytes after it (``right``) and the
bytes before it, reversed (``left``). Records are sorted in two orders, right before left and left
before right. Tasks exchange sorted runs that are front-coded (length of the prefix shared with the
previous record, then the rest), and a loser tree merges them, comparing two records only from the
first byte that is not yet known to be shared. Neighbours in the merged order give each anchor its longest match
on one side, and their other side is compared directly: a match of L bytes before and R bytes after the
anchor, L + R >= least, is a repeated string. What both orders leave open (L from one neighbour and
R from another would suffice) is settled by grouping the windows in question.

A seed's records meet in one task; seeds with more than ``group`` records are split by range, and the
records at both sides of a cut are compared afterwards. Null texts are empty. Repeated rows and rows
without doc_id are treated by their text. Texts shorter than ``least`` bytes have nothing removed.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import keep
from wellspring.llm.spans import digest, prefix_hashes, scan, slice_hashes, sliding, spread, suspects

LEAST = 400
SEED = 32
GROUP = 25_000  # records of one seed that a task sorts; mean records of a task
PAD = b"\xff"  # not a byte of UTF-8: stands for what lies beyond a text's ends
RIGHT, LEFT = 0, 1  # the two orders


def profile(text: bytes, least: int, seed: int) -> tuple:
    """Anchors: (hash, position, position)."""
    if len(text) < least:
        return text, len(text), *[np.empty(0, np.int64)] * 3
    prefix, n = prefix_hashes(text), len(text) - seed + 1
    at = np.arange(n)
    h = slice_hashes(prefix, at, at + seed)
    reach = least - seed + 1
    low = sliding(np.minimum, h, reach)
    rim = np.zeros(reach - 1, np.uint64)
    p = np.flatnonzero(h == sliding(np.maximum, np.concatenate([rim, low, rim]), reach))  # smallest of some window
    p = p[~_periodic(p, h[p], least, seed)]
    return text, len(text), h[p].view(np.int64), p, p


def _periodic(p: np.ndarray, h: np.ndarray, least: int, seed: int) -> np.ndarray:
    """Anchors that a long periodic stretch can do without.

    Equal seeds that overlap at a constant distance make the text between them periodic. Every window
    inside so long a stretch repeats within it, and an anchor amid it matches whatever repeats part of
    it elsewhere. So its two first and two last anchors are enough, with some no further apart than two thirds of a window.
    """
    drop, gap = np.zeros(len(p), bool), np.diff(p)
    gap = np.where((h[1:] == h[:-1]) & (gap <= seed), gap, 0)
    cut = np.flatnonzero(np.concatenate([[True], gap[1:] != gap[:-1], [True]])) if len(gap) else []
    for a, b in zip(cut[:-1], cut[1:]):  # anchors a..b are gap[a] apart
        if gap[a] and p[b] - p[a] >= 5 * least:
            step = (p[a : b + 1] - p[a]) // max(1, (least - seed) * 2 // 3)
            drop[a + 2 : b - 1] = (step[1:] == step[:-1])[1:-2]
    return drop


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that share their first ``start`` bytes."""
    end = min(len(a), len(b))
    step = 8
    while start < end:
        if a[start : start + step] == b[start : start + step]:
            start, step = min(end, start + step), step * 4
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return start


def record(text: bytes, p: int, order: int, least: int, seed: int) -> bytes:
    side = least - seed
    right = text[p + seed : p + least].ljust(side, PAD)
    left = text[max(0, p - side) : p][::-1].ljust(side, PAD)
    return text[p : p + seed] + (right + left if order == RIGHT else left + right)


def fronted(records: list[tuple[bytes, int, int]]) -> tuple[int, bytes, bytes, bytes, bytes]:
    """A run as (number, shared lengths, ids, positions, rests), sorted."""
    records.sort()
    shared = [0, *(common(a[0], b[0]) for a, b in zip(records, records[1:]))]
    return (
        len(records), np.array(shared, "<u2").tobytes(), np.array([r[1] for r in records], "<i8").tobytes(),
        np.array([r[2] for r in records], "<i4").tobytes(), b"".join([r[0][s:] for r, s in zip(records, shared)]),
    )


def unfronted(run: tuple, width: int) -> Iterator[tuple[bytes, int, tuple[int, int]]]:
    """(record, length shared with the one before, (id, position)) of a run, in order."""
    _, shared, ids, places, rests = run
    key, at = b"", 0
    for s, i, p in zip(np.frombuffer(shared, "<u2").tolist(), np.frombuffer(ids, "<i8").tolist(), np.frombuffer(places, "<i4").tolist()):
        key = key[:s] + rests[at : at + width - s]
        at += width - s
        yield key, s, (i, p)


def merged(runs: list[Iterator]) -> Iterator[tuple[bytes, int, tuple[int, int]]]:
    """Records of all runs in order, each with the length it shares with the one before.

    A loser tree. Each waiting record knows how much it shares with the last record put out, or with
    the one that beat it. Of two, the one that shares more is smaller, unseen; only if both share equally
    are bytes compared, and from there on.
    """
    n = 1
    while n < len(runs):
        n *= 2
    runs = runs + [iter(())] * (n - len(runs))
    heads = [next(r, None) for r in runs]
    keys, shared = [h and h[0] for h in heads], [0] * n
    losers = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        ka, kb = keys[a], keys[b]
        if kb is None:
            return a, b
        if ka is None or shared[b] > shared[a]:
            return b, a
        if shared[a] > shared[b]:
            return a, b
        same = common(ka, kb, shared[a])
        if same < len(ka) and ka[same] > kb[same]:
            a, b = b, a
        shared[b] = same
        return a, b

    def first(node: int) -> int:
        if node >= n:
            return node - n
        winner, losers[node] = play(first(2 * node), first(2 * node + 1))
        return winner

    winner = first(1) if n > 1 else 0
    while keys[winner] is not None:
        yield keys[winner], shared[winner], heads[winner][2]
        heads[winner] = head = next(runs[winner], None)
        keys[winner], shared[winner] = (head[0], head[1]) if head else (None, 0)
        node = (winner + n) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def match(a: bytes, b: bytes, shared: int, order: int, least: int, seed: int) -> tuple[int, int]:
    """(left, right) lengths of the match around two anchors whose records share ``shared`` bytes."""
    if shared < seed:
        return 0, 0
    side = least - seed
    first = min(shared - seed, side)
    second = shared - seed - side if first == side else common(a[seed + side :], b[seed + side :])
    # both may go on over padding, but only where both texts end at the same distance
    for k, at in ((0, seed), (1, seed + side)):
        length = (first, second)[k]
        cut = a.find(PAD, at, at + length)
        if cut >= 0:
            first, second = (cut - at, second) if k == 0 else (first, cut - at)
    left, right = (second, first) if order == RIGHT else (first, second)
    return left, right + seed


MATCHED = "ord int, seed long, part long, id long, at int, left0 int, right0 int, left1 int, right1 int, head binary, tail binary"


def neighbours(runs: pd.DataFrame, least: int, seed: int) -> pd.DataFrame:
    """Each record's matches with the records before (0) and after (1); the ends of a split seed keep their bytes."""
    order, part = int(runs["ord"].iloc[0]), int(runs["part"].iloc[0])
    width, cut = 2 * least - seed, bool(runs["cut"].iloc[0])
    streams = [unfronted(r, width) for r in zip(runs["n"], runs["shared"], runs["ids"], runs["places"], runs["rests"])]
    ids, places, groups, lefts, rights, first, before, group = [], [], [], [], [], None, None, 0
    for key, shared, (i, p) in merged(streams):
        left, right = match(before, key, shared, order, least, seed) if before else (0, 0)
        if not before or shared < seed:
            group = int.from_bytes(digest(key[:seed])[:8], "little", signed=True)
        ids.append(i)
        places.append(p)
        groups.append(group)
        lefts.append(left)
        rights.append(right)
        first, before = first or key, key
    n = len(ids)
    left, right = np.array([*lefts, 0], np.int32), np.array([*rights, 0], np.int32)
    head, tail = [None] * n, [None] * n
    if cut and n:
        head[0], tail[-1] = first, before
    cols = (np.full(n, order, np.int32), np.array(groups, np.int64), np.full(n, part, np.int64), np.array(ids, np.int64), np.array(places, np.int32))
    cols = (*cols, left[:n], right[:n], left[1:], right[1:], pd.Series(head, dtype=object), pd.Series(tail, dtype=object))
    return pd.DataFrame(dict(zip((c.split()[0] for c in MATCHED.split(", ")), cols)))


def sorted_runs(found: DataFrame, hot: dict, buckets: int, least: int, seed: int) -> DataFrame:
    """Front-coded runs by (ord, part). ``hot``: for split seeds, {(hash, order): sorted first records of the parts}."""

    def run(batches):
        held, n = defaultdict(list), 0

        def flush():
            rows = [(order, part, cut, *fronted(records)) for (order, part, cut), records in held.items()]
            held.clear()
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["ord", "part", "cut", "n", "shared", "ids", "places", "rests"])

        for batch in batches:
            for ident, text, places in zip(*(batch.column(k) for k in range(3))):
                ident, text = ident.as_py(), text.as_py()
                hashes, starts = (places.values.field(k).to_pylist() for k in ("hash", "start"))
                for h, p in set(zip(hashes, starts)):
                    for order in (RIGHT, LEFT):
                        key, part, cut = record(text, p, order, least, seed), h % buckets, (h, order) in hot
                        if cut:
                            part = -1 - ((h & 0xFFFFFFFFFF) << 20 | bisect.bisect_right(hot[h, order], key))
                        held[order, part, cut].append((key, ident, p))
                        n += 1
                if n >= 40_000:
                    yield flush()
                    n = 0
        yield flush()

    kinds = "ord int, part long, cut boolean, n int, shared binary, ids binary, places binary, rests binary"
    return found.select("id", "text", "places").mapInArrow(run, kinds)


def cuts(found: DataFrame, places: DataFrame, group: int, least: int, seed: int) -> dict:
    """Where seeds with more than ``group`` records are cut: a record per ``group`` of them, by order."""
    big = {r["hash"]: r["n"] for r in places.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > group).collect()}
    if not big:
        return {}

    def run(batches):
        for batch in batches:
            for ident, text, held in zip(*(batch.column(k).to_pylist() for k in range(3))):
                out = []
                for x in held:
                    n = big.get(x["hash"], 0)
                    if n and int.from_bytes(digest(b"%d %d" % (ident, x["start"]))[:4], "little") * n < 16 * math.ceil(n / group) << 32:
                        out += [(x["hash"], order, record(text, x["start"], order, least, seed)) for order in (RIGHT, LEFT)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["hash", "ord", "key"])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        keys, pieces = sorted(frame["key"]), math.ceil(big[int(frame["hash"].iloc[0])] / group)
        return pd.DataFrame({"hash": frame["hash"].iloc[:1], "ord": frame["ord"].iloc[:1], "keys": [sorted({keys[len(keys) * k // pieces] for k in range(1, pieces)})]})

    sampled = found.select("id", "text", "places").mapInArrow(run, "hash long, ord int, key binary").groupBy("hash", "ord")
    return {(r["hash"], r["ord"]): [bytes(k) for k in r["keys"]] for r in sampled.applyInPandas(choose, "hash long, ord int, keys array<binary>").collect()}


def across(matched: DataFrame, least: int, seed: int) -> DataFrame:
    """Matches (id, at, left, right, seed, ord) of records on both sides of a cut."""
    rim = matched.filter("head IS NOT NULL OR tail IS NOT NULL")
    ends = rim.groupBy("ord", "seed", "part").agg(
        F.max(F.when(F.col("head").isNotNull(), F.struct("head", "id", "at"))).alias("first"), F.max(F.when(F.col("tail").isNotNull(), F.struct("tail", "id", "at"))).alias("last")
    )
    # parts of a seed count down; the piece before is the last one that has records
    before = F.lag("last").over(Window.partitionBy("ord", "seed").orderBy(F.desc("part")))

    def run(frames):
        for f in frames:
            out = []
            for o, s, a, b in zip(f["ord"], f["seed"], f["last"], f["first"]):
                left, right = match(bytes(a["tail"]), bytes(b["head"]), common(bytes(a["tail"]), bytes(b["head"])), int(o), least, seed)
                out += [(x["id"], x["at"], left, right, s, o) for x in (a, b)]
            yield pd.DataFrame(out, columns=["id", "at", "left", "right", "seed", "ord"])

    pairs = ends.withColumn("before", before).filter("before IS NOT NULL").select("ord", "seed", F.col("before").alias("last"), "first")
    return pairs.mapInPandas(run, "id long, at int, left int, right int, seed long, ord int")


MATCHES = 20_000  # records whose matches a task works on at once, if of more than one text
FOUND = ("at", "ord", "seed", "left0", "right0", "left1", "right1")
FAR = 1 << 32  # beyond any place in a text: sets texts, and anchors, apart in one sorted array


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [a, b) as ascending ranges that do not touch."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    opens = np.concatenate([[True], a[1:] > b[:-1]])[: len(a)]
    return a[opens], b[np.concatenate([opens[1:], [True]])[: len(a)]]


def unsettled(anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What no [lo, hi] of an anchor holds of its [first, last]: (anchor, from, to)."""
    order = np.lexsort((lo, anchor))
    anchor, lo, hi = anchor[order], lo[order], hi[order]
    reached = np.maximum.accumulate(anchor * FAR + hi + 1)
    before = np.maximum(first[anchor], np.concatenate([[-1], reached[:-1]])[: len(anchor)] - anchor * FAR)
    gap = (lo > before) & (before <= last[anchor])
    end = first.copy()
    np.maximum.at(end, anchor, hi + 1)
    rest = np.flatnonzero(end <= last)
    until = np.minimum(last[anchor], lo - 1)
    return np.concatenate([anchor[gap], rest]), np.concatenate([before[gap], end[rest]]), np.concatenate([until[gap], last[rest]])


def settled(batch: pa.RecordBatch, least: int, seed: int) -> pa.RecordBatch:
    n, found = batch.num_rows, batch.column(1)
    at, order, seeds, *sides = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in found.flatten().flatten())
    base = np.repeat(np.arange(n), found.value_lengths().to_numpy(zero_copy_only=False)) * FAR
    by = np.argsort(base + at, kind="stable")
    place, order, seeds, left0, right0, left1, right1 = (x[by] for x in (base + at, order, seeds, *sides))
    # the union of the ranges, to tell which windows are covered anyway
    ranges = [(np.flatnonzero(a + b >= least), a, b) for a, b in ((left0, right0), (left1, right1))]
    froms, tos = united(*(np.concatenate(x) for x in ([place[k] - a[k] for k, a, _ in ranges], [place[k] + b[k] for k, _, b in ranges])))
    # per anchor, how far the best match of either order reaches
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
    anchor = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(place))))
    best = lambda one, two, o: np.maximum.reduceat(np.where(order == o, np.maximum(one, two), 0), starts) if len(starts) else starts
    first, last = np.maximum(0, least - best(right0, right1, RIGHT)), np.minimum(best(left0, left1, LEFT), least - seed)
    who, fewest, most = unsettled(*(np.concatenate(x) for x in ([anchor[k] for k, _, _ in ranges], [least - b[k] for k, _, b in ranges], [a[k] for k, a, _ in ranges])), first, last)
    p = place[starts[who]]
    held = np.searchsorted(froms, p - most, "right") - 1
    left = np.ones(len(who), bool)
    left[held >= 0] = (tos[held] < p - fewest + least)[held >= 0] if len(tos) else True
    who, fewest, most, p = who[left], fewest[left], most[left], p[left]
    by = np.argsort(p, kind="stable")
    ends = lambda x: pa.array(np.searchsorted(x, np.arange(n + 1) * FAR), pa.int32())
    lists = lambda x: pa.ListArray.from_arrays(ends(froms), pa.array(x % FAR, pa.int32()))
    cols = [pa.array(seeds[starts[who]][by], pa.int64()), *(pa.array(x[by], pa.int32()) for x in (p % FAR, fewest, most))]
    rest = pa.ListArray.from_arrays(ends(p[by]), pa.StructArray.from_arrays(cols, ["seed", "at", "fewest", "most"]))
    return pa.RecordBatch.from_arrays([batch.column(0), lists(froms), lists(tos), rest], names=["id", "froms", "tos", "open"])


def settle(per_text: DataFrame, least: int, seed: int) -> DataFrame:
    """Per text: the byte ranges that matches cover, and what stays open: (seed, anchor, fewest, most bytes before it).

    ``found`` lists a text's records with the matches on both their sides: structs of FOUND."""

    def run(batches):
        for batch in batches:
            ends, k = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)), 0
            while k < batch.num_rows:
                till = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + MATCHES, "right")))
                yield settled(batch.slice(k, till - k), least, seed)
                k = till

    return per_text.mapInArrow(run, "id long, froms array<int>, tos array<int>, open array<struct<seed:bigint,at:int,fewest:int,most:int>>")


def windows(found: DataFrame, matched: DataFrame, still: DataFrame, least: int) -> DataFrame:
    """Byte ranges (id, froms, tos) of the windows in question that occur twice, for every anchor of the seeds ``still`` open."""
    span = still.groupBy("seed").agg(F.min("fewest").alias("fewest"), F.max("most").alias("most")).withColumnRenamed("seed", "s_seed")
    asked = matched.select("seed", "id", "at").distinct().join(span, F.col("seed") == F.col("s_seed"))
    asked = asked.groupBy(F.col("id").alias("a_id")).agg(F.collect_list(F.struct("at", "fewest", "most")).alias("asked"))

    def run(batches):
        for batch in batches:
            for ident, text, asked in zip(*(batch.column(k) for k in range(3))):
                ident, text = ident.as_py(), text.as_py()
                starts = sorted({m["at"] - o for m in asked.as_py() for o in range(m["fewest"], m["most"] + 1)})
                starts = [x for x in starts if 0 <= x <= len(text) - least]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ident] * len(starts), pa.int64()), pa.array(starts, pa.int32()), pa.array([digest(text[x : x + least]) for x in starts], pa.binary())], names=["id", "start", "what"]
                )

    texts = found.select("id", "text").join(asked, F.col("id") == F.col("a_id")).select("id", "text", "asked")
    each = keep(texts.mapInArrow(run, "id long, start int, what binary"), "windows")
    twice = each.groupBy(F.col("what").alias("t_what")).agg(F.count("*").alias("n")).filter("n > 1")
    return each.join(twice, F.col("what") == F.col("t_what")).groupBy("id").agg(F.collect_list("start").alias("froms")).select("id", "froms", F.transform("froms", lambda x: x + F.lit(least)).alias("tos"))


def deduplicated(docs: DataFrame, least: int = LEAST, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    scanned = scan(docs, lambda text: profile(text, least, seed), "bytes")
    found = suspects(docs, scanned, "bytes")
    places = found.select("id", F.explode("places").alias("p")).select("id", "p.*")
    hot, buckets = cuts(found, places, group, least, seed), max(1, math.ceil(places.count() / group))
    runs = sorted_runs(found, hot, buckets, least, seed)
    matched = keep(runs.groupBy("ord", "part").applyInPandas(lambda f: neighbours(f, least, seed), MATCHED), "matched")
    matches = matched.select("id", F.struct(*FOUND).alias("m"))
    if hot:
        none = F.lit(0)
        one_side = F.struct("at", "ord", "seed", F.col("left").alias("left0"), F.col("right").alias("right0"), none.alias("left1"), none.alias("right1"))
        matches = matches.union(across(matched, least, seed).select("id", one_side.alias("m")))
    covered = keep(settle(matches.groupBy("id").agg(F.collect_list("m").alias("found")), least, seed), "covered")
    still = covered.select("id", F.explode("open").alias("o")).select("o.*")
    ranges = covered.select("id", "froms", "tos").filter("size(froms) > 0")
    if not still.isEmpty():
        ranges = ranges.union(windows(found, matched, still, least))

    ranges = ranges.groupBy(F.col("id").alias("r_id")).agg(F.flatten(F.collect_list("froms")).alias("froms"), F.flatten(F.collect_list("tos")).alias("tos"))

    def run(batches):
        for batch in batches:
            out = []
            for what, text, froms, tos in zip(*(batch.column(k) for k in range(4))):
                text, kept, at, gone, spans = text.as_py(), [], 0, 0, 0
                merged_spans = []
                for a, b in sorted(zip(froms.as_py(), tos.as_py())):
                    if merged_spans and a <= merged_spans[-1][1]:
                        merged_spans[-1][1] = max(b, merged_spans[-1][1])
                    else:
                        merged_spans.append([a, b])
                for a, b in merged_spans:
                    kept.append(text[at:a])
                    at, gone, spans = b, gone + b - a, spans + 1
                kept.append(text[at:])
                out.append((what.as_py(), gone, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["what", "n_removed", "n_spans", "kept_sha256"])

    joined = found.select("id", "what", "text").join(ranges, F.col("id") == F.col("r_id")).select("what", "text", "froms", "tos")
    results = joined.mapInArrow(run, "what binary, n_removed long, n_spans long, kept_sha256 string")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    out = spread(results, scanned, least, {"n_removed": (zero, F.col("size")), "n_spans": (zero, one), "kept_sha256": (F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest()))})
    return out.select("doc_id", F.col("size").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
