"""SimHash near-duplicates with bit-sliced comparison.

Two fingerprints within ``radius`` bits agree on all but ``radius`` of any ``radius + m`` blocks of bits,
so they share the key of some choice of m blocks. Fingerprints that share a key are compared
vertically: one bit plane holds one bit of all of them, carry-save counters add up the differing
bits of 64 pairs per machine word, and a fingerprint is abandoned once all its distances exceed the
radius. m grows with the number of fingerprints, so that key groups stay small; every m is exact.

A text without words has fingerprint zero and is linked like any other; null texts have no words.
Documents without an id have a fingerprint and a group, but name no group. Copies meet in one
fingerprint before anything is compared. Extra columns are ignored or carried along.

``grouped`` links by fingerprints alone. ``deduplicated`` links texts whose sets of word shingles have a
Jaccard similarity of ``SIMILARITY`` or more: such texts differ in ten bits of 64 on average, too many for
shared keys of bits, so texts meet under bands of smallest shingle hashes, are compared bit-sliced
within ``REACH`` bits there, and the shingle sets of every pair that is left decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import components, keep, same
from wellspring.llm.spans import prefix_hashes, slice_hashes

SHINGLE = 4
RADIUS = 4
BITS = 64
GROUP = 2000  # mean fingerprints per key aimed at
STEP = 1 << 16  # shingles of a text whose bits are counted at a time
CHUNK = 1024  # fingerprints of one key that are compared at a time
WORDS = 5  # words of a shingle where the similarity decides
SIMILARITY = 0.8  # least Jaccard similarity of near-duplicates
BANDS, ROWS = 18, 4  # of smallest hashes: two texts of that similarity share no band once in 13,000 times
DENSE = 4  # pairs per text from which a group is compared whole
BLOCK_BITS = 1 << 25  # cells of the bit sets that a task unpacks at once
REACH = 20  # bits; two texts of that similarity differ in 9.7 of 64, with a standard deviation of 2.9
_ORDERS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    import xxhash

    words = (text or b"").lower().split()  # bytes.lower() touches A-Z only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, ends, ones = np.concatenate([[0], ends[:-1] + 1])[:n], ends[-n:], np.zeros(BITS, np.int64)
    for at in range(0, n, STEP):
        some = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist())
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in some), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            fp = pa.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def near(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs (i, j), i != j, of positions in ``fps`` (uint64) at most ``radius`` bits apart."""
    n, lanes, levels = len(fps), -(-len(fps) // 64), max(2, radius.bit_length())
    if n < 16:  # no more than a quarter of a machine word to share
        apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
        np.fill_diagonal(apart, BITS + 1)
        return np.nonzero(apart <= radius)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.zeros((BITS, lanes * 64), np.uint8)
    planes[:, :n] = bits.T
    mixed = np.flatnonzero(planes[:, :n].min(1) != planes[:, :n].max(1))  # planes on which all agree add nothing
    own = np.zeros((n, lanes * 64), np.uint8)  # pairs that do not count: with itself and with padding
    own[:, n:] = 1
    own[np.arange(n), np.arange(n)] = 1
    pack = lambda a: np.packbits(a, axis=-1, bitorder="little").view(np.uint64)
    sliced, over = pack(planes), pack(own)
    flip = np.where(bits, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    rows = np.arange(n)
    c = [np.zeros((n, lanes), np.uint64) for _ in range(levels)]  # the distance's bits 1, 2, 4 ...; `over` is all beyond

    def exceeded() -> np.ndarray:
        out, equal = over.copy(), ~over
        for k in range(levels)[::-1]:  # compare the counters with the radius from the top bit down
            if radius >> k & 1:
                equal &= c[k]
            else:
                out |= equal & c[k]
                equal &= ~c[k]
        return out

    for step, at in enumerate(range(0, len(mixed), 3)):
        x = [sliced[b][None, :] ^ flip[rows, b][:, None] for b in mixed[at : at + 3]]
        while len(x) < 3:
            x.append(np.zeros_like(over))
        either = x[0] ^ x[1]
        ones, twos = either ^ x[2], (x[0] & x[1]) | (either & x[2])  # carry-save: three bits become two
        carry = c[0] & ones
        c[0] ^= ones
        both = twos ^ carry
        carry = (twos & carry) | (both & c[1])
        c[1] ^= both
        for k in range(2, levels):
            c[k], carry = c[k] ^ carry, c[k] & carry
        over |= carry
        if step % 3 == 2 and step > 3:
            alive = np.flatnonzero((exceeded() != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1))
            if not len(alive):
                return alive, alive
            if 2 * len(alive) < len(rows):
                rows, over, c = rows[alive], over[alive], [k[alive] for k in c]
    hit = np.unpackbits((~exceeded()).view(np.uint8), axis=1, bitorder="little")
    i, j = np.nonzero(hit)
    return rows[i], j


def stars(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is near in ``fps``: each fingerprint to the smallest of its component here."""
    fps = np.unique(fps)
    i, j = near(fps, radius)
    label = np.arange(len(fps))
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def links(unique: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all of ``unique`` (fp; a kept table without repeats) within ``radius`` bits."""
    n, m = unique.count(), 1
    while n > GROUP << (BITS // (radius + m) * m) and m < 8:
        m += 1
    edges = np.linspace(0, BITS, radius + m + 1).astype(int)
    masks = [sum(((1 << int(b - a)) - 1) << int(a) for a, b in c) for c in combinations(list(zip(edges, edges[1:])), m)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(x)))) for k, x in enumerate(masks)]))

    def compare(f):
        a, b = stars(f.view(np.uint64), radius)
        return a.view(np.int64), b.view(np.int64)

    return compared(unique.select("fp", keys.alias("key")), ["fp"], compare).select("a", "b")


def compared(keyed: DataFrame, columns: list[str], compare: Callable) -> DataFrame:
    """(a, b, g): what ``compare`` finds in the rows of each key, or chunk pair of a large key, with a hash ``g`` of it;
    ``compare`` takes arrays of the long ``columns``, the first of which tells rows apart."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("of"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    parted = keyed.join(sizes, F.col("key") == F.col("of")).withColumn("chunk", F.pmod(F.xxhash64(columns[0], F.lit(3)), F.col("chunks")).cast("int"))
    # a key with more than a chunk of fingerprints: chunk by chunk, each pair of chunks in a group of its own
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    groups = parted.withColumn("other", other).select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("g"), *columns)

    def run(batches):
        held = [np.empty(0, np.int64) for _ in range(len(columns) + 1)]

        def found(g, *values):
            at = np.flatnonzero(np.diff(g)) + 1
            parts = zip(np.split(g, at), *(np.split(v, at) for v in values))
            pairs = [(*compare(*part), name) for name, *part in parts if len(name) > 1]
            a, b = (np.concatenate([x[k] for x in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1))
            of = np.concatenate([np.full(len(x[0]), x[2][0]) for x in pairs]) if pairs else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(of)], names=["a", "b", "g"])

        for batch in batches:
            rows = [np.concatenate([h, np.asarray(batch.column(k))]) for k, h in enumerate(held)]
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last group may go on in the next batch
            held = [r[last:] for r in rows]
            yield found(*(r[:last] for r in rows))
        yield found(*held)

    return groups.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long, g long")


def grouped(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every document."""
    marked = keep(fingerprints(docs, width), "fingerprints")
    unique = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "unique")
    roots = keep(components(links(unique.select("fp"), radius)), "roots")
    of = unique.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = of.groupBy(F.col("root").alias("of_root")).agg(F.min("first").alias("component_id"))
    named = of.join(lowest, F.col("root") == F.col("of_root")).select(F.col("fp").alias("of_fp"), "component_id")
    return marked.join(named, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")


def shingles(text: bytes | None, width: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different word shingles of a text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    h = slice_hashes(prefix_hashes(joined), starts[:n], ends[-n:])
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def sketch(h: np.ndarray) -> tuple[int, list[int]]:
    """Fingerprint and bands of a set of shingle hashes; a set without any has no bands."""
    if not len(h):
        return 0, []
    ones, low = np.zeros(BITS, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        np.minimum(low, (part[:, None] * _ORDERS).min(axis=0), out=low)
    band = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        band = (band ^ row) * np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]), band.view(np.int64).tolist()


def sketches(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, ``text_hash``, ``what`` (a hash of its shingle set), ``n`` shingles, ``fp`` and ``bands``."""

    def run(batches):
        import xxhash

        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(2).to_pylist()]
            fp, bands = zip(*map(sketch, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)),
                    pa.array([len(h) for h in sets], pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "what", "n", "fp", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, what long, n long, fp long, bands array<long>")


def _close(what, fp, n, root, similarity):
    """Positions of pairs of different roots within ``REACH`` bits whose sizes allow the similarity, both ways round."""
    if not (root != root[0]).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = near(fp.view(np.uint64), REACH)
    fits = (root[i] != root[j]) & (np.minimum(n[i], n[j]) / np.maximum(n[i], n[j]) >= similarity)
    return i[fits], j[fits]


def candidates(rows: DataFrame, step: str, similarity: float) -> DataFrame:
    """(a, b, g): pairs of ``rows`` (what, fp, n, root, bands) of different roots that share a band and lie within ``REACH`` bits.

    Step ``hub`` takes each text's smallest partner in a band, ``nearest`` its nearest one, ``all`` every one. Where
    step ``all`` would give more than DENSE pairs per text of a group, the group's texts come instead, as (text, text, g): such a
    group is compared whole by ``within``, and no pair of it is written.
    """

    def compare(what, fp, n, root):
        i, j = _close(what, fp, n, root, similarity)
        if step == "all":
            members = np.unique(i)
            if len(i) > 2 * DENSE * len(members):
                return what[members], what[members]
        elif len(i):
            far = np.bitwise_count(fp[i] ^ fp[j]) if step == "nearest" else np.zeros(len(i), np.uint8)
            order = np.lexsort((what[j], far, i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            i, j = i[first], j[first]
        return np.minimum(what[i], what[j]), np.maximum(what[i], what[j])

    keyed = rows.select("what", "fp", "n", "root", F.explode("bands").alias("key"))
    return compared(keyed, ["what", "fp", "n", "root"], compare)


def common_counts(owner: np.ndarray, value: np.ndarray, i: np.ndarray, j: np.ndarray, rows: int) -> np.ndarray:
    """Number of values that rows i and j share, for each pair; row ``owner[k]`` holds ``value[k]``, each once. Bit sets, BLOCK_BITS values at a time."""
    _, code = np.unique(value, return_inverse=True)
    out = np.zeros(len(i), np.int64)
    step = max(64, BLOCK_BITS // max(rows, 1) // 64 * 64)
    for lo in range(0, int(code.max(initial=-1)) + 1, step):
        at = (code >= lo) & (code < lo + step)
        flags = np.zeros((rows, min(step, int(code.max()) + 1 - lo)), bool)
        flags[owner[at], code[at] - lo] = True
        bits = np.packbits(np.pad(flags, ((0, 0), (0, -flags.shape[1] % 64))), axis=1).view(np.uint64)
        for k in range(0, len(i), 4096):
            out[k : k + 4096] += np.bitwise_count(bits[i[k : k + 4096]] & bits[j[k : k + 4096]]).sum(axis=1, dtype=np.int64)
    return out


def within(dense: DataFrame, rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect the similar texts of every group of ``dense`` (what, g), one per text at most.

    A group is a band's texts, or two chunks of them; all its close pairs are checked on the exact shingle sets, inside its task.
    """
    held = rows.select("what", "fp", "n", "root").join(sets, "what")

    def check(table: pa.Table) -> pa.Table:
        what, fp, n, root = (table.column(c).to_numpy() for c in ("what", "fp", "n", "root"))
        i, j = _close(what, fp, n, root, similarity)
        i, j = i[i < j], j[i < j]
        hs = table.column("hs").combine_chunks()
        size = hs.value_lengths().to_numpy()
        common = common_counts(np.repeat(np.arange(len(what)), size), hs.flatten().to_numpy(), i, j, len(what))
        same = common / (size[i] + size[j] - common) >= similarity
        i, j = np.concatenate([i[same], j[same]]), np.concatenate([j[same], i[same]])
        label = np.argsort(np.argsort(what))  # each text starts as its own group; a group's name is its smallest text
        names = np.sort(what)
        while len(i):
            new = label.copy()
            np.minimum.at(new, i, label[j])
            if (new == label).all():
                break
            label = new
        moved = names[label] != what
        return pa.table({"a": pa.array(names[label][moved], pa.int64()), "b": pa.array(what[moved], pa.int64())})

    return dense.join(held, "what").groupBy("g").applyInArrow(check, "a long, b long")


def shingle_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(what, hs): shingle hashes of the texts in ``pairs``, each read from one row of ``docs``."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("asked")).distinct()
    holders = classes.join(asked, F.col("what") == F.col("asked")).select("what", F.col("first.doc_id").alias("h_id"), F.col("first.text_hash").alias("h_hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(holders, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("hash") == F.col("h_hash"))).select("what", "text").dropDuplicates(["what"])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                sets = [shingles(t, width).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["what", "hs"])

    return texts.mapInArrow(run, "what long, hs array<long>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` have the exact Jaccard similarity."""
    left, right = (sets.select(F.col("what").alias(f"{x}_what"), F.col("hs").alias(f"{x}_hs")) for x in "ab")
    both = pairs.join(left, F.col("a") == F.col("a_what")).join(right, F.col("b") == F.col("b_what"))
    both = both.select("a", "b", F.size(F.array_intersect("a_hs", "b_hs")).alias("common"), (F.size("a_hs") + F.size("b_hs")).alias("sizes"))
    return both.filter(F.col("common") / (F.col("sizes") - F.col("common")) >= F.lit(similarity)).select("a", "b")


def joined(docs: DataFrame, classes: DataFrame, width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): the groups that similar texts of ``classes`` form, for texts with a similar one.

    Two steps check a few pairs per text and join most of a large group of near copies; the last checks
    every pair whose texts are not yet in one group, so no link between groups is lost.
    """
    rows = classes.withColumn("root", F.col("what"))
    pairs = keep(candidates(rows, "hub", similarity).select("a", "b").distinct(), "candidates")
    sets = keep(shingle_sets(docs, classes, pairs, width), "sets")  # a text without a pair here has none later
    links = keep(similar(pairs, sets, similarity), "similar")
    some = keep(classes.join(sets.select(F.col("what").alias("some")), F.col("what") == F.col("some"), "left_semi"), "some")
    for step in ("nearest", "all"):
        roots = keep(components(links), "roots")
        rows = some.join(roots, F.col("what") == F.col("node"), "left").withColumn("root", F.coalesce("root", "what"))
        found = keep(candidates(rows, step, similarity).distinct(), "candidates")
        pairs, dense = found.filter("a <> b").select("a", "b").distinct(), found.filter("a = b").select(F.col("a").alias("what"), "g")
        links = links.union(similar(pairs, sets, similarity))
        links = keep(links.union(within(dense, rows, sets, similarity)) if step == "all" else links, "similar")
    return components(links)


def deduplicated(docs: DataFrame, width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per group of near-duplicates, that of its smallest doc_id, with all columns of ``docs``.

    Groups are what pairs of that Jaccard similarity reach; texts with the same shingles are one. Texts without
    words are a group. Rows without an id stay only where no row of their group has one. Of repeated rows one stays.
    """
    marked = keep(sketches(docs, width), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    classes = keep(marked.groupBy("what").agg(F.min(order).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "bands")]), "classes")
    roots = keep(joined(docs, classes, width, similarity), "roots")
    of = classes.join(roots, F.col("what") == F.col("node"), "left").select("first", F.coalesce("root", "what").alias("root"))
    stay = of.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("s_id"), F.col("first.text_hash").alias("s_hash"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    held = rows.join(stay, F.col("_id").eqNullSafe(F.col("s_id")) & (F.col("_hash") == F.col("s_hash")), "left_semi")
    return held.dropDuplicates(["_id", "_hash"]).select("_row.*")
