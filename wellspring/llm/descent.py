"""Near-duplicate vectors by NN-descent, within labels.

Vectors that are equal become one node. Random-hyperplane trees deal nodes into leaves and give every node
its first neighbours; then rounds of neighbours-of-neighbours joins compare all pairs that meet around
a common neighbour and keep each node's LIST nearest. A list that is full of neighbours above the threshold is saturated: the
whole linked component around it is then compared block by block, where ranges of the angle to a pivot
and balls around block centres settle many block pairs without a product. A sample of nodes is
compared with all others; while too few of its links are found, more trees and rounds follow.

Vectors that are null, zero or hold null or non-finite components, and rows without label, link with
nothing; vectors of different lengths do not link. Rows without vec_id take no part and come back with a null
component. Rows that share a vec_id are vectors of their own. An empty table gives an empty result. Only
vec_id, label and embedding are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import components, keep
from wellspring.operators.ranking import row_index

LIST = 8  # neighbours that a node keeps
LEAF = 384  # nodes that a leaf compares with each other, about
TREES = 6
AROUND = 48  # neighbours of one node that are compared with each other at once, about
BLOCK = 256  # nodes of a block of a saturated component
AUDIT = 1024  # nodes whose links are counted by brute force, about
RECALL = 0.995
TRIES = 8
EDGES = "u bigint, v bigint, sim double"


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Unit vectors in double precision, one a row, padded with zeros to a common width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(float), column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    wide = max(width, int(sizes.max(initial=0)))
    if (sizes == wide).all():
        x = flat.reshape(len(sizes), wide)
    else:
        x = np.zeros((len(sizes), wide))
        x[np.arange(wide) < sizes[:, None]] = flat
    x = x / np.abs(x).max(axis=1, initial=0, keepdims=True)  # no overflow, no underflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the two halves of their vector's key, and nodes (id, grp, v, n, least): one per label and vector."""
    v = F.col("embedding")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & fine
    key = lambda seed: F.when(usable, F.xxhash64(F.lit(seed), "label", "embedding"))
    keyed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", key(1).alias("ka"), key(2).alias("kb"))
    grouped = keyed.filter("ka IS NOT NULL").groupBy("ka", "kb").agg(
        F.xxhash64(F.first("label"), F.size(F.first("embedding"))).alias("grp"), F.first("embedding").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"),
    )
    return keyed.select("vec_id", "ka", "kb"), keep(grouped.withColumn("id", F.monotonically_increasing_id()), "nodes")


def _edges(u, v, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sim": pa.array(sim, pa.float64())})


def leaves(nodes: DataFrame, width: int, trees: range) -> DataFrame:
    """u, v, sim: each node's nearest in its leaf of every tree."""
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("_n"))
    planes = 30

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = [np.random.default_rng([11, t]).standard_normal((width, planes)) for t in trees]
        for batch in batches:
            x = matrix(batch.column("v"), width) if batch.num_rows else np.zeros((0, width))
            for t, normal in zip(trees, normals):
                sign = ((x @ normal) > 0) @ (1 << np.arange(planes, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grp"), batch.column("v"), pa.array(np.full(len(x), t), pa.int32()), pa.array(sign, pa.int64())], ["id", "grp", "v", "tree", "sign"])

    kind = nodes.schema["v"].dataType.simpleString()
    signed = nodes.select("id", "grp", "v").mapInArrow(signs, f"id bigint, grp bigint, v {kind}, tree int, sign bigint")
    bits = F.greatest(F.lit(0), F.least(F.lit(planes), F.ceil(F.log2(F.col("_n") / LEAF)))).cast("int")
    leaf = F.col("sign").bitwiseAND(F.pow(F.lit(2.0), bits).cast("long") - 1)
    placed = keep(signed.join(sizes, "grp").select("id", "grp", "v", "tree", leaf.alias("leaf")), "leaves")
    by = ["grp", "tree", "leaf"]
    crowd = placed.groupBy(*by).agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("_n") / (2 * LEAF)))
    placed = placed.join(crowd, by).withColumn("part", part).drop("_n")

    def nearest(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), matrix(table.column("v"))
        take = min(LIST, len(ids) - 1)
        if take < 1:
            return pa.Table.from_batches([_edges([], [], [])])
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        at = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        return pa.Table.from_batches([_edges(np.repeat(ids, take), ids[at].ravel(), np.take_along_axis(sims, at, axis=1).ravel())])

    return placed.groupBy(*by, "part").applyInArrow(nearest, EDGES)


def merged(graph: DataFrame | None, found: DataFrame) -> DataFrame:
    """u, v, sim, fresh: the LIST nearest of each node; ``fresh`` are those that ``graph`` lacked."""
    rows = found.withColumn("fresh", F.lit(True))
    rows = rows if graph is None else rows.unionByName(graph.withColumn("fresh", F.lit(False)))
    rows = rows.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    best = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return keep(rows.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= LIST).drop("_r"), "graph")


def met(graph: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """u, v, sim of pairs that meet around a node, one of them for the first time, and improve a list.

    The neighbours of a node, both ways, are dealt into parts of about AROUND, otherwise in each round.
    """
    both = graph.select(F.col("u").alias("mid"), F.col("v").alias("id"), "fresh").unionByName(graph.select(F.col("v").alias("mid"), F.col("u").alias("id"), "fresh"))
    both = both.groupBy("mid", "id").agg(F.max("fresh").alias("fresh"))
    crowd = both.groupBy("mid").agg(F.count("*").alias("_n"), F.max("fresh").alias("_any")).filter("_any").drop("_any")
    worst = graph.groupBy("u").agg(F.when(F.count("*") == LIST, F.min("sim")).otherwise(-2.0).alias("worst"))
    vectors = nodes.select("id", "v").join(worst.withColumnRenamed("u", "id"), "id")
    dealt = both.join(crowd, "mid").withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("_n") / AROUND)))
    dealt = dealt.join(vectors, "id").repartition("mid", "part").sortWithinPartitions("mid", "part").select("mid", "part", "id", "fresh", "worst", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            cuts = groups(table)
            rest = table.slice(cuts[-2])
            if len(cuts) > 2:
                yield from pairs(table.slice(0, cuts[-2]), cuts[:-1])
        if rest is not None:
            yield from pairs(rest, groups(rest))

    def groups(table: pa.Table) -> np.ndarray:
        mid, part = table.column("mid").to_numpy(), table.column("part").to_numpy()
        return np.concatenate([[0], 1 + np.flatnonzero((mid[1:] != mid[:-1]) | (part[1:] != part[:-1])), [len(mid)]])

    def pairs(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        x, ids = matrix(table.column("v")), table.column("id").to_numpy()
        fresh, low = table.column("fresh").to_numpy(), table.column("worst").to_numpy()
        sizes = np.diff(cuts)
        for lo in range(0, len(sizes), 256):  # groups of a like size side by side, padded with row 0
            size = sizes[lo : lo + 256]
            slot = np.arange(size.max())
            real = slot < size[:, None]
            at = np.where(real, cuts[lo : lo + len(size), None] + slot, 0)
            part = x[at]
            sims = part @ part.transpose(0, 2, 1)
            new = real & fresh[at]
            use = real[:, :, None] & real[:, None, :] & (new[:, :, None] | new[:, None, :]) & (slot[:, None] != slot[None, :])
            g, i, j = np.nonzero(use & (sims > low[at][:, :, None]))
            yield _edges(ids[at[g, i]], ids[at[g, j]], sims[g, i, j])

    return dealt.mapInArrow(compare, EDGES)


def saturated_links(graph: DataFrame, groups: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame | None:
    """id, links for all nodes of components with a saturated list, counted exactly; None without any.

    ``groups`` is (node, root). A component is cut into blocks along the angle to one of its nodes.
    """
    full = graph.groupBy("u").agg(F.count("*").alias("_n"), F.min("sim").alias("_s")).filter((F.col("_n") == LIST) & (F.col("_s") >= threshold))
    roots = keep(groups.join(full.select(F.col("u").alias("node")), "node").select("root").distinct(), "saturated")
    if roots.isEmpty():
        return None
    members = groups.join(roots, "root").select(F.col("node").alias("id"), "root").join(nodes.select("id", "v", "n"), "id")
    pivots = members.filter("id = root").select("root", F.col("v").alias("p"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    lead = members.join(pivots, "root").withColumn("away", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("v", "p") / F.sqrt(dot("v", "v")) / F.sqrt(dot("p", "p"))))))
    placed = row_index(keep(lead.select("id", "root", "v", "n", F.coalesce(F.nanvl("away", F.lit(0.0)), F.lit(0.0)).alias("away")), "members"), ["root"], ["away", "id"])
    placed = placed.withColumn("block", F.floor(F.col("idx") / BLOCK))

    def packed(table: pa.Table) -> pa.Table:
        x = matrix(table.column("v"))
        centre = x.mean(axis=0)
        centre /= max(np.sqrt(centre @ centre), 1e-300)
        cell = {"root": table.column("root")[0].as_py(), "block": table.column("block")[0].as_py(), "ids": table.column("id").to_pylist(), "ns": table.column("n").to_pylist(), "x": x.tobytes()}
        cell |= {"centre": centre.tolist(), "reach": float(np.arccos(np.clip(x @ centre, -1, 1)).max())}
        return pa.Table.from_pylist([cell], pa.schema([("root", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("x", pa.binary()), ("centre", pa.list_(pa.float64())), ("reach", pa.float64())]))

    blocks = keep(placed.groupBy("root", "block").applyInArrow(packed, "root bigint, block bigint, ids array<bigint>, ns array<bigint>, x binary, centre array<double>, reach double"), "blocks")
    about = blocks.select("root", "block", "centre", "reach", F.aggregate("ns", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))
    last = blocks.groupBy("root").agg(F.max("block").alias("last"))
    side = lambda p: about.withColumnsRenamed({c: f"{p}{c}" for c in about.columns if c != "root"})
    two = side("a_").join(last, "root").withColumn("b_block", F.explode(F.sequence("a_block", "last"))).join(side("b_"), ["root", "b_block"])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("a_centre", "b_centre"))))
    reach, limit = F.col("a_reach") + F.col("b_reach") + 1e-6, math.acos(threshold)
    verdict = F.when(angle - reach > limit, "none").when(angle + reach < limit, "all").otherwise("some")
    two = keep(two.select("root", "a_block", "b_block", "a_total", "b_total", verdict.alias("verdict")).filter("verdict <> 'none'"), "block_pairs")
    every = two.filter("verdict = 'all'").select("root", F.col("a_block").alias("block"), F.col("b_total").alias("links"))
    every = every.unionByName(two.filter("verdict = 'all' AND a_block <> b_block").select("root", F.col("b_block").alias("block"), F.col("a_total").alias("links")))
    every = every.groupBy("root", "block").agg(F.sum("links").alias("links")).join(blocks, ["root", "block"])
    bulk = every.select(F.explode("ids").alias("id"), "links")  # a node's own class is in here once; taken off below

    def products(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["block", "ids", "ns", "x"]).to_pylist(), key=lambda r: r["block"])
        a, b = rows[0], rows[-1]
        xa, xb = (np.frombuffer(r["x"]).reshape(len(r["ids"]), -1) for r in (a, b))
        hit = xa @ xb.T >= threshold
        ids, links = list(a["ids"]), list(hit @ np.array(b["ns"], np.int64))
        if len(rows) > 1:
            ids, links = ids + list(b["ids"]), links + list(hit.T @ np.array(a["ns"], np.int64))
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64())})

    some = two.filter("verdict = 'some'").select("root", "a_block", "b_block", F.explode(F.array_distinct(F.array("a_block", "b_block"))).alias("block"))
    some = some.join(blocks.select("root", "block", "ids", "ns", "x"), ["root", "block"])
    counted = some.groupBy("root", "a_block", "b_block").applyInArrow(products, "id bigint, links bigint")
    whole = bulk.unionByName(counted).groupBy("id").agg(F.sum("links").alias("links"))
    return keep(whole.join(nodes.select("id", "n"), "id").select("id", (F.col("links") - F.col("n")).alias("links")), "counted")


def audit(nodes: DataFrame, links: DataFrame, threshold: float) -> float:
    """Share of the links of about AUDIT nodes, hash-drawn from all, that ``links`` (id, links) counts."""
    every = max(1, math.ceil(nodes.count() / AUDIT))
    drawn = nodes.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(every)) == 0).select("id", "grp", "v").toArrow()
    if not drawn.num_rows:
        return 1.0
    ids, group, asked = drawn.column("id").to_numpy(), drawn.column("grp").to_numpy(), matrix(drawn.column("v"))

    def count(batches):
        got = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, wide = matrix(batch.column("v"), asked.shape[1]), asked
                if x.shape[1] > wide.shape[1]:
                    wide = np.pad(asked, ((0, 0), (0, x.shape[1] - wide.shape[1])))
                hit = (wide @ x.T >= threshold) & (group[:, None] == batch.column("grp").to_numpy()[None, :]) & (ids[:, None] != batch.column("id").to_numpy()[None, :])
                got += hit @ batch.column("n").to_numpy()
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "true": pa.array(got, pa.int64())})

    true = nodes.select("id", "grp", "v", "n").mapInArrow(count, "id bigint, true bigint").groupBy("id").agg(F.sum("true").alias("true"))
    sums = true.join(links, "id", "left").agg(F.sum("true"), F.sum("links")).first()
    return (sums[1] or 0) / sums[0] if sums[0] else 1.0


def linked(rows: DataFrame, threshold: float = 0.93, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector. Raises if the audit stays below ``recall``."""
    keyed, nodes = nodes_of(rows)
    width = nodes.agg(F.max(F.size("v"))).first()[0] or 1
    graph, turn, close = None, 0, F.col("sim") >= threshold
    for attempt in range(TRIES):
        graph = merged(graph, leaves(nodes, width, range(attempt * TREES, (attempt + 1) * TREES)))
        while True:
            graph = merged(graph.drop("fresh"), met(graph, nodes, turn))
            turn += 1
            gained, held = graph.agg(F.count_if(close & F.col("fresh")), F.count_if(close)).first()
            if gained <= held // 1000:
                break
        near = keep(graph.filter(close).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "near")
        groups = keep(components(near).distinct(), "groups")
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = both.join(nodes.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
        exact = saturated_links(graph, groups, nodes, threshold)
        if exact is not None:
            links = links.join(exact, "id", "left_anti").unionByName(exact)
        links = keep(links, "links")
        if audit(nodes, links, threshold) >= recall:
            break
    else:
        raise RuntimeError(f"fewer than {recall:.1%} of the audited links were found after {TRIES} attempts")
    joined = nodes.select("id", "ka", "kb", "n", "least").join(groups.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left")
    joined = joined.withColumn("root", F.coalesce("root", "id"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = joined.join(lowest, "root").select("ka", "kb", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    own = F.coalesce("component_id", "vec_id")
    out = keyed.join(joined, ["ka", "kb"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
