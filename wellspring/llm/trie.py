"""The prefix trie of conversations, measured along an Euler tour.

A node is a distinct sequence of first turns. Its key is a position-bound digest summed along the
conversation, so that keys come from prefix sums and no prefix is ever spelled out. Every node gives an
enter and an exit arc; each arc knows its successor in the tour. The tour is ranked distributedly: every
arc jumps to the next of a random set of rulers, the rulers are ranked the same way, and all others
add their distance. Prefix sums at arc positions then give what a subtree holds: the value at the
exit less the value before the enter arc.

Rows without conv_id take no part; a null turn comes first; null role or text is empty; rows equal in
turn follow role, then text, and repeated rows count as often as they occur. An empty table gives an
empty result. Only conv_id, turn, role and text are read, so other columns may have any name. Long
texts travel as digests only.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import keep
from wellspring.operators.ranking import row_index

RUN = 1024  # turns of a conversation that one window sums
PIECE = 20_000  # children of one parent that one window orders
BLOCK = 65_536  # tour positions that one window sums
RULERS = 16  # one arc of so many is a ruler
LOCAL = 100_000  # a list up to this length is ranked by one task
ENDS = 8  # bits of conv_id within a chunk of listed members
WORDS = 4  # 30-bit words of a turn's digest: 120 bits, and room for 2**33 turns


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, idx (from 0), digest, chars: one row per turn."""
    texts = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    counted = texts.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("n"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    placed = row_index(keep(each, "turns"), ["conv_id"], ["turn", "role", "text", "copy"])
    return placed.select("conv_id", "idx", digest.alias("digest"), F.length("text").cast("long").alias("chars"))


def rebuilt(turns: DataFrame, heads: int = 100, most: int = 6) -> DataFrame:
    """conv_id, pos (from 1), digest, chars, of: conversations whose first turns are those of their head.

    ``of`` is the number of turns; a conversation without turns has one row at position 0.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    want = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    convs = convs.withColumns({"h": want, "head": F.col("conv_id") - F.col("conv_id") % heads})
    sizes = convs.filter(F.col("conv_id") % heads == 0).select(F.col("conv_id").alias("head"), F.least("n", F.lit(most).cast("long")).alias("head_n"))
    convs = convs.join(sizes, "head", "left")
    given = F.least("h", F.coalesce("head_n", F.lit(0).cast("long")))
    convs = keep(convs.select("conv_id", "head", "h", given.alias("given"), (given + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("of")), "conversations")
    first = turns.filter((F.col("idx") < most) & (F.col("conv_id") % heads == 0)).select(F.col("conv_id").alias("head"), "idx", "digest", "chars")
    taken = convs.join(first, "head").filter(F.col("idx") < F.col("given")).select("conv_id", (F.col("idx") + 1).alias("pos"), "digest", "chars", "of")
    own = turns.join(convs, "conv_id").filter(F.col("idx") >= F.col("h"))
    own = own.select("conv_id", (F.col("given") + F.col("idx") - F.col("h") + 1).alias("pos"), "digest", "chars", "of")
    start = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"), "of")
    return taken.unionByName(own).unionByName(start)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key (ka, kb), parent's key (pa, pb), chars, ends: one row per conversation and depth."""
    hexed = F.sha2(F.concat(F.encode(F.col("pos").cast("string"), "utf-8"), F.lit(b":"), F.col("digest")), 256)
    word = lambda i: F.when(F.col("pos") > 0, F.conv(F.substring("hexed", 1 + 8 * i, 8), 16, 10).cast("long") % (1 << 30)).otherwise(0)
    words = turns.withColumn("hexed", hexed).withColumn("run", F.floor(F.col("pos") / RUN))
    words = keep(words.select("conv_id", "pos", "run", "chars", "of", *[word(i).alias(f"w{i}") for i in range(WORDS)]), "words")
    runs = words.groupBy("conv_id", "run").agg(*[F.sum(f"w{i}").alias(f"r{i}") for i in range(WORDS)])
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", *[F.coalesce(F.sum(f"r{i}").over(earlier), F.lit(0)).alias(f"r{i}") for i in range(WORDS)])
    within = Window.partitionBy("conv_id", "run").orderBy("pos")
    sums = words.select("*", *[F.sum(f"w{i}").over(within).alias(f"s{i}") for i in range(WORDS)]).join(runs, ["conv_id", "run"])
    here = [F.col(f"r{i}") + F.col(f"s{i}") for i in range(WORDS)]
    before = [here[i] - F.col(f"w{i}") for i in range(WORDS)]
    key = lambda seed, depth, parts: F.xxhash64(F.lit(seed), depth, *parts)
    deep = F.col("pos") > 0
    up = F.col("pos") - 1
    return sums.select(
        "conv_id", F.col("pos").alias("depth"), key(1, F.col("pos"), here).alias("ka"), key(2, F.col("pos"), here).alias("kb"),
        F.when(deep, key(1, up, before)).alias("pa"), F.when(deep, key(2, up, before)).alias("pb"), "chars", (F.col("pos") == F.col("of")).alias("ends"),
    )


def digests(ends: DataFrame) -> DataFrame:
    """ka, kb, ends_sha256 of the ids in ``ends`` (conv_id, ka, kb), ascending, comma-joined.

    Ids are listed in chunks that hold at most 2**ENDS of them; a task hashes the chunks of its keys one after the other.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy("ka", "kb", F.shiftright("conv_id", ENDS).alias("chunk")).agg(ids.alias("ids"))

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (a, b) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(text.as_buffer())
                else:
                    state.update(b",")
                    state.update(text.as_buffer())
            yield emit(done)
        if key is not None:
            yield emit([(*key, state.hexdigest())])

    def emit(rows):
        return pa.RecordBatch.from_pydict({"ka": pa.array([r[0] for r in rows], pa.int64()), "kb": pa.array([r[1] for r in rows], pa.int64()), "ends_sha256": pa.array([r[2] for r in rows], pa.string())})

    ordered = chunks.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "chunk")
    return ordered.select("ka", "kb", "ids").mapInArrow(hashed, "ka bigint, kb bigint, ends_sha256 string")


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tour's arcs (arc, nxt, hops) and, per child node, (id, parent, parent_conv).

    ``nodes`` (id, conv_id, depth, ka, kb, pa, pb) is a kept table. Node ``id`` has the arcs 2 id and 2 id + 1. Children follow one another by piece, then conv_id;
    pieces split the children of a popular parent, and only a piece's first row meets the parent.
    """
    pieces = max(1, math.ceil(nodes.count() / PIECE))
    kids = nodes.filter("depth > 0").withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(pieces)))
    line = Window.partitionBy("pa", "pb", "piece").orderBy("conv_id")
    kids = keep(kids.select("id", "pa", "pb", "piece", F.lead("id").over(line).alias("younger"), F.row_number().over(line).alias("at")), "children")
    heads = kids.filter("at = 1").select("pa", "pb", "piece", F.col("id").alias("head"))
    parents = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv"))
    chain = Window.partitionBy("pa", "pb").orderBy("piece")
    heads = heads.select("*", F.lead("head").over(chain).alias("next_head"), F.row_number().over(chain).alias("nth")).join(parents, ["pa", "pb"])
    heads = keep(heads, "pieces")
    linked = kids.join(heads.select("pa", "pb", "piece", "parent", "parent_conv", "next_head"), ["pa", "pb", "piece"])
    linked = keep(linked.select("id", "parent", "parent_conv", F.coalesce("younger", "next_head").alias("younger")), "siblings")
    first = heads.filter("nth = 1").select(F.col("parent").alias("id"), F.col("head").alias("child"))
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    down = nodes.select("id").join(first, "id", "left").select(enter("id").alias("arc"), F.coalesce(enter("child"), leave("id")).alias("nxt"))
    up = linked.select(leave("id").alias("arc"), F.coalesce(enter("younger"), leave("parent")).alias("nxt"))
    end = nodes.filter("depth = 0").select(leave("id").alias("arc"), F.lit(None).cast("long").alias("nxt"))
    return keep(down.unionByName(up).unionByName(end).withColumn("hops", F.lit(1).cast("long")), "tour"), linked.drop("younger")


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """Steps to the end for a whole, short list."""
    arcs = frame["arc"].to_numpy(np.int64)
    order = np.argsort(arcs)
    last = frame["nxt"].isna().to_numpy()
    to = order[np.searchsorted(arcs, np.where(last, arcs[0], frame["nxt"].fillna(0)).astype(np.int64), sorter=order)]
    to[last] = np.flatnonzero(last)
    steps = np.where(last, 0, frame["hops"]).astype(np.int64)
    while (to != to[to]).any():
        steps, to = steps + steps[to], to[to]
    return pd.DataFrame({"arc": arcs, "steps": steps})


def list_rank(links: DataFrame, local: int = LOCAL, level: int = 0) -> DataFrame:
    """arc, steps: steps from each arc of one linked list (arc, nxt, hops) to its last arc. ``links`` is a kept table."""
    if links.count() <= local:
        return links.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_walk, "arc bigint, steps bigint")
    tail = links.filter("nxt IS NULL").select("arc").first()[0]
    ruler = lambda c: (F.pmod(F.xxhash64(c, F.lit(level)), F.lit(RULERS)) == 0) | (F.col(c) == tail)
    state = links.withColumn("done", F.col("nxt").isNull() | ruler("nxt"))
    while not state.filter("NOT done").isEmpty():
        target = state.filter(~ruler("arc")).select(F.col("arc").alias("via"), F.col("nxt").alias("_nxt"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        moved = state.filter("NOT done").join(target, F.col("nxt") == F.col("via"))
        moved = moved.select("arc", F.col("_nxt").alias("nxt"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"))
        state = keep(state.filter("done").unionByName(moved), "jumped")
    rulers = keep(state.filter(ruler("arc")).select("arc", "nxt", "hops"), "rulers")
    ranked = keep(list_rank(rulers, local, level + 1), "ruled")
    rest = state.filter(~ruler("arc")).join(ranked.select(F.col("arc").alias("nxt"), "steps"), "nxt")
    return ranked.unionByName(rest.select("arc", (F.col("steps") + F.col("hops")).alias("steps")))


def subtree_sums(positions: DataFrame, values: list[str]) -> DataFrame:
    """id and, per value, its sum over the node's subtree; ``positions`` (arc, pos, values) has values at enter arcs."""
    placed = keep(positions.withColumn("block", F.floor(F.col("pos") / BLOCK)), "positions")
    blocks = placed.groupBy("block").agg(*[F.sum(v).alias(f"b_{v}") for v in values])
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per BLOCK positions
    blocks = blocks.select("block", *[F.coalesce(F.sum(f"b_{v}").over(earlier), F.lit(0)).alias(f"b_{v}") for v in values])
    within = Window.partitionBy("block").orderBy("pos")
    sums = placed.select("*", *[F.sum(v).over(within).alias(f"s_{v}") for v in values]).join(blocks, "block")
    odd = F.col("arc") % 2 == 1
    part = lambda v: F.sum(F.when(odd, F.col(f"b_{v}") + F.col(f"s_{v}")).otherwise(F.col(v) - F.col(f"b_{v}") - F.col(f"s_{v}")))
    return sums.groupBy(F.shiftright("arc", 1).alias("id")).agg(*[part(v).cast("long").alias(v) for v in values])


def trie(rows: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = keep(prefixes(rebuilt(keep(turns_of(rows), "digests"))), "prefixes")
    nodes = paths.groupBy("ka", "kb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("depth", "pa", "pb", "chars")])
    nodes = keep(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    if nodes.isEmpty():
        return nodes.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", F.col("n_convs").alias("n_children"), F.col("n_convs").alias("n_leaves"), F.col("n_convs").alias("saved_tokens"), F.lit("").alias("ends_sha256"))
    arcs, parents = tour(nodes)
    steps = list_rank(arcs, local)
    last = 2 * nodes.count() - 1
    children = parents.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    about = keep(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")
    value = about.select((F.col("id") * 2).alias("arc"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    positions = steps.join(value, "arc", "left").select("arc", (F.lit(last) - F.col("steps")).alias("pos"), none("n_leaves"), none("saved_tokens"))
    whole = subtree_sums(positions, ["n_leaves", "saved_tokens"])
    out = about.join(whole, "id").join(parents.select("id", F.col("parent_conv").alias("parent_conv_id")), "id", "left")
    out = out.join(digests(paths.filter("ends")), ["ka", "kb"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
