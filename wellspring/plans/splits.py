"""Queries for splits and sampling."""

from pyspark.sql import functions as F

from wellspring.operators import splits as sp
from wellspring.operators.ranking import attach, with_scalars
from wellspring.plans import query
from wellspring.plans.bindings import TRACES, table, traces

LI = """li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 's' || CAST(l_suppkey % 7 AS VARCHAR) AS chip, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"""
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
ID4 = IDS[:4]


def _hash(seed, ids=ID4):
    return "md5('" + str(seed) + "|' || " + " || '|' || ".join(f"CAST({i} AS VARCHAR)" for i in ids) + ")"


def _items(spark, root):
    return table(spark, root, "lineitem").select(
        *IDS, F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("chip"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))


def _strat(src, strata, name, cuts, seed=3, ids=ID4):
    case = " ".join(f"WHEN i < floor(n * CAST({u} AS DOUBLE)) THEN '{c}'" for c, u in cuts.items())
    return f""", {name} AS (SELECT *, CASE {case} ELSE '{list(cuts)[-1]}' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {_hash(seed, ids)}, {', '.join(ids)}) - 1 AS i, count(*) OVER (PARTITION BY {strata}) AS n FROM {src}) z)"""


SUM = "SELECT split, chip, y, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM {src} GROUP BY 1, 2, 3"


def _sum(d):
    return d.groupBy("split", "chip", "y").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"))


C3 = {"train": 0.70, "val": 0.85, "test": 1.0}
C2 = {"train": 0.85, "val": 1.0}


@query("k01_stratified_split", f"WITH {LI}{_strat('li', 'y', 's', C3)} {SUM.format(src='s')}")
def k01(spark, root):
    return _sum(sp.stratified(_items(spark, root), ["y"], ID4, C3, 3))


LOCO = f"WITH {LI}, pool AS (SELECT * FROM li WHERE chip <> 's3'){_strat('pool', 'y', 's', C2)}, al AS (SELECT split, chip, y, l_orderkey FROM s UNION ALL SELECT 'test', chip, y, l_orderkey FROM li WHERE chip = 's3') {SUM.format(src='al')}"


@query("k02_leave_one_chip_out", LOCO)
def k02(spark, root):
    d = _items(spark, root)
    return _sum(sp.hold_out(d, "chip", ["s3"], sp.stratified(d.filter("chip <> 's3'"), ["y"], ID4, C2, 3)))


@query("k03_fixed_test_chips", f"WITH {LI}, pool AS (SELECT * FROM li WHERE chip NOT IN ('s1', 's5')){_strat('pool', 'chip, y', 's', C2)}, al AS (SELECT split, chip, y, l_orderkey FROM s UNION ALL SELECT 'test', chip, y, l_orderkey FROM li WHERE chip IN ('s1', 's5')) {SUM.format(src='al')}")
def k03(spark, root):
    d = _items(spark, root)
    return _sum(sp.hold_out(d, "chip", ["s1", "s5"], sp.stratified(d.filter(~F.col("chip").isin("s1", "s5")), ["chip", "y"], ID4, C2, 3)))


@query("k04_grouped_folds", f"""WITH g AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS p, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT l_suppkey, n, row_number() OVER (ORDER BY p, n, {_hash(3, ['l_suppkey'])}) - 1 AS i FROM g)
SELECT l_suppkey, n, CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INTEGER) AS fold FROM o""")
def k04(spark, root):
    d = _items(spark, root)
    return attach(sp.dealt_folds(d, "l_suppkey", "y", 5, 3), d.groupBy("l_suppkey").agg(F.count("*").alias("n")), ["l_suppkey"])


# which fold a group gets is a greedy matter (tested against brute force); that groups stay whole and folds even, SQL can say
@query("k04_balanced_folds", """WITH t AS (SELECT count(*) AS n, count(DISTINCT l_suppkey) AS g, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS p FROM lineitem)
SELECT CAST(f AS INTEGER) AS fold, true AS whole, true AS even_rows, true AS even_labels, g AS n_groups_all, n AS n_rows_all FROM t, range(5) r(f)""")
def k04_balanced(spark, root):
    d = _items(spark, root)
    fold = sp.grouped_folds(d, "l_suppkey", "y", 5, 3)
    size = d.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    t = attach(fold, size, ["l_suppkey"])
    whole = t.agg((F.count("*") == F.count_distinct("l_suppkey")).alias("whole"), F.count("*").alias("n_groups_all"), F.sum("n").alias("n_rows_all"), F.max("n").alias("big"), (F.sum("pos") / F.sum("n")).alias("p"))
    per = with_scalars(t.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), whole)
    return per.select(
        "fold", "whole", (F.abs(F.col("n") - F.col("n_rows_all") / 5) <= F.col("big")).alias("even_rows"),
        (F.abs(F.col("pos") / F.col("n") - F.col("p")) <= 0.05).alias("even_labels"), "n_groups_all", "n_rows_all")


@query("k04_nested_folds", """WITH g AS (SELECT DISTINCT l_suppkey FROM lineitem)
SELECT CAST(f AS INTEGER) AS fold, l_suppkey, true AS once, 1 AS n_test FROM g, range(5) r(f)""")
def k04_nested(spark, root):
    """Every group has one role per outer fold and is test in exactly one of them."""
    n = sp.nested_folds(_items(spark, root), "l_suppkey", "y", 5, 7, 3)
    per = n.groupBy("fold", "l_suppkey").agg((F.count("*") == 1).alias("once"))
    tests = n.groupBy("l_suppkey").agg(F.count_if(F.col("split") == "test").cast("int").alias("n_test"))
    return attach(per, tests, ["l_suppkey"]).select("fold", "l_suppkey", "once", "n_test")


@query("k05_validation_chip", f"WITH {TRACES} SELECT arg_min(chip_id, {_hash(11, ['chip_id'])}) AS picked FROM traces")
def k05(spark, root):
    return sp.pick_group(traces(spark, root), "chip_id", 11)


@query("k06_hold_out_fold", f"""WITH {LI}, v AS (SELECT arg_min(chip, {_hash(11, ['chip'])}) AS vc FROM li WHERE chip <> 's3')
SELECT CASE WHEN chip = 's3' THEN 'test' WHEN chip = vc THEN 'val' ELSE 'train' END AS split, chip, y, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM li, v GROUP BY 1, 2, 3""")
def k06(spark, root):
    d = _items(spark, root)
    v = sp.pick_group(d.filter("chip <> 's3'"), "chip", 11)
    d = with_scalars(d, v)
    return _sum(d.withColumn("split", F.when(F.col("chip") == "s3", "test").when(F.col("chip") == F.col("picked"), "val").otherwise("train")))


@query("k06_hold_out_random_val", LOCO.replace("PARTITION BY y", "PARTITION BY 1 = 1"))
def k06_random(spark, root):
    d = _items(spark, root)
    pool = d.filter("chip <> 's3'").withColumn("all_rows", F.lit(1))
    return _sum(sp.hold_out(d, "chip", ["s3"], sp.stratified(pool, ["all_rows"], ID4, C2, 3).drop("all_rows")))


@query("k07_hold_out_wells", f"WITH {TRACES}, w AS (SELECT DISTINCT chip_id, well_id FROM traces) SELECT * FROM w ORDER BY {_hash(5, ['chip_id', 'well_id'])} LIMIT 6")
def k07(spark, root):
    return sp.pick_groups(traces(spark, root), ["chip_id", "well_id"], 6, 5)


@query("k08_capped_sample", f"""WITH {LI} SELECT chip, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY chip ORDER BY {_hash(5)}, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM li) z WHERE rn <= 120""")
def k08(spark, root):
    return sp.capped_sample(_items(spark, root), ["chip"], ID4, 120, 5).select("chip", *ID4)
