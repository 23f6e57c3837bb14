"""Queries for unions, intersections, differences and distinct counts."""

from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.plans import query
from wellspring.plans.bindings import TRACES, q6, r6, table, traces


@query("o01_union_with_origin", """SELECT origin, id, CAST(v AS DOUBLE) AS v FROM (
 SELECT 'main' AS origin, c_custkey AS id, c_acctbal AS v FROM customer UNION ALL SELECT 'second', s_suppkey + 1000000000, s_acctbal FROM supplier) z""")
def o01(spark, root):
    a = table(spark, root, "customer").select(F.lit("main").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    b = table(spark, root, "supplier").select(F.lit("second").alias("origin"), (F.col("s_suppkey") + 1000000000).alias("id"), F.col("s_acctbal").alias("v"))
    return a.unionByName(b)


@query("o02_add_controls", f"""WITH {TRACES}, w AS (SELECT 'main' AS origin, pixel_id, y, x[1:48] AS x FROM traces WHERE chip_id <> 'chip4' UNION ALL SELECT 'ctrl', pixel_id, y, x[1:48] FROM traces WHERE chip_id = 'chip4' AND y = 0)
SELECT origin, pixel_id, y, CAST(len(x) AS INTEGER) AS width, {q6('list_sum(x)')} AS total FROM w""")
def o02(spark, root):
    t = traces(spark, root)
    main = t.filter("chip_id <> 'chip4'").withColumn("origin", F.lit("main"))
    ctrl = t.filter("chip_id = 'chip4' AND y = 0").withColumn("origin", F.lit("ctrl"))
    u = main.unionByName(ctrl).withColumn("x", ar.pad_or_cut("x", 48))
    return u.select("origin", "pixel_id", "y", F.size("x").alias("width"), r6(ar.total("x")).alias("total"))


@query("o03_seed_intersections", """WITH s AS (SELECT DISTINCT l_linenumber % 3 AS seed, l_suppkey AS pid FROM lineitem WHERE l_quantity > 45),
p AS (SELECT pid, bool_or(seed = 0) AS a, bool_or(seed = 1) AS b, bool_or(seed = 2) AS c FROM s GROUP BY 1)
SELECT count(*) FILTER (a AND b) AS ab, count(*) FILTER (a AND c) AS ac, count(*) FILTER (b AND c) AS bc, count(*) FILTER (a AND b AND c) AS abc FROM p""")
def o03(spark, root):
    li = table(spark, root, "lineitem").filter("l_quantity > 45")
    has = li.groupBy("l_suppkey").agg(*[F.max((F.col("l_linenumber") % 3 == i).cast("int")).alias(f"s{i}") for i in range(3)])
    s0, s1, s2 = (F.col(f"s{i}") == 1 for i in range(3))
    return has.agg(F.count_if(s0 & s1).alias("ab"), F.count_if(s0 & s2).alias("ac"), F.count_if(s1 & s2).alias("bc"), F.count_if(s0 & s1 & s2).alias("abc"))


@query("o04_complement_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def o04(spark, root):
    return table(spark, root, "documents").select("doc_id").join(table(spark, root, "labels").select("doc_id"), "doc_id", "left_anti").distinct()


@query("o05_distinct_counts", f"WITH {TRACES} SELECT count(DISTINCT chip_id) AS chips, count(DISTINCT well_id) AS wells, count(DISTINCT chip_id || '/' || CAST(well_id AS VARCHAR)) AS chip_wells, count(*) AS n FROM traces")
def o05(spark, root):
    # reduce to distinct (chip, well) with counts first: the second step sees no pixel rows
    cw = traces(spark, root).groupBy("chip_id", "well_id").agg(F.count("*").alias("n"))
    return cw.agg(F.countDistinct("chip_id").alias("chips"), F.countDistinct("well_id").alias("wells"), F.count("*").alias("chip_wells"), F.sum("n").alias("n"))
