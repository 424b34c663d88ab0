"""Binding of order tables to designs: what the operators read in this repository's queries.

A design is an order of four to seven lines; its slots, in line order, hold the
brand number of each line's part. Its topology is (number of lines, order
priority), its variant the order status. Scores are integers, so that ties and
thresholds are the same in every engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from designlens.shared import exists, shared_path


#: Lines of one partition of the binding's shuffles.
LINES = 500_000
#: Where a session has written the bound designs of a folder of tables.
_BOUND: dict[tuple[str, str], tuple[str, StructType]] = {}


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topology, gate_count, group_no, variant, design, slots, circuit, growth.

    The tables are bound once a session and folder, into a Parquet table of the shared
    folder: operators read designs several times, as they would any stored table of them.
    """
    return _stored(spark, sf_dir).drop("nodes")


def design_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``designs`` with nodes: the suppliers of a design's lines, in slot order."""
    return _stored(spark, sf_dir)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BOUND or not exists(spark, _BOUND[key][0]):
        path, bound = shared_path(spark, "designs"), bound_designs(spark, sf_dir)
        bound.write.parquet(path)
        _BOUND[key] = path, bound.schema
    path, schema = _BOUND[key]
    return spark.read.schema(schema).parquet(path)


def bound_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The designs of ``sf_dir`` from its order tables, with the suppliers of their lines as nodes.

    One shuffle of the lines on the order key serves the join with the orders too, and one sort does for that join and for the order of the lines: the
    first line of an order meets the seven after it, so no more of an order is held. Shuffles have a partition for each ``LINES`` lines, so a task
    holds no more in larger tables. A part that is listed twice gives a line two slots, but one node.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = max(spark.sparkContext.defaultParallelism, -(-read("lineitem").count() // LINES))
    named = read("part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 3).cast("int").alias("part")).repartition(n, "l_partkey")
    part = named.withColumn("first", F.row_number().over(Window.partitionBy("l_partkey").orderBy("part")) == 1)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    discount, tax = (F.round(F.col(c) * 100).cast("bigint") for c in ("l_discount", "l_tax"))
    by = ["l_linenumber", "l_partkey", "l_suppkey", "part", "first"]
    lines = read("lineitem").join(part, "l_partkey").select("l_orderkey", *by, (cents * (100 - discount)).alias("c"), (100 - discount - tax).alias("g")).where("l_orderkey is not null").repartition(n, "l_orderkey")
    w, line = Window.partitionBy("l_orderkey").orderBy(*by), F.struct("part", "l_suppkey", "first", "c", "g")
    met = lines.select("l_orderkey", F.row_number().over(w).alias("at"), line.alias("line_0"), *[F.lead(line, k).over(w).alias(f"line_{k}") for k in range(1, 8)])
    fit = met.where("at = 1 and line_3 is not null and line_7 is null")
    own = [F.col(f"line_{k}") for k in range(7)]
    total = lambda c: F.when(F.coalesce(*[x[c] for x in own]).isNotNull(), reduce(Column.__add__, [F.coalesce(x[c], F.lit(0)) for x in own]))
    grouped = fit.select("l_orderkey", F.array_compact(F.array(*own)).alias("lines"), total("c").alias("circuit"), total("g").alias("growth"))
    orders = read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderstatus")
    count, priority = F.size("lines"), F.substring("o_orderpriority", 1, 1)
    return grouped.join(orders, "l_orderkey").select(
        F.concat_ws("-", count.cast("string"), priority).alias("topology"), count.alias("gate_count"), (count * 5 + priority.cast("int")).alias("group_no"), F.col("o_orderstatus").alias("variant"),
        F.col("l_orderkey").alias("design"), F.col("lines.part").alias("slots"), "circuit", "growth",
        F.transform(F.filter("lines", lambda x: x["first"]), lambda x: x["l_suppkey"]).alias("nodes"),
    )


#: The same in SQL: d has a row for each design, s one for each slot.
SQL = """
WITH RECURSIVE ln AS (
  SELECT l_orderkey AS design, CAST(substr(p_brand, 7, 3) AS INT) AS part,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS slot,
         count(*) OVER (PARTITION BY l_orderkey) AS k,
         CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS c,
         100 - CAST(round(l_discount * 100) AS BIGINT) - CAST(round(l_tax * 100) AS BIGINT) AS g
  FROM lineitem JOIN part ON l_partkey = p_partkey
), d AS (
  SELECT design, CAST(any_value(k) AS VARCHAR) || '-' || substr(any_value(o_orderpriority), 1, 1) AS topology,
         CAST(any_value(k) AS INT) AS gate_count, CAST(any_value(k) * 5 + CAST(substr(any_value(o_orderpriority), 1, 1) AS INT) AS INT) AS group_no, any_value(o_orderstatus) AS variant,
         CAST(sum(c) AS BIGINT) AS circuit, CAST(sum(g) AS BIGINT) AS growth
  FROM ln JOIN orders ON design = o_orderkey WHERE k BETWEEN 4 AND 7 GROUP BY design
), s AS (
  SELECT d.*, CAST(ln.slot AS INT) AS slot, ln.part FROM d JOIN ln ON d.design = ln.design
)
"""


def targets(spark: SparkSession) -> DataFrame:
    """Which targets a topology serves, one or two: by its group number."""
    group = F.col("id").cast("int").alias("group_no")
    first, second = F.concat(F.lit("t"), (F.col("id") % 4).cast("string")), F.concat(F.lit("t"), (F.col("id") % 4 + 1).cast("string"))
    return spark.range(20, 41).select(group, F.explode(F.when(F.col("id") % 3 == 0, F.array(first, second)).otherwise(F.array(first))).alias("target"))


TARGETS_SQL = """
tg AS (
  SELECT CAST(i AS INT) AS group_no, 't' || CAST(i % 4 AS VARCHAR) AS target FROM range(20, 41) r(i)
  UNION ALL SELECT CAST(i AS INT), 't' || CAST(i % 4 + 1 AS VARCHAR) FROM range(20, 41) r(i) WHERE i % 3 = 0
)
"""


def slot_roles(spark: SparkSession) -> DataFrame:
    """group_no, slot, role of every slot: its degrees and kind in the topology's graph."""
    nodes = spark.range(20, 41).select(F.col("id").cast("int").alias("group_no"), F.explode(F.sequence(F.lit(0), F.floor((F.col("id") - 1) / 5).cast("int") - 1)).alias("slot"))
    size = F.floor((F.col("group_no") - 1) / 5).cast("int")
    edge = lambda i, j: ((3 * i + 7 * j + F.col("group_no")) % 3 == 0).cast("int")
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    into = total(F.transform(F.filter(F.sequence(F.lit(0), size - 1), lambda i: i < F.col("slot")), lambda i: edge(i, F.col("slot"))))
    out = total(F.transform(F.filter(F.sequence(F.lit(0), size - 1), lambda j: j > F.col("slot")), lambda j: edge(F.col("slot"), j)))
    found = nodes.withColumns({"n_in": into, "n_out": out})
    kind = F.when(F.col("n_in") == 0, "IN").when(F.col("n_out") == 0, "OUT").when(F.col("n_in") == 1, "NOT").otherwise("NOR")
    return found.select("group_no", "slot", F.concat_ws("|", F.concat(F.lit("in="), F.col("n_in").cast("string")), F.concat(F.lit("out="), F.col("n_out").cast("string")), F.concat(F.lit("type="), kind)).alias("role"))


ROLES_SQL = """
ro AS (
  SELECT group_no, slot, 'in=' || n_in || '|out=' || n_out || '|type=' || CASE WHEN n_in = 0 THEN 'IN' WHEN n_out = 0 THEN 'OUT' WHEN n_in = 1 THEN 'NOT' ELSE 'NOR' END AS role
  FROM (
    SELECT n.group_no, n.slot,
           count(*) FILTER (o.slot < n.slot AND (3 * o.slot + 7 * n.slot + n.group_no) % 3 = 0) AS n_in,
           count(*) FILTER (o.slot > n.slot AND (3 * n.slot + 7 * o.slot + n.group_no) % 3 = 0) AS n_out
    FROM (SELECT DISTINCT group_no, slot FROM s) n JOIN (SELECT DISTINCT group_no, slot FROM s) o ON n.group_no = o.group_no
    GROUP BY n.group_no, n.slot)
)
"""
