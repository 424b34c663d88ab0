"""Queries of matched roles, portfolios by floors, rank correlations of parts and source texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.feature_queries import _PROFILES
from designlens.functions import sources, truth
from designlens.operators import features, neighbours, pareto
from designlens.registry import ORACLES, _PRED, _predicted, knees, query
from designlens.shared import once
from designlens.sources.designs import SQL, TARGETS_SQL, designs, targets

_ROLES = f"""{SQL}, {_PRED}, an AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY topology ORDER BY design) <= 3),
hd AS (
  SELECT an.design AS anchor, y.design AS other, count(*) FILTER (x.part <> y.part) AS distance, string_agg(CASE WHEN x.part <> y.part THEN '1' ELSE '0' END, '' ORDER BY x.slot) AS mask
  FROM an JOIN s x ON x.design = an.design JOIN s y ON y.topology = an.topology AND y.slot = x.slot AND y.design <> an.design GROUP BY ALL
), m AS (
  SELECT hd.*, a.circuit AS ac, a.growth AS ag, o.circuit AS oc, o.growth AS og, p.predicted AS op, other % 7 = 0 AS flagged, other % 5 = 0 AS trained FROM hd JOIN d a ON a.design = anchor JOIN d o ON o.design = other JOIN pd p ON p.design = other
), al AS (
  SELECT *, 'logic_failure' AS role, oc AS b FROM m WHERE NOT flagged AND abs(og - ag) <= abs(ag) * 0.05::DOUBLE
  UNION ALL SELECT *, 'growth_failure', og FROM m WHERE NOT flagged AND abs(oc - ac) <= abs(ac) * 0.2::DOUBLE
  UNION ALL SELECT *, 'near_miss', -oc FROM m WHERE NOT flagged AND distance BETWEEN 1 AND 2 AND oc * 10 < ac * 7
  UNION ALL SELECT *, 'interference', -op FROM m WHERE flagged AND op * 2 > ac
  UNION ALL SELECT *, 'top_in_training', -oc FROM m WHERE trained
)"""


@query(f"{_ROLES} SELECT anchor, role, other, CAST(distance AS INT) AS distance, mask FROM al QUALIFY row_number() OVER (PARTITION BY anchor, role ORDER BY b, other) = 1")
def matched_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three anchors of each topology with what they are compared with, in five roles."""
    d = designs(spark, sf_dir)
    rows = d.join(_predicted(spark, sf_dir).select("design", "predicted"), "design").withColumns({"flagged": F.col("design") % 7 == 0, "trained": F.col("design") % 5 == 0})
    anchors = d.groupBy("topology").agg(F.slice(F.sort_array(F.collect_list("design")), 1, 3).alias("first")).select(F.explode("first").alias("design"))
    return neighbours.matched_roles(rows, d.join(anchors, "design"), ["topology"], "design", "slots", "circuit", "growth", "predicted", "flagged", "trained")


#: Floors of both scores and the largest growth there may be.
CIRCUIT_FLOOR, GROWTH_FLOOR, GROWTH_MOST = 24.0, 300.0, 700.0
_FLOORS = f"""kn AS ({ORACLES["knees"]}), kd AS (
  SELECT kn.topology, d.group_no, knee_a AS design, log2(CAST(circuit AS DOUBLE)) AS x, CAST(growth AS DOUBLE) AS y FROM kn JOIN d ON d.design = knee_a
), fi AS (SELECT * FROM kd WHERE x >= {CIRCUIT_FLOOR} AND y >= {GROWTH_FLOOR}), co AS (
  SELECT *, round((x - {CIRCUIT_FLOOR}::DOUBLE) / greatest(max(x) OVER () - {CIRCUIT_FLOOR}::DOUBLE, 1e-9) + (y - {GROWTH_FLOOR}::DOUBLE) / {GROWTH_MOST - GROWTH_FLOOR}::DOUBLE, 9) AS combined FROM fi
)"""


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = knees(spark, sf_dir).select("topology", F.col("knee_a").alias("design"))
    rows = own.join(designs(spark, sf_dir).select("design", "group_no", F.log2(F.col("circuit").cast("double")).alias("x"), F.col("growth").cast("double").alias("y")), "design")
    return pareto.combined_by_floors(rows, "x", "y", CIRCUIT_FLOOR, GROWTH_FLOOR, GROWTH_MOST)


@query(f"{SQL}, {_FLOORS} SELECT topology, design, combined, CAST(row_number() OVER (ORDER BY combined DESC, design) AS INT) AS rank FROM co")
def portfolio_by_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knees that reach both floors, ranked: a row for each topology at most."""
    rows = _combined(spark, sf_dir).select("topology", "design", "combined")
    return rows.withColumn("rank", F.row_number().over(pareto.Window.orderBy(F.desc("combined"), "design")))


@query(f"""{SQL}, {TARGETS_SQL}, {_FLOORS}, be AS (SELECT target, design, combined FROM co JOIN tg ON co.group_no = tg.group_no QUALIFY row_number() OVER (PARTITION BY target ORDER BY combined DESC, design) = 1)
SELECT *, CAST(row_number() OVER (ORDER BY combined DESC, design, target) AS INT) AS rank FROM be ORDER BY combined DESC, design, target LIMIT 15""")
def best_knee_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.best_knees(_combined(spark, sf_dir), targets(spark), "group_no", "design")


@query(f"""{_PROFILES}, sh AS (SELECT a.part AS a, b.part AS b, a.v AS x, b.v AS y FROM ce a JOIN ce b ON a.topology = b.topology AND a.slot = b.slot AND a.part < b.part),
rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS x, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS y FROM sh)
SELECT a, b, count(*) AS n_shared, CASE WHEN var_pop(x) * var_pop(y) > 0 THEN round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) END AS r, count(*) < 30 AS low_confidence FROM rk GROUP BY a, b""")
def part_rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = designs(spark, sf_dir).select("topology", "growth", F.posexplode("slots").alias("slot", "part"))
    cells = long.groupBy("part", "topology", "slot").agg(F.avg("growth").alias("v"))
    return features.profile_rank_correlations(cells, "part", ["topology", "slot"], "v", 30).withColumn("r", F.round("r", 6))


def _function_class_sql() -> str:
    """The class of ``f`` in SQL: the least value over all ways of reading its rows, negated or not."""
    values = [" + ".join(f"((f >> {r}) & 1) * {1 << i}" for i, r in enumerate(m)) for m in truth.input_maps(3)]
    return f"least({', '.join(f'least({v}, 255 - ({v}))' for v in values)})"


@query(f"""WITH fu AS (SELECT DISTINCT CAST(p_partkey % 256 AS INT) AS f FROM part), cl AS (SELECT printf('0x%02X', f) AS target, printf('0x%02X', {_function_class_sql()}) AS class FROM fu WHERE f < 200),
so AS (SELECT p_partkey, printf('0x%02X', p_partkey % 256) AS t, CASE p_partkey % 5 WHEN 0 THEN printf('0x%02X', p_partkey % 256) WHEN 1 THEN 'baseline:' || printf('0x%02X', p_partkey % 256) || '/' || p_size WHEN 2 THEN printf('["0x%02X", "0x01"]', p_partkey % 256)
  WHEN 3 THEN printf('[''0x%02X'', ''0x02'']', p_partkey % 256) END AS source FROM part)
SELECT CASE WHEN source IS NULL THEN NULL ELSE split_part(replace(source, 'baseline:', ''), '/', 1) END AS parent, CASE WHEN source IS NOT NULL THEN t END AS "primary", coalesce(class, '?') AS class, count(*) AS n
FROM so LEFT JOIN cl ON target = CASE WHEN source IS NOT NULL THEN t END GROUP BY ALL""")
def source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as source texts of four kinds, with parent target, primary source and its class; some targets have no class."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    f = F.col("p_partkey") % 256
    target = lambda v: F.format_string("0x%02X", v)
    kind = F.col("p_partkey") % 5
    source = F.when(kind == 0, target(f)).when(kind == 1, F.concat(F.lit("baseline:"), target(f), F.lit("/"), F.col("p_size").cast("string"))).when(kind == 2, F.format_string('["0x%02X", "0x01"]', f)).when(kind == 3, F.format_string("['0x%02X', '0x02']", f))
    known = part.select(f.cast("int").alias("f")).distinct().where("f < 200")
    # the least class of a target would let the optimizer drop that distinct, and work the class out for each part
    classes = once(known, [], target=target(F.col("f")), **{"class": target(truth.function_class(F.col("f"), 3))})
    return sources.class_counts(part.select(source.alias("source")), "source", classes)
