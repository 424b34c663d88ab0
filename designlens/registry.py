"""Queries of the design-space operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.functions.slots import family_valid
from designlens.operators import enrichment, fidelity, pareto, tiers, variance
from designlens.sources.designs import ROLES_SQL, SQL, TARGETS_SQL, designs, slot_roles, targets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _parts(spark: SparkSession) -> DataFrame:
    return spark.range(1, 26).select(F.col("id").cast("int").alias("part"))


_TAILS = """
cut AS (
  SELECT topology, quantile_cont(circuit, 0.95) AS qt, quantile_cont(circuit, 0.05) AS qb FROM d GROUP BY topology
), t AS (
  SELECT d.*, qt, qb, circuit >= qt AS is_top, circuit <= qb AS is_bottom FROM d JOIN cut ON d.topology = cut.topology
)
"""


def _presence_sql(extra: str, source: str) -> str:
    e = f"{extra}, " if extra else ""
    on = f"e.{extra} = c.{extra} AND " if extra else ""
    return f"""
{SQL}, {_TAILS}, {ROLES_SQL}, {TARGETS_SQL}, tt AS ({source}), own AS (
  SELECT DISTINCT {e}role, tt.design, s.part, is_top, is_bottom FROM tt JOIN s ON tt.design = s.design JOIN ro ON s.group_no = ro.group_no AND s.slot = ro.slot WHERE is_top OR is_bottom
), c AS (
  SELECT {e}role, part, count(*) FILTER (is_top) AS top_part, count(*) FILTER (is_bottom) AS bottom_part FROM own GROUP BY {e}role, part
), e AS (
  SELECT {e}role, count(*) FILTER (is_top) AS top_n, count(*) FILTER (is_bottom) AS bottom_n, count(DISTINCT topology) AS n_topologies
  FROM tt JOIN (SELECT DISTINCT group_no, role FROM ro) r ON tt.group_no = r.group_no WHERE is_top OR is_bottom GROUP BY {e}role
), f AS (
  SELECT e.*, CAST(p AS INT) AS part, coalesce(top_part, 0) AS top_part, coalesce(bottom_part, 0) AS bottom_part
  FROM e CROSS JOIN range(1, 26) r(p) LEFT JOIN c ON {on}e.role = c.role AND c.part = p
), pr AS (
  SELECT {e}role, part, top_part, bottom_part, top_n, bottom_n, n_topologies,
         round((top_part + 1) / (top_n + 2), 9) AS p_top, round((bottom_part + 1) / (bottom_n + 2), 9) AS p_bottom,
         round(log2(((top_part + 1) / (top_n + 2)) / ((bottom_part + 1) / (bottom_n + 2))), 9) AS log2_ratio FROM f
)"""


@query(_presence_sql("", "SELECT * FROM t") + " SELECT * FROM pr")
def presence_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.presence(designs(spark, sf_dir), slot_roles(spark), "circuit", _parts(spark))


@query(_presence_sql("target", "SELECT t.*, target FROM t JOIN tg ON t.group_no = tg.group_no") + " SELECT * FROM pr")
def presence_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    # tails are a topology's own: they are cut before its designs count for each target
    tails = designs(spark, sf_dir)
    both = enrichment.presence(tails.join(targets(spark).groupBy("group_no").agg(F.collect_list("target").alias("targets")), "group_no"), slot_roles(spark), "circuit", _parts(spark), ["targets"])
    each = both.select("role", "part", "top_part", "bottom_part", "top_n", "bottom_n", "n_topologies", F.explode("targets").alias("target"))
    summed = each.groupBy("target", "role", "part").agg(*[F.sum(c).alias(c) for c in ("top_part", "bottom_part", "top_n", "bottom_n", "n_topologies")])
    return summed.withColumns(enrichment.presence_statistics(*[F.col(c) for c in ("top_part", "bottom_part", "top_n", "bottom_n")]))


@query(_presence_sql("", "SELECT * FROM t") + """
SELECT CAST(row_number() OVER (ORDER BY abs(log2_ratio) DESC, role, part) AS INT) AS rank, role, part, log2_ratio, CASE WHEN log2_ratio > 0 THEN 'enriched' ELSE 'depleted' END AS direction
FROM pr WHERE n_topologies >= 2 AND top_part + bottom_part >= 5 ORDER BY abs(log2_ratio) DESC, role, part LIMIT 40""")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.top_rules(presence_enrichment(spark, sf_dir), 40)


@query(f"""{SQL}, {_TAILS}
SELECT topology, count(*) AS n_designs, round(max(qt), 2) AS top_threshold, round(max(qb), 2) AS bottom_threshold, count(*) FILTER (is_top) AS n_top, count(*) FILTER (is_bottom) AS n_bottom,
       count(*) FILTER (circuit = qt) AS ties_top, count(*) FILTER (circuit = qb) AS ties_bottom, count(*) FILTER (is_top AND is_bottom) AS overlap FROM t GROUP BY topology""")
def tail_bookkeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = enrichment.tail_bookkeeping(designs(spark, sf_dir), ["topology"], "circuit")
    return out.withColumns({c: F.round(c, 2) for c in ("top_threshold", "bottom_threshold")})


@query(f"""{SQL}, {_TAILS}, c AS (
  SELECT t.topology, slot, part, count(*) FILTER (is_top) AS n_top, count(*) FILTER (is_bottom) AS n_bottom FROM t JOIN s ON t.design = s.design GROUP BY t.topology, slot, part
), cells AS (
  SELECT topology, slot, CAST(p AS INT) AS part FROM (SELECT DISTINCT topology, slot FROM s) CROSS JOIN range(1, 26) r(p)
)
SELECT cells.*, coalesce(n_top, 0) AS n_top, coalesce(n_bottom, 0) AS n_bottom, round(ln((coalesce(n_top, 0) + 1) / (coalesce(n_bottom, 0) + 1)), 9) AS log_odds
FROM cells LEFT JOIN c ON cells.topology = c.topology AND cells.slot = c.slot AND cells.part = c.part""")
def slot_tail_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.slot_tail_log_odds(designs(spark, sf_dir), ["topology"], "circuit", _parts(spark))


@query(f"""{SQL} SELECT topology, count(*) AS n, min(growth) AS min, max(growth) AS max, round(avg(growth), 6) AS mean, median(growth) AS median, round(stddev_pop(growth), 4) AS sd_pop FROM d GROUP BY topology""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variance.score_summary(designs(spark, sf_dir), ["topology"], "growth")


_MAIN = """
mo AS (SELECT topology, count(*) AS n, avg(growth) AS m, var_pop(growth) AS v FROM d GROUP BY topology),
c1 AS (SELECT topology, slot, part, count(*) AS k, avg(growth) AS mean FROM s GROUP BY topology, slot, part),
ma AS (SELECT c1.topology, slot, sum(k * (mean - m) ** 2) / max(n) / max(v) AS main FROM c1 JOIN mo ON c1.topology = mo.topology GROUP BY c1.topology, slot)
"""


@query(f"{SQL}, {_MAIN} SELECT topology, slot, round(main, 6) AS main FROM ma")
def sobol_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variance.main_effects(designs(spark, sf_dir), ["topology"], "growth").withColumn("main", F.round("main", 6))


@query(f"""{SQL}, {_MAIN},
c2 AS (SELECT a.topology, a.slot AS i, b.slot AS j, a.part AS pa, b.part AS pb, count(*) AS k, avg(a.growth) AS mean FROM s a JOIN s b ON a.design = b.design AND a.slot < b.slot GROUP BY ALL),
pa AS (SELECT c2.topology, i, j, sum(k * (mean - m) ** 2) / max(n) / max(v) AS tog FROM c2 JOIN mo ON c2.topology = mo.topology GROUP BY c2.topology, i, j)
SELECT pa.topology, i, j, round(greatest(tog - x.main - y.main, 0), 6) AS pair FROM pa JOIN ma x ON pa.topology = x.topology AND i = x.slot JOIN ma y ON pa.topology = y.topology AND j = y.slot""")
def sobol_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variance.pair_effects(designs(spark, sf_dir), ["topology"], "growth").withColumn("pair", F.round("pair", 6))


_FRONT = """
fr AS (
  SELECT topology, design, circuit, growth FROM (
    SELECT *, max(growth) OVER (PARTITION BY topology ORDER BY circuit DESC, growth DESC, design ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d)
  WHERE b IS NULL OR growth > b
)
"""


def _front(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir).select("topology", "design", "circuit", "growth")
    return pareto.skyline(d, ["topology"], "circuit", "growth", "design")


@query(f"{SQL}, {_FRONT} SELECT * FROM fr")
def skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _front(spark, sf_dir)


@query(f"""{SQL}, {_FRONT}, nm AS (
  SELECT *, CASE WHEN max(circuit) OVER w > min(circuit) OVER w THEN (circuit - min(circuit) OVER w) / (max(circuit) OVER w - min(circuit) OVER w) ELSE 0.5 END AS nx,
         CASE WHEN max(growth) OVER w > min(growth) OVER w THEN (growth - min(growth) OVER w) / (max(growth) OVER w - min(growth) OVER w) ELSE 0.5 END AS ny
  FROM fr WINDOW w AS (PARTITION BY topology)
), en AS (
  SELECT *, first_value(nx) OVER o AS x0, first_value(ny) OVER o AS y0, last_value(nx) OVER o AS x1, last_value(ny) OVER o AS y1
  FROM nm WINDOW o AS (PARTITION BY topology ORDER BY circuit, growth DESC, design ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), me AS (
  SELECT *, round(CASE WHEN sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) < 1e-12 THEN 0.0 ELSE abs((y1 - y0) * (nx - x0) - (x1 - x0) * (ny - y0)) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) END, 9) AS ma,
         round(nx * ny, 9) AS mb, round(sqrt((1 - nx) * (1 - nx) + (1 - ny) * (1 - ny)), 9) AS mc FROM en
)
SELECT topology, count(*) AS n_front, max(circuit) AS max_x, max(growth) AS max_y,
       first(design ORDER BY ma DESC, circuit, design) AS knee_a, first(design ORDER BY mb DESC, circuit, design) AS knee_b, first(design ORDER BY mc, circuit, design) AS knee_c
FROM me GROUP BY topology""")
def knees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.knees(_front(spark, sf_dir), ["topology"], "circuit", "growth", "design")


@query(f"""{SQL}, {_FRONT} SELECT topology, circuit AS x, max(growth) OVER (PARTITION BY topology ORDER BY circuit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM fr""")
def monotone_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.envelope(_front(spark, sf_dir), ["topology"], "circuit", "growth")


@query(f"""{SQL}, {TARGETS_SQL}, b AS (
  SELECT target, topology, design, circuit FROM d JOIN tg ON d.group_no = tg.group_no QUALIFY row_number() OVER (PARTITION BY target ORDER BY circuit DESC, design) = 1
)
SELECT *, CAST(row_number() OVER (ORDER BY circuit DESC, design, target) AS INT) AS rank FROM b ORDER BY circuit DESC, design, target LIMIT 15""")
def best_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.best_per_target(designs(spark, sf_dir), targets(spark), "circuit", "design")


@query(f"{SQL} SELECT gate_count, CAST(least(greatest(floor((growth - 200) / 5), 0), 99) AS BIGINT) AS bin, count(*) AS n FROM d GROUP BY ALL")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.histogram(designs(spark, sf_dir), ["gate_count"], "growth", 200, 5, 100)


_CUTS = "cu AS (SELECT gate_count, " + ", ".join(f"quantile_cont(circuit, {(100 - t) / 100}) AS top_{t:02d}, quantile_cont(circuit, {t / 100}) AS bot_{t:02d}" for t in tiers.TIERS) + " FROM d GROUP BY gate_count)"


@query(f"{SQL}, {_CUTS} SELECT gate_count, " + ", ".join(f"round(top_{t:02d}, 2) AS top_{t:02d}, round(bot_{t:02d}, 2) AS bot_{t:02d}" for t in tiers.TIERS) + " FROM cu")
def tier_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiers.tier_thresholds(designs(spark, sf_dir), "gate_count", "circuit")
    return out.select("gate_count", *[F.round(c, 2).alias(c) for c in out.columns if c != "gate_count"])


@query(f"{SQL}, {_CUTS} SELECT d.gate_count, topology, count(*) AS n_designs, " + ", ".join(f"count(*) FILTER (circuit >= top_{t:02d}) AS n_top_{t:02d}, count(*) FILTER (circuit <= bot_{t:02d}) AS n_bot_{t:02d}" for t in tiers.TIERS) + " FROM d JOIN cu ON d.gate_count = cu.gate_count GROUP BY d.gate_count, topology")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.tier_counts(designs(spark, sf_dir), "gate_count", "topology", "circuit")


@query(f"""{SQL}, va AS (SELECT design, any_value(gate_count) AS gate_count, count(DISTINCT part % 12) = any_value(gate_count) AS ok FROM s GROUP BY design)
SELECT gate_count, count(*) AS n_designs, count(*) FILTER (ok) AS n_valid FROM va GROUP BY gate_count""")
def validity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs(spark, sf_dir).groupBy("gate_count").agg(F.count("*").alias("n_designs"), F.count_if(family_valid(F.col("slots"))).alias("n_valid"))


@query(f"""{SQL} SELECT 'kept' AS reason, count(*) AS n FROM d WHERE gate_count <= 6 AND variant <> 'P' UNION ALL SELECT 'variant', count(*) FROM d WHERE variant = 'P' UNION ALL SELECT 'size', count(*) FROM d WHERE variant <> 'P' AND gate_count > 6""")
def scope_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("variant") == "P", "variant").when(F.col("gate_count") > 6, "size").otherwise("kept")
    return designs(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_PRED = "pm AS (SELECT part, sum(circuit) AS su, count(*) AS n FROM s GROUP BY part), pd AS (SELECT s.design, any_value(topology) AS topology, any_value(s.circuit) AS circuit, sum(su // n) AS predicted FROM s JOIN pm ON s.part = pm.part GROUP BY s.design)"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs with a second score: the whole part of the mean score of each of their parts, summed."""
    d = designs(spark, sf_dir).select("topology", "design", "circuit", "slots")
    long = d.select("topology", "design", "circuit", F.explode("slots").alias("part"))
    means = long.groupBy("part").agg(F.expr("sum(circuit) div count(*)").alias("mean"))
    return long.join(means, "part").groupBy("topology", "design", "circuit").agg(F.sum("mean").alias("predicted"))


@query(f"{SQL}, {_PRED} SELECT topology, round(1 - sum((CAST(circuit AS DOUBLE) - predicted) ** 2) / (var_pop(circuit) * count(*)), 6) AS r2 FROM pd GROUP BY topology")
def fidelity_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predicted(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("circuit", "predicted")})
    return fidelity.r_squared(p, ["topology"], "circuit", "predicted")


@query(f"""{SQL}, {_PRED}, rk AS (
  SELECT topology, rank() OVER (PARTITION BY topology ORDER BY circuit) + (count(*) OVER (PARTITION BY topology, circuit) - 1) / 2 AS a, rank() OVER (PARTITION BY topology ORDER BY predicted) + (count(*) OVER (PARTITION BY topology, predicted) - 1) / 2 AS b FROM pd
) SELECT topology, round(corr(a, b), 6) AS rho FROM rk GROUP BY topology""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.spearman(_predicted(spark, sf_dir), ["topology"], "circuit", "predicted")


@query(f"""{SQL}, {_PRED}, rk AS (SELECT row_number() OVER (ORDER BY circuit DESC, design) AS a, row_number() OVER (ORDER BY predicted DESC, design) AS b FROM pd)
SELECT CAST(k AS INT) AS k, round(count(*) FILTER (a <= k AND b <= k) / k, 6) AS recall FROM rk CROSS JOIN (VALUES (10), (50), (100), (500)) v(k) GROUP BY k HAVING count(*) FILTER (a <= 500 AND b <= 500) > 0""")
def topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.top_k_recall(_predicted(spark, sf_dir), "circuit", "predicted", "design")
