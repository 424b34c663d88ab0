"""Queries of quality tiers, expectations, occurrences and coalitions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.design_queries import _SWAPS, _score
from designlens.functions.slots import family_valid
from designlens.operators import coalitions, enrichment, expectations, qc, tiers
from designlens.registry import _CUTS, _PRED, _TAILS, _parts, _predicted, _presence_sql, presence_enrichment, query
from designlens.shared import materialize
from designlens.sources.designs import ROLES_SQL, SQL, TARGETS_SQL, designs, slot_roles, targets

HIGH, LOW = 0.50, 0.45
#: A topology that counts as never measured.
UNMEASURED = "6-5"

_QC = f"""{SQL}, {_PRED}, vm AS (
  SELECT pd.topology, variant, CASE WHEN pd.topology <> '{UNMEASURED}' THEN round(1 - sum((CAST(pd.circuit AS DOUBLE) - predicted) ** 2) / (var_pop(pd.circuit) * count(*)), 6) END AS r2,
         round(avg(CASE WHEN growth >= 450 THEN 1.0 ELSE 0.0 END), 6) AS grown, count(*) AS n
  FROM pd JOIN d ON pd.design = d.design GROUP BY pd.topology, variant
), qc AS (
  SELECT topology, first(variant ORDER BY coalesce(-r2, 'infinity'::DOUBLE), variant) AS best_variant, first(r2 ORDER BY coalesce(-r2, 'infinity'::DOUBLE), variant) AS r2,
         first(grown ORDER BY coalesce(-r2, 'infinity'::DOUBLE), variant) AS grown, first(n ORDER BY coalesce(-r2, 'infinity'::DOUBLE), variant) AS n
  FROM vm GROUP BY topology
), ti AS (
  SELECT *, CASE WHEN r2 IS NULL OR grown IS NULL THEN 'BROKEN' WHEN least(exp(r2 / 400), grown) >= {HIGH} THEN 'A1' WHEN least(exp(r2 / 400), grown) >= {LOW} THEN 'A2' ELSE 'A3' END AS tier FROM qc
)"""


def _qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir).select("design", "variant", "growth")
    p = _predicted(spark, sf_dir).join(d, "design").withColumns({c: F.col(c).cast("double") for c in ("circuit", "predicted")})
    total = F.var_pop("circuit") * F.count("*")
    metrics = p.groupBy("topology", "variant").agg(
        F.when(F.col("topology") != UNMEASURED, F.round(1 - F.sum((F.col("circuit") - F.col("predicted")) ** 2) / F.nullif(total, F.lit(0.0)), 6)).alias("r2"), F.round(F.avg((F.col("growth") >= 450).cast("double")), 6).alias("grown"), F.count("*").alias("n")
    )
    best = qc.best_variant(metrics, ["topology"], "variant", "r2", ["grown", "n"])
    return best.withColumn("tier", qc.tier(F.exp(F.col("r2") / 400), F.col("grown"), HIGH, LOW))


@query(f"{_QC} SELECT * FROM ti")
def qc_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qc(spark, sf_dir)


@query(f"""{_QC} SELECT CAST(substr(topology, 1, 1) AS INT) AS gate_count, count(*) FILTER (tier = 'A1') AS n_a1, count(*) FILTER (tier = 'A2') AS n_a2, count(*) FILTER (tier = 'A3') AS n_a3, count(*) FILTER (tier = 'BROKEN') AS n_broken FROM ti GROUP BY ALL""")
def tier_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _qc(spark, sf_dir).withColumn("gate_count", F.substring("topology", 1, 1).cast("int"))
    return qc.crosstab(table, "gate_count", "tier", ["A1", "A2", "A3", "BROKEN"])


@query(f"""{_QC} SELECT d.topology, count(*) AS n_kept, max(circuit) AS max_circuit FROM d SEMI JOIN (SELECT * FROM ti WHERE tier IN ('A1', 'A2')) k ON d.topology = k.topology AND d.variant = k.best_variant GROUP BY d.topology""")
def representative_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = qc.kept_rows(designs(spark, sf_dir), _qc(spark, sf_dir), ["topology"], "variant", ["A1", "A2"])
    return kept.groupBy("topology").agg(F.count("*").alias("n_kept"), F.max("circuit").alias("max_circuit"))


@query(f"""{SQL}, {_CUTS}, ob AS (SELECT topology, gate_count, round(avg(circuit), 2) AS mean_circuit FROM d GROUP BY ALL), ex AS (SELECT gate_count, round(0.99 * avg(circuit), 2) AS near_low, round(1.01 * avg(circuit), 2) AS near_high FROM d GROUP BY gate_count)
SELECT topology, mean_circuit, round(bot_25, 2) AS low, round(top_25, 2) AS high, mean_circuit BETWEEN round(bot_25, 2) AND round(top_25, 2) AS inside, near_low, near_high, mean_circuit BETWEEN near_low AND near_high AS near
FROM ob JOIN cu ON ob.gate_count = cu.gate_count JOIN ex ON ob.gate_count = ex.gate_count""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of topologies against the quartiles of their size, and against the mean of their size, one hundredth either way; for every size."""
    d = designs(spark, sf_dir)
    observed = d.groupBy("topology", "gate_count").agg(F.round(F.avg("circuit"), 2).alias("mean_circuit"))
    quartiles = tiers.tier_thresholds(d, "gate_count", "circuit").select("gate_count", F.round("bot_25", 2).alias("low"), F.round("top_25", 2).alias("high"))
    mean = F.avg("circuit")
    close = d.groupBy("gate_count").agg(F.round(0.99 * mean, 2).alias("low"), F.round(1.01 * mean, 2).alias("high"))
    wide = qc.calibration(observed, quartiles, ["gate_count"], "mean_circuit")
    near = qc.calibration(observed, close, ["gate_count"], "mean_circuit").select("topology", F.col("low").alias("near_low"), F.col("high").alias("near_high"), F.col("inside").alias("near"))
    return wide.join(near, "topology").drop("gate_count")


def _occurrence_sql(extra: str, source: str) -> str:
    e = f"{extra}, " if extra else ""
    on = f"e.{extra} = c.{extra} AND " if extra else ""
    return f"""{SQL}, {_TAILS}, {ROLES_SQL}, {TARGETS_SQL}, tt AS ({source}), oc AS (
  SELECT {e}role, s.part, is_top, is_bottom, tt.topology FROM tt JOIN s ON tt.design = s.design JOIN ro ON s.group_no = ro.group_no AND s.slot = ro.slot WHERE is_top OR is_bottom
), c AS (SELECT {e}role, part, count(*) FILTER (is_top) AS top_n, count(*) FILTER (is_bottom) AS bottom_n FROM oc GROUP BY {e}role, part),
e AS (SELECT {e}role, count(DISTINCT topology) AS n_topologies FROM oc GROUP BY {e}role)
SELECT {'e.' + extra + ', ' if extra else ''}e.role, CAST(p AS INT) AS part, coalesce(top_n, 0) AS top_n, coalesce(bottom_n, 0) AS bottom_n, n_topologies, round(log2((coalesce(top_n, 0) + 1) / (coalesce(bottom_n, 0) + 1)), 9) AS log_odds
FROM e CROSS JOIN range(1, 26) r(p) LEFT JOIN c ON {on}e.role = c.role AND c.part = p"""


@query(_occurrence_sql("", "SELECT * FROM t"))
def occurrence_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.occurrence(designs(spark, sf_dir), slot_roles(spark), "circuit", _parts(spark))


@query(_occurrence_sql("target", "SELECT t.*, target FROM t JOIN tg ON t.group_no = tg.group_no"))
def occurrence_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.occurrence(designs(spark, sf_dir), slot_roles(spark), "circuit", _parts(spark), targets(spark), "target")


@query(f"""{SQL}, va AS (SELECT design, any_value(gate_count) AS gate_count, count(DISTINCT part % 12) AS k, count(*) FILTER (part NOT BETWEEN 1 AND 25) AS odd, count(*) AS n FROM s GROUP BY design)
SELECT 'part_in_library' AS rule, count(*) FILTER (odd > 0) AS violations FROM va UNION ALL SELECT 'slot_count', count(*) FILTER (n <> gate_count) FROM va UNION ALL SELECT 'family_once', count(*) FILTER (k <> n) FROM va
UNION ALL SELECT 'circuit_finite', count(*) FILTER (circuit IS NULL) FROM d UNION ALL SELECT 'growth_finite', count(*) FILTER (growth IS NULL) FROM d""")
def expectations_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = expectations.design_rules("slots", ["circuit", "growth"], 25, 12, F.col("gate_count"))
    return expectations.report(designs(spark, sf_dir), rules)


@query(_presence_sql("", "SELECT * FROM t") + """ SELECT r.rule, v.n AS violations FROM (SELECT count(*) FILTER (top_part < 0 OR top_part > 9007199254740990) AS a, count(*) FILTER (top_n < 0) AS b, count(*) FILTER (top_n <= 0) AS c, count(*) FILTER (top_part > top_n) AS d,
  count(*) FILTER (bottom_part < 0) AS e, count(*) FILTER (bottom_n < 0) AS f, count(*) FILTER (bottom_n <= 0) AS g, count(*) FILTER (bottom_part > bottom_n) AS h FROM pr) z
CROSS JOIN LATERAL (VALUES ('top_part_is_count', z.a), ('top_n_is_count', z.b), ('top_n_positive', z.c), ('top_part_within_top_n', z.d), ('bottom_part_is_count', z.e), ('bottom_n_is_count', z.f), ('bottom_n_positive', z.g), ('bottom_part_within_bottom_n', z.h)) v(rule, n)
CROSS JOIN LATERAL (SELECT v.rule AS rule) r""")
def count_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expectations.report(presence_enrichment(spark, sf_dir), expectations.count_rules(["top_part", "bottom_part"], ["top_n", "bottom_n"]))


@query(_presence_sql("", "SELECT * FROM t") + " SELECT count(*) AS n_rows, count(DISTINCT role) * 25 AS n_cells, count(DISTINCT role) * 25 - count(DISTINCT (role, part)) AS missing, (SELECT count(*) FROM (SELECT role, part FROM pr GROUP BY role, part HAVING count(*) > 1)) AS repeated FROM pr")
def grid_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expectations.grid_report(presence_enrichment(spark, sf_dir), ["role"], _parts(spark), ["top_part", "bottom_part", "log2_ratio"])


@query(_presence_sql("", "SELECT * FROM t") + """ SELECT v.rule, v.n AS violations FROM (SELECT count(*) FILTER (abs(p_top - (top_part + 1) / (top_n + 2)) > 1e-8) AS a, count(*) FILTER (abs(p_bottom - (bottom_part + 1) / (bottom_n + 2)) > 1e-8) AS b,
  count(*) FILTER (abs(log2_ratio - log2(p_top / p_bottom)) > 1e-5) AS c FROM pr) z CROSS JOIN LATERAL (VALUES ('p_top', z.a), ('p_bottom', z.b), ('log2_ratio', z.c)) v(rule, n)""")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = presence_enrichment(spark, sf_dir)
    first = expectations.derived_report(table, {"p_top": (F.col("top_part") + 1) / (F.col("top_n") + 2), "p_bottom": (F.col("bottom_part") + 1) / (F.col("bottom_n") + 2)}, 1e-8)
    return first.union(expectations.derived_report(table, {"log2_ratio": F.log2(F.col("p_top") / F.col("p_bottom"))}, 1e-5))


@query(f"{SQL} SELECT topology, variant, count(*) AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM (SELECT topology, variant FROM d GROUP BY ALL HAVING sum(circuit) % 3 <> 0) o WHERE o.topology = d.topology AND o.variant = d.variant) GROUP BY ALL")
def pending_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = designs(spark, sf_dir).groupBy("topology", "variant").agg(F.count("*").alias("n"), F.sum("circuit").alias("total"))
    return expectations.pending(todo.drop("total"), todo.where("total % 3 <> 0"), ["topology", "variant"])


#: Rows of the pool of a topology.
POOL = 24
_COALITIONS = f"""{SQL}, fv AS (SELECT design, string_agg(CAST(part AS VARCHAR), '-' ORDER BY slot) AS own FROM s GROUP BY design HAVING count(DISTINCT part % 12) = count(*)),
fd AS (SELECT d.*, own FROM d JOIN fv ON d.design = fv.design),
an AS (SELECT topology, design, gate_count AS n FROM fd QUALIFY row_number() OVER (PARTITION BY topology ORDER BY circuit DESC, design) = 1),
po AS (SELECT topology, k AS pool FROM (SELECT topology, own, min(design) AS k FROM fd GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY topology ORDER BY (k * 7919) % 10007, k) <= {POOL}),
mi AS (
  SELECT an.design, an.n, CAST(m AS INT) AS mask, po.pool, count(DISTINCT (CASE WHEN (CAST(m AS INT) >> a.slot) % 2 = 1 THEN a.part ELSE b.part END) % 12) = an.n AS safe,
         sum((a.slot + 1) * (CASE WHEN (CAST(m AS INT) >> a.slot) % 2 = 1 THEN a.part ELSE b.part END)) AS f
  FROM an JOIN po ON an.topology = po.topology JOIN range(0, 128) r(m) ON m < CAST(pow(2, an.n) AS BIGINT) JOIN s a ON a.design = an.design JOIN s b ON b.design = po.pool AND b.slot = a.slot GROUP BY an.design, an.n, r.m, po.pool
), cv AS (SELECT design, n, mask, avg(CAST(f * f AS DOUBLE)) FILTER (safe) AS v, count(*) FILTER (safe) AS n_safe FROM mi GROUP BY ALL),
cl AS (SELECT design, n, list(v ORDER BY mask) AS vs FROM cv GROUP BY design, n),
sm AS (
  SELECT design, i AS slot, sum(factorial(bit_count(m)) * factorial(n - bit_count(m) - 1) / factorial(n) * dv) AS phi, count(*) FILTER (dv IS NULL) AS odd
  FROM (SELECT design, n, i, m, vs[m + (1 << i) + 1] - vs[m + 1] AS dv FROM cl, range(0, 7) r(i), range(0, 128) w(m) WHERE i < n AND m < (1 << n) AND (m >> i) % 2 = 0) GROUP BY design, i
), sp AS (
  SELECT design, CAST(i AS INT) AS i, CAST(j AS INT) AS j, sum(factorial(bit_count(m)) * factorial(n - bit_count(m) - 2) / factorial(n - 1) * dv) AS phi, count(*) FILTER (dv IS NULL) AS odd
  FROM (SELECT design, n, i, j, m, vs[m + (1 << i) + (1 << j) + 1] - vs[m + (1 << i) + 1] - vs[m + (1 << j) + 1] + vs[m + 1] AS dv
        FROM cl, range(0, 7) r(i), range(0, 7) u(j), range(0, 128) w(m) WHERE i < j AND j < n AND m < (1 << n) AND (m >> i) % 2 = 0 AND (m >> j) % 2 = 0) GROUP BY design, i, j
)"""


def _square(slots):
    whole = F.aggregate(F.transform(slots, lambda p, i: ((i + 1) * p).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return whole * whole


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coalitions of the best valid design of each topology with a pool of its valid designs."""
    d = designs(spark, sf_dir).where(family_valid(F.col("slots")))
    best = d.groupBy("topology").agg(F.min(F.struct((-F.col("circuit")).alias("by"), "design", "slots")).alias("b")).select("topology", "b.design", "b.slots")
    return coalitions.hybrids(best, coalitions.completion_pool(d, ["topology"], "design", POOL), ["topology"], "design", 12)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalitions.coalition_values(_mixed(spark, sf_dir), "design", _square)


@query(f"{_COALITIONS} SELECT design, n, mask, round(v, 4) AS v, n_safe FROM cv")
def coalition_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).withColumn("v", F.round("v", 4))


@query(f"{_COALITIONS} SELECT design, CAST(slot AS INT) AS slot, CASE WHEN odd = 0 THEN round(phi, 4) END AS phi FROM sm")
def shapley_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalitions.shapley_main(_values(spark, sf_dir), "design").withColumn("phi", F.round("phi", 4))


@query(f"{_COALITIONS} SELECT design, i, j, CASE WHEN odd = 0 THEN round(phi, 4) END AS phi FROM sp")
def shapley_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalitions.shapley_pair(_values(spark, sf_dir), "design").withColumn("phi", F.round("phi", 4))


@query(f"""{_COALITIONS} SELECT 'finite' AS rule, (SELECT count(DISTINCT design) FROM (SELECT design FROM sm WHERE odd > 0 UNION ALL SELECT design FROM sp WHERE odd > 0)) AS violations
UNION ALL SELECT 'complete', (SELECT count(*) FROM cl WHERE (SELECT count(*) FROM sm WHERE sm.design = cl.design) <> n OR (SELECT count(*) FROM sp WHERE sp.design = cl.design) * 2 <> n * (n - 1)) UNION ALL SELECT 'efficient', (SELECT count(DISTINCT design) FROM (SELECT design FROM sm WHERE odd > 0))""")
def attribution_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = materialize(_values(spark, sf_dir), "coalitions")
    ends = values.groupBy("design", "n").agg((F.max_by("v", "mask") - F.min_by("v", "mask")).alias("total"))
    return coalitions.attribution_rules(coalitions.shapley_main(values, "design"), coalitions.shapley_pair(values, "design"), ends, "design")


@query(f"{_COALITIONS} SELECT n, CAST(bit_count(mask) AS INT) AS kept, count(*) AS n_mixed, round(avg(CASE WHEN safe THEN 0.0 ELSE 1.0 END), 6) AS unsafe FROM mi GROUP BY ALL")
def coalition_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalitions.validity_by_size(_mixed(spark, sf_dir))


@query(f"""{_SWAPS}, tp AS (SELECT design, slot, p FROM al WHERE p <> part QUALIFY row_number() OVER (PARTITION BY design, slot ORDER BY abs(delta) DESC, p) <= 3),
ds AS (SELECT a.design, a.slot AS i, b.slot AS j, a.p AS to_i, b.p AS to_j FROM tp a JOIN tp b ON a.design = b.design AND a.slot < b.slot WHERE a.p % 12 <> b.p % 12)
SELECT ds.design, i, j, to_i, to_j, CAST(to_i * to_i + i * to_i - x.part * x.part - i * x.part + to_j * to_j + j * to_j - y.part * y.part - j * y.part AS BIGINT) AS delta
FROM ds JOIN s x ON x.design = ds.design AND x.slot = i JOIN s y ON y.design = ds.design AND y.slot = j""")
def double_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalitions.double_swaps(designs(spark, sf_dir).where(family_valid(F.col("slots"))), "design", _score, 3)
