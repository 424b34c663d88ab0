"""Queries of cohorts, percentile sweeps, graphs and attributions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.functions.slots import family_valid
from designlens.operators import attribution, cohort, motif, pareto, tiers
from designlens.registry import _CUTS, _FRONT, _front, query
from designlens.sources.designs import SQL, TARGETS_SQL, design_graphs, designs, targets


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = designs(spark, sf_dir).join(targets(spark), "group_no").withColumn("preferred", (F.col("variant") == "F") & (F.col("design") % 32 == 0))
    order = [F.col("preferred").desc(), F.pmod(F.col("design") * 7919, F.lit(10007)), F.col("design")]
    return cohort.cohort_topn(each, ["target", "gate_count"], order, 20).select("target", "gate_count", "design", "preferred", "rank")


_COHORT = f"""{SQL}, {TARGETS_SQL}, co AS (
  SELECT target, gate_count, design, variant = 'F' AND design % 32 = 0 AS preferred,
         CAST(row_number() OVER (PARTITION BY target, gate_count ORDER BY variant = 'F' AND design % 32 = 0 DESC, (design * 7919) % 10007, design) AS INT) AS rank
  FROM d JOIN tg ON d.group_no = tg.group_no
)"""


@query(f"{_COHORT} SELECT * FROM co WHERE rank <= 20")
def cohort_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cohort(spark, sf_dir)


@query(f"{_COHORT} SELECT design, string_agg(DISTINCT target, ',' ORDER BY target) AS selected_for, min(rank) AS best_rank, bool_or(preferred) AS preferred FROM co WHERE rank <= 20 GROUP BY design")
def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.source_merge(_cohort(spark, sf_dir), "design", "target", "preferred")


@query(f"""{SQL}, {TARGETS_SQL}, n AS (SELECT target, gate_count, count(DISTINCT topology) AS n FROM d JOIN tg ON d.group_no = tg.group_no GROUP BY ALL)
SELECT g.target, g.gate_count, coalesce(n, 0) AS n FROM (SELECT DISTINCT target, CAST(k AS INT) AS gate_count FROM tg CROSS JOIN range(3, 9) r(k)) g
LEFT JOIN n ON g.target = n.target AND g.gate_count = n.gate_count""")
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = designs(spark, sf_dir).select("topology", "gate_count", "group_no").distinct().join(targets(spark), "group_no")
    return cohort.coverage(known, targets(spark), list(range(3, 9)), "target", "gate_count", "topology")


_BEST = f"""{SQL}, tk AS (SELECT *, row_number() OVER (PARTITION BY topology, variant ORDER BY circuit DESC, design) AS r FROM d),
me AS (SELECT topology, variant, max(circuit) AS max_x, avg(growth) AS mean_y, sum(circuit) FILTER (r <= 10) / count(*) FILTER (r <= 10) AS top_x FROM tk GROUP BY topology, variant),
be AS (SELECT topology, first(variant ORDER BY max_x DESC, variant) AS best_max, first(variant ORDER BY top_x DESC, variant) AS best_top, first(variant ORDER BY mean_y DESC, variant) AS best_mean FROM me GROUP BY topology),
ag AS (SELECT *, best_max = best_top AS max_top, best_max = best_mean AS max_mean, best_top = best_mean AS top_mean, best_max = best_top AND best_max = best_mean AS all_agree FROM be)"""


@query(f"{_BEST} SELECT * FROM ag")
def best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = cohort.variant_metrics(designs(spark, sf_dir), ["topology"], "variant", "circuit", "growth", "design")
    return cohort.best_variants(metrics, ["topology"], "variant")


@query(f"{_BEST} SELECT count(*) AS n, " + ", ".join(f"round(avg(CAST({f} AS DOUBLE)), 6) AS {f}" for f in ("max_top", "max_mean", "top_mean", "all_agree")) + " FROM ag")
def best_variant_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.agreement_rates(best_variants(spark, sf_dir))


@query(f"""{SQL}, {_CUTS}, va AS (SELECT design, count(DISTINCT part % 12) = count(*) AS ok FROM s GROUP BY design)
SELECT d.gate_count, CASE WHEN NOT ok THEN 'family' WHEN variant = 'P' THEN 'variant' WHEN circuit < top_25 THEN 'score' WHEN growth < 300 THEN 'growth' ELSE 'kept' END AS reason, count(*) AS n
FROM d JOIN va ON d.design = va.design JOIN cu ON d.gate_count = cu.gate_count GROUP BY ALL""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir)
    cut = d.join(tiers.tier_thresholds(d, "gate_count", "circuit"), "gate_count")
    rules = {"family": family_valid(F.col("slots")), "variant": F.col("variant") != "P", "score": F.col("circuit") >= F.col("top_25"), "growth": F.col("growth") >= 300}
    return cohort.rejections(cut, rules, ["gate_count"])


_SWEEP = f"""{SQL}, ro AS (SELECT gate_count, growth, row_number() OVER (PARTITION BY gate_count ORDER BY growth) AS r, count(*) OVER (PARTITION BY gate_count) AS total FROM d),
sw AS (SELECT gate_count, round(a / 2.0, 1) AS percent, growth AS value FROM ro JOIN range(0, 201) x(a) ON r = greatest(1, (a * total + 199) // 200))"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.percentile_sweep(designs(spark, sf_dir), ["gate_count"], "growth", 200)


@query(f"{_SWEEP} SELECT CAST(gate_count AS INT) AS gate_count, CAST(percent AS DOUBLE) AS percent, value FROM sw")
def percentile_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


@query(f"""{_SWEEP}, mx AS (SELECT topology, gate_count, CAST(floor(avg(growth)) AS BIGINT) AS score FROM d GROUP BY ALL),
rk AS (SELECT topology, score, max(percent) FILTER (value <= score) AS lo, max(value) FILTER (value <= score) AS vlo, min(value) FILTER (value > score) AS vhi FROM mx JOIN sw ON mx.gate_count = sw.gate_count GROUP BY topology, score)
SELECT topology, score, round(CASE WHEN lo IS NULL THEN 0.0 WHEN vhi IS NULL THEN 100.0 ELSE CAST(lo AS DOUBLE) + 0.5 * (score - vlo) / (vhi - vlo) END, 6) AS percent FROM rk""")
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = designs(spark, sf_dir).groupBy("topology", "gate_count").agg(F.floor(F.avg("growth")).alias("score"))
    return tiers.percentile_rank(means, _sweep(spark, sf_dir), ["gate_count"], "topology", "score", 200)


@query(f"""{SQL}, {_FRONT}, fl AS (SELECT *, round(0.5 * circuit / max(circuit) OVER () + 0.5 * growth / max(growth) OVER (), 9) AS combined FROM fr WHERE growth >= 300)
SELECT topology, design, combined, CAST(row_number() OVER (ORDER BY combined DESC, design) AS INT) AS rank FROM fl ORDER BY combined DESC, design LIMIT 40""")
def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.portfolio(_front(spark, sf_dir).where("growth >= 300"), "circuit", "growth", ["topology", "design"], 40)


@query(f"""{SQL}, {_CUTS}, c AS (
  SELECT part, count(*) FILTER (circuit >= top_05) AS n_top, count(*) FILTER (circuit <= bot_05) AS n_bottom FROM s JOIN cu ON s.gate_count = cu.gate_count GROUP BY part)
SELECT CAST(p AS INT) AS part, coalesce(n_top, 0) AS n_top, coalesce(n_bottom, 0) AS n_bottom, coalesce(n_top + n_bottom, 0) AS total FROM range(1, 26) r(p) LEFT JOIN c ON part = p""")
def part_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir)
    cut = d.join(tiers.tier_thresholds(d, "gate_count", "circuit"), "gate_count").where("circuit >= top_05 or circuit <= bot_05")
    each = cut.select(F.explode("slots").alias("part"), (F.col("circuit") >= F.col("top_05")).alias("top"), (F.col("circuit") <= F.col("bot_05")).alias("bottom"))
    n = each.groupBy("part").agg(F.count_if("top").alias("n_top"), F.count_if("bottom").alias("n_bottom"))
    out = spark.range(1, 26).select(F.col("id").cast("int").alias("part")).join(n, "part", "left").fillna(0)
    return out.withColumn("total", F.col("n_top") + F.col("n_bottom"))


def _edge(a, b):
    return (a + b) % 3 == 0


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs with the suppliers of their lines as nodes, in slot order."""
    return design_graphs(spark, sf_dir).select("design", "nodes", "gate_count", "circuit")


_GRAPHS = f"""{SQL}, gn AS (
  SELECT l_orderkey AS design, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS slot, l_suppkey AS node FROM lineitem SEMI JOIN part ON l_partkey = p_partkey
), ge AS (
  SELECT d.design, gate_count, a.slot AS i, b.slot AS j FROM d JOIN gn a ON d.design = a.design JOIN gn b ON d.design = b.design AND a.slot < b.slot WHERE (a.node + b.node) % 3 = 0
)"""
_MOTIFS = f"""{_GRAPHS}, tr AS (
  SELECT a.design, (a.node + b.node) % 3 = 0 AS ab, (a.node + c.node) % 3 = 0 AS ac, (b.node + c.node) % 3 = 0 AS bc
  FROM gn a JOIN gn b ON a.design = b.design AND a.slot < b.slot JOIN gn c ON a.design = c.design AND b.slot < c.slot
), mt AS (
  SELECT d.design, gate_count, CASE WHEN ab AND ac AND bc THEN '000100110' WHEN ab AND ac THEN '000000110' WHEN ab AND bc THEN '000001100' ELSE '000100100' END AS motif, count(*) AS n
  FROM tr JOIN d ON tr.design = d.design WHERE CAST(ab AS INT) + CAST(ac AS INT) + CAST(bc AS INT) >= 2 GROUP BY ALL
)"""


def _motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif.motifs_of_three(_graphs(spark, sf_dir), ["design", "gate_count"], "nodes", _edge)


@query(f"{_MOTIFS} SELECT * FROM mt")
def motif_counts_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motifs(spark, sf_dir)


@query(f"""{_MOTIFS} SELECT mt.gate_count, motif, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_with, round(count(*) / any_value(k), 6) AS rate
FROM mt JOIN (SELECT gate_count, count(*) AS k FROM d GROUP BY gate_count) z ON mt.gate_count = z.gate_count GROUP BY mt.gate_count, motif""")
def motif_presence_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = designs(spark, sf_dir).groupBy("gate_count").agg(F.count("*").alias("k"))
    own = _motifs(spark, sf_dir).groupBy("gate_count", "motif").agg(F.sum("n").alias("n"), F.count("*").alias("n_with"))
    return own.join(sizes, "gate_count").select("gate_count", "motif", "n", "n_with", F.round(F.col("n_with") / F.col("k"), 6).alias("rate"))


@query(f"""{_MOTIFS}, {_CUTS}, ti AS (SELECT design, d.gate_count, circuit >= top_10 AS is_top, circuit <= bot_10 AS is_bottom FROM d JOIN cu ON d.gate_count = cu.gate_count),
sz AS (SELECT gate_count, count(*) FILTER (is_top) AS n_top, count(*) FILTER (is_bottom) AS n_bottom FROM ti GROUP BY gate_count),
ow AS (SELECT ti.gate_count, motif, count(*) FILTER (is_top) AS top_with, count(*) FILTER (is_bottom) AS bottom_with FROM mt JOIN ti ON mt.design = ti.design WHERE is_top OR is_bottom GROUP BY ALL)
SELECT ow.*, n_top, n_bottom, CASE WHEN top_with > 0 AND bottom_with > 0 THEN round(log2((top_with / n_top) / (bottom_with / n_bottom)), 6) END AS log_odds FROM ow JOIN sz ON ow.gate_count = sz.gate_count""")
def motif_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir)
    cut = d.join(tiers.tier_thresholds(d, "gate_count", "circuit"), "gate_count")
    tier = cut.select("design", "gate_count", (F.col("circuit") >= F.col("top_10")).alias("is_top"), (F.col("circuit") <= F.col("bot_10")).alias("is_bottom"))
    return motif.tier_log_odds(_motifs(spark, sf_dir).select("design", "motif"), tier, "design", ["gate_count"])


@query(f"""{_GRAPHS}, pa(design, node, len) AS (
  SELECT d.design, slot, 0 FROM d JOIN gn ON d.design = gn.design UNION SELECT ge.design, j, len + 1 FROM pa JOIN ge ON pa.design = ge.design AND pa.node = i
), de AS (SELECT design, max(len) AS depth FROM pa GROUP BY design)
SELECT gate_count, CAST(depth AS INT) AS depth, count(*) AS n FROM de JOIN d ON de.design = d.design GROUP BY ALL""")
def graph_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graphs(spark, sf_dir).groupBy("gate_count", motif.depth(F.col("nodes"), _edge).alias("depth")).agg(F.count("*").alias("n"))


_score = attribution.Additive(lambda p, i: p * p + i * p)


def _swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.swaps(designs(spark, sf_dir).where(family_valid(F.col("slots"))), "design", _score)


def _contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.contrast(designs(spark, sf_dir).where(family_valid(F.col("slots"))), "design", _score)


_SWAPS = f"""{SQL}, fv AS (SELECT design FROM s GROUP BY design HAVING count(DISTINCT part % 12) = count(*)),
al AS (
  SELECT s.design, s.slot, s.part, CAST(p AS INT) AS p, CAST(p * p + s.slot * p - s.part * s.part - s.slot * s.part AS BIGINT) AS delta
  FROM s SEMI JOIN fv ON s.design = fv.design CROSS JOIN range(1, 26) r(p)
  WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.design = s.design AND o.slot <> s.slot AND o.part % 12 = p % 12)
), ph AS (SELECT design, slot, round(-sum(delta) / count(*), 6) AS phi FROM al GROUP BY design, slot)"""


@query(f"{_SWAPS} SELECT * FROM ph")
def replacement_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contrast(spark, sf_dir).drop("part")


@query(f"""{_SWAPS} SELECT design, slot, CAST(row_number() OVER w AS INT) AS rank, p AS to_part, delta FROM al WHERE p <> part
WINDOW w AS (PARTITION BY design, slot ORDER BY abs(delta) DESC, p) QUALIFY row_number() OVER w <= 3""")
def single_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.top_swaps(_swaps(spark, sf_dir), "design", 3)


@query(f"{_SWAPS} SELECT design, slot, CASE WHEN sum(abs(phi)) OVER w > 0 THEN round(phi / sum(abs(phi)) OVER w, 6) ELSE 0.0 END AS fraction FROM ph WINDOW w AS (PARTITION BY design)")
def fraction_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.fractions(replacement_contrast(spark, sf_dir), "design")
