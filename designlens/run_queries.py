"""Queries of motif rates by tier, incremental runs and counted streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.operators import graphs, incremental, motif, tiers
from designlens.registry import _CUTS, query
from designlens.shared import shared_path
from designlens.sources.designs import SQL, designs
from designlens.streaming import counts

_TIERS = [f"n_{side}_{t:02d}" for side in ("top", "bot") for t in tiers.TIERS]
_TAILS = [f"{t:02d}" for t in tiers.TIERS]


def _topology_motifs(spark: SparkSession, k: int) -> DataFrame:
    """group_no, motif of a graph over the slots of each topology."""
    places = F.transform(F.sequence(F.lit(0), F.floor((F.col("id") - 1) / 5).cast("int") - 1), lambda i: F.struct(i.alias("place"), F.col("id").alias("g")))
    rows = spark.range(20, 41).select(F.col("id").cast("int").alias("group_no"), places.alias("nodes"))
    return graphs.motif_counts(rows, ["group_no"], "nodes", lambda a, b: (a["place"] * b["place"] + 2 * a["place"] + a["g"]) % 3 == 0, k)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir)
    return tiers.tier_counts(d, "gate_count", "group_no", "circuit")


_MOTIFS = f"""{SQL}, {_CUTS}, tc AS (
  SELECT d.gate_count, d.group_no, {", ".join(f"count(*) FILTER (circuit >= top_{t}) AS n_top_{t}, count(*) FILTER (circuit <= bot_{t}) AS n_bot_{t}" for t in _TAILS)} FROM d JOIN cu ON d.gate_count = cu.gate_count GROUP BY ALL
), lg AS (UNPIVOT tc ON {", ".join(_TIERS)} INTO NAME tier VALUE n), eg AS (
  SELECT g AS group_no, i, j FROM range(20, 41) r(g), range(0, 7) a(i), range(0, 7) b(j) WHERE i < j AND j < (g - 1) // 5 AND (i * j + 2 * i + g) % 3 = 0
), tr AS (
  SELECT g AS group_no, EXISTS (SELECT 1 FROM eg WHERE group_no = g AND eg.i = x AND eg.j = y) AS ab, EXISTS (SELECT 1 FROM eg WHERE group_no = g AND eg.i = x AND eg.j = z) AS ac, EXISTS (SELECT 1 FROM eg WHERE group_no = g AND eg.i = y AND eg.j = z) AS bc
  FROM range(20, 41) r(g), range(0, 7) a(x), range(0, 7) b(y), range(0, 7) c(z) WHERE x < y AND y < z AND z < (g - 1) // 5
), pm AS (
  SELECT DISTINCT group_no, CASE WHEN ab AND ac AND bc THEN '000100110' WHEN ab AND ac THEN '000000110' WHEN ab AND bc THEN '000001100' ELSE '000100100' END AS motif FROM tr WHERE CAST(ab AS INT) + CAST(ac AS INT) + CAST(bc AS INT) >= 2
)"""


def _rates_sql(group: str) -> str:
    g, on, given = (f"{group}, ", f"x.{group} = h.{group} AND ", f"lg.{group}, ") if group else ("", "", "")
    return f"""{_MOTIFS}, tt AS (SELECT {g}tier, count(*) AS n_graphs, CAST(sum(n) AS BIGINT) AS n_designs FROM lg GROUP BY ALL),
he AS (SELECT {given}motif, tier, count(*) AS n_with, CAST(sum(n) AS BIGINT) AS with_motif, count(*) FILTER (n > 0) AS tier_graphs FROM lg JOIN pm ON lg.group_no = pm.group_no GROUP BY ALL),
ra AS (SELECT x.*, m.motif, coalesce(n_with, 0) AS n_with, coalesce(with_motif, 0) AS with_motif, round(coalesce(with_motif, 0) / nullif(n_designs, 0), 9) AS rate, coalesce(tier_graphs, 0) AS tier_graphs
  FROM tt x CROSS JOIN (SELECT DISTINCT motif FROM pm) m LEFT JOIN he h ON {on}x.tier = h.tier AND m.motif = h.motif)"""


def _rates(spark: SparkSession, sf_dir: str, group: list[str]) -> DataFrame:
    return motif.tier_rates(_topology_motifs(spark, 3), _counts(spark, sf_dir), "group_no", group, _TIERS)


@query(f"{_rates_sql('gate_count')} SELECT gate_count, motif, tier, n_graphs, n_with, n_designs, with_motif, rate, tier_graphs FROM ra")
def motif_rates_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir, ["gate_count"])


@query(f"{_rates_sql('')} SELECT motif, tier, n_graphs, n_with, n_designs, with_motif, rate, tier_graphs FROM ra")
def motif_rates_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir, [])


def _odds_sql(group: str) -> str:
    at = lambda side, t: f"max(rate) FILTER (tier = 'n_{side}_{t}')"
    odds = ", ".join(f"CASE WHEN {at('top', t)} > 0 AND {at('bot', t)} > 0 THEN round(log2({at('top', t)} / {at('bot', t)}), 6) END AS log_odds_{t}" for t in _TAILS)
    g = f"{group}, " if group else ""
    return f"{_rates_sql(group)} SELECT {g}motif, {odds} FROM ra GROUP BY {g}motif"


@query(_odds_sql("gate_count"))
def motif_tail_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif.tail_odds(_rates(spark, sf_dir, ["gate_count"]), ["gate_count"], _TAILS, "n_top", "n_bot")


@query(_odds_sql(""))
def motif_tail_odds_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif.tail_odds(_rates(spark, sf_dir, []), [], _TAILS, "n_top", "n_bot")


@query(f"{SQL} SELECT topology, variant, count(*) AS n, CAST(sum(circuit // 1000) AS BIGINT) AS score, CASE WHEN variant = 'F' THEN 'first' ELSE 'second' END AS run FROM d GROUP BY ALL")
def incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of (topology, variant) in two runs over one store: the second computes only what the first has not."""
    path, d = shared_path(spark, "scores"), designs(spark, sf_dir)
    compute = lambda rows: rows.groupBy("topology", "variant").agg(F.count("*").alias("n"), F.sum(F.expr("circuit div 1000")).alias("score"))
    for run, rows in (("first", d.where("variant = 'F'")), ("second", d), ("second", d)):
        incremental.score_pending(rows, ["topology", "variant"], compute, path, run)
    return incremental.results(spark, path, compute(d).schema)


def _histogram(rows: DataFrame) -> DataFrame:
    return tiers.histogram(rows, ["event_type"], "value", 0, 5, 20)


@query("SELECT event_type, CAST(least(greatest(floor(value / 5), 0), 19) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL")
def event_histogram_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of event values, counted as a stream of the table's files (a pattern, as the table may be one file)."""
    source, path = f"{sf_dir}/events.parquet", shared_path(spark, "stream")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")
    counts.count_stream(stream, _histogram, f"{path}/counts", f"{path}/checkpoint").awaitTermination()
    return counts.merged(spark, f"{path}/counts", ["event_type", "bin"])
