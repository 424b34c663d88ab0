"""Queries of variance by sets of slots, sampled attribution and sampled spaces, and their SQL."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.analysis_queries import _COALITIONS, POOL, _square
from designlens.functions.slots import family_valid
from designlens.operators import coalitions, pair_ridge, spaces, variance
from designlens.registry import query
from designlens.sources.designs import SQL, designs

#: Orderings of a sampled attribution, each with its reverse.
SAMPLES, SEED = 12, 7

_LATTICE = f"""{SQL}, mo AS (SELECT topology, count(*) AS n, avg(growth) AS m, var_pop(growth) AS v FROM d GROUP BY topology),
ce AS (
  SELECT s.topology, s.design, any_value(s.growth) AS growth, m AS mask, string_agg(CAST(part AS VARCHAR), ',' ORDER BY slot) AS cell
  FROM s JOIN range(1, 128) r(m) ON bit_count(m) <= 3 AND m < (1 << s.gate_count) AND (m >> slot) % 2 = 1 GROUP BY s.topology, s.design, m
), cm AS (SELECT topology, mask, cell, count(*) AS k, avg(growth) AS mean FROM ce GROUP BY ALL),
sh AS (SELECT cm.topology, mask, sum(k * (mean - m) ** 2) / max(n) / max(v) AS share FROM cm JOIN mo ON cm.topology = mo.topology GROUP BY ALL),
ef AS (
  SELECT a.topology, a.mask, any_value(a.share) AS together, sum(CASE WHEN (bit_count(a.mask) - bit_count(b.mask)) % 2 = 0 THEN b.share ELSE -b.share END) AS effect
  FROM sh a JOIN sh b ON a.topology = b.topology AND (a.mask & b.mask) = b.mask GROUP BY a.topology, a.mask
)"""


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variance.subset_effects(designs(spark, sf_dir), ["topology"], "growth", 3)


@query(f"""{_LATTICE} SELECT topology, array_to_string(list_filter(range(0, 7), lambda i: (mask >> i) % 2 = 1), ',') AS own, CAST(bit_count(mask) AS INT) AS size, round(together, 6) AS together, round(effect, 6) AS effect FROM ef""")
def sobol_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array_join(F.transform("own", lambda i: i.cast("string")), ",")
    return _effects(spark, sf_dir).select("topology", own.alias("own"), "size", F.round("together", 6).alias("together"), F.round("effect", 6).alias("effect"))


@query(f"""{_LATTICE}, os AS (SELECT topology, CAST(bit_count(mask) AS INT) AS size, sum(effect) AS share FROM ef GROUP BY ALL) SELECT topology, size, round(share, 5) AS share FROM os UNION ALL SELECT topology, 4, round(1 - sum(share), 5) FROM os GROUP BY topology""")
def sobol_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variance.order_shares(_effects(spark, sf_dir), ["topology"], 3).withColumn("share", F.round("share", 5))


@query(f"""{_COALITIONS}, od AS (
  SELECT n, m AS sample, i AS slot, row_number() OVER (PARTITION BY n, m ORDER BY md5('{SEED}-' || m || '-' || i)) AS p FROM range(1, 8) u(n), range(0, {SAMPLES}) w(m), range(0, 7) r(i) WHERE i < n
), bo AS (
  SELECT n, sample, 0 AS back, slot, p FROM od UNION ALL SELECT n, sample, 1, slot, n + 1 - p FROM od
), st AS (
  SELECT *, sum(1 << slot) OVER (PARTITION BY n, sample, back ORDER BY p) AS mask FROM bo
), gn AS (
  SELECT cl.design, sample, slot, vs[CAST(mask AS BIGINT) + 1] - vs[CAST(mask AS BIGINT) - (1 << slot) + 1] AS gain FROM cl JOIN st ON cl.n = st.n
), dr AS (SELECT design, slot, sample, CASE WHEN count(gain) = count(*) THEN avg(gain) END AS g FROM gn GROUP BY ALL)
SELECT design, CAST(slot AS INT) AS slot, CASE WHEN count(g) = count(*) THEN round(avg(g), 3) END AS phi, CASE WHEN count(g) = count(*) THEN round(stddev_samp(g) / sqrt(count(*)), 3) END AS error FROM dr GROUP BY design, slot""")
def shapley_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir).where(family_valid(F.col("slots")))
    best = d.groupBy("topology").agg(F.min(F.struct((-F.col("circuit")).alias("by"), "design", "slots")).alias("b")).select("topology", "b.design", "b.slots")
    steps = coalitions.orderings(spark, 7, SAMPLES, SEED)
    mixed = coalitions.hybrids(best, coalitions.completion_pool(d, ["topology"], "design", POOL), ["topology"], "design", 12, steps)
    out = coalitions.shapley_sampled(coalitions.coalition_values(mixed, "design", _square), steps, "design")
    return out.withColumns({c: F.round(c, 3) for c in ("phi", "error")})


_LIBRARY = "li AS (SELECT DISTINCT CAST(substr(p_brand, 7, 3) AS INT) AS part, CAST(substr(p_brand, 7, 3) AS INT) % 12 AS family FROM part)"


def _space(spark: SparkSession, sf_dir: str, slots: int) -> spaces.Space:
    library = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.substring("p_brand", 7, 3).cast("int").alias("part"))
    return spaces.library_space(library, "part", F.col("part") % 12, slots)


@query(f"""WITH RECURSIVE {_LIBRARY}, fa AS (SELECT row_number() OVER (ORDER BY family) AS j, count(*) AS k FROM li GROUP BY family),
w(j, r, n) AS (
  SELECT 0::BIGINT, r, CASE WHEN r = 0 THEN 1::BIGINT ELSE 0 END FROM range(0, 8) t(r)
  UNION ALL
  SELECT w.j + 1, w.r, w.n + k * coalesce(lag(w.n) OVER (ORDER BY w.r), 0) FROM w JOIN fa ON fa.j = w.j + 1
) SELECT CAST(r AS INT) AS slots, CAST(n * CAST(factorial(CAST(r AS INT)) AS BIGINT) AS BIGINT) AS n FROM w WHERE r > 0 AND j = (SELECT max(j) FROM fa)""")
def space_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _space(spark, sf_dir, 1)
    return spark.createDataFrame([(k, spaces.Space(own.families, k).size()) for k in range(1, 8)], "slots int, n bigint")


#: Slots and rows of the sample.
SAMPLED_SLOTS, SAMPLED_ROWS = 4, 5000
_NAMES = [f"l{i}" for i in range(SAMPLED_SLOTS)]
_ORDERED = factorial(SAMPLED_SLOTS)


@query(f"""WITH {_LIBRARY}, co AS (
  SELECT row_number() OVER (ORDER BY {", ".join(f"{a}.family, {a}.part" for a in _NAMES)}) - 1 AS c, [{", ".join(f"{a}.part" for a in _NAMES)}] AS parts FROM {", ".join(f"li {a}" for a in _NAMES)} WHERE {" AND ".join(f"{a}.family < {b}.family" for a, b in zip(_NAMES, _NAMES[1:]))}
), pe AS (
  SELECT row_number() OVER (ORDER BY {", ".join(f"i{i}" for i in range(SAMPLED_SLOTS))}) - 1 AS p, [{", ".join(f"i{i}" for i in range(SAMPLED_SLOTS))}] AS own
  FROM {", ".join(f"range(1, {SAMPLED_SLOTS + 1}) r{i}(i{i})" for i in range(SAMPLED_SLOTS))} WHERE len(list_distinct([{", ".join(f"i{i}" for i in range(SAMPLED_SLOTS))}])) = {SAMPLED_SLOTS}
), z AS (SELECT count(*) * {_ORDERED} AS size FROM co), b AS (
  SELECT id, least(size, {SAMPLED_ROWS}) AS m, size, id * size // least(size, {SAMPLED_ROWS}) AS lo, (id + 1) * size // least(size, {SAMPLED_ROWS}) AS hi FROM z, range(0, {SAMPLED_ROWS}) r(id) WHERE id < size
), pl AS (SELECT CAST(CASE WHEN size <= {SAMPLED_ROWS} THEN id ELSE lo + (id * {spaces.SPREAD}) % {spaces.WORD} % (hi - lo) END AS BIGINT) AS place FROM b)
SELECT place, array_to_string(list_transform(own, lambda i: parts[i]), '-') AS assignment FROM pl JOIN co ON c = place // {_ORDERED} JOIN pe ON p = place % {_ORDERED}""")
def assignment_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spaces.sampled_space(spark, _space(spark, sf_dir, SAMPLED_SLOTS), SAMPLED_ROWS)
    return rows.select("place", F.array_join(F.transform("slots", lambda p: p.cast("string")), "-").alias("assignment"))


#: Penalty of the ridge fits.
PENALTY = 3.0
_DET3 = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
_A = ["aa", "ab", "ac", "ab", "bb", "bc", "ac", "bc", "cc"]
_B = ["ya", "yb", "yc"]


def _cramer(column: int) -> str:
    own = [_B[i // 3] if i % 3 == column else x for i, x in enumerate(_A)]
    return f"({_DET3.format(*own)}) / ({_DET3.format(*_A)})"


@query(f"""{SQL}, fe AS (
  SELECT d.topology, CAST(d.growth AS DOUBLE) AS y, max(CASE WHEN slot = 0 THEN part % 2 END)::DOUBLE AS a, max(CASE WHEN slot = 1 THEN part % 2 END)::DOUBLE AS b FROM d JOIN s ON s.design = d.design GROUP BY d.design, d.topology, d.growth
), ce AS (
  SELECT topology, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b, a * b - avg(a * b) OVER w AS c FROM fe WINDOW w AS (PARTITION BY topology)
), mo AS (
  SELECT topology, count(*) AS n, sum(y * y) AS yy, sum(a * y) AS ya, sum(b * y) AS yb, sum(c * y) AS yc, sum(a * a) + {PENALTY}::DOUBLE AS aa, sum(b * b) + {PENALTY}::DOUBLE AS bb, sum(c * c) + {PENALTY}::DOUBLE AS cc, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * c) AS bc FROM ce GROUP BY topology
), so AS (
  SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ma, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS mb, {_cramer(0)} AS fa, {_cramer(1)} AS fb, {_cramer(2)} AS fc FROM mo
), ct AS (
  SELECT ce.topology, sum((ce.y - ma * a - mb * b) ** 2) AS em, sum((ce.y - fa * a - fb * b - fc * c) ** 2) AS ef, max(yy) AS yy, any_value(so.n) AS n FROM ce JOIN so ON ce.topology = so.topology GROUP BY ce.topology
) SELECT topology, n, 0.0::DOUBLE AS null_r2, round(1 - em / yy, 6) AS main_r2, round(1 - ef / yy, 6) AS full_r2 FROM ct""")
def ridge_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the growth the parity of two slots' parts explains: nothing, each alone, and with their pair."""
    odd = lambda i: F.get("slots", F.lit(i)) % 2 == 1
    rows = designs(spark, sf_dir).select("topology", "growth", odd(0).alias("a"), odd(1).alias("b"))
    own = F.array(F.when(F.col("a"), 0), F.when(F.col("b"), 1), F.when(F.col("a") & F.col("b"), 2))
    main = pair_ridge.ridge_by_gradients(rows, ["topology"], F.array_compact(F.slice(own, 1, 2)), "growth", 2, PENALTY)
    full = pair_ridge.ridge_by_gradients(rows, ["topology"], F.array_compact(own), "growth", 3, PENALTY)
    both = main.select("topology", "n", F.lit(0.0).alias("null_r2"), F.round("r2", 6).alias("main_r2"))
    return both.join(full.select("topology", F.round("r2", 6).alias("full_r2")), "topology")
