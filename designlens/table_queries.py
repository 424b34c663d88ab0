"""Queries of grids, attributions by group, functions, spaces and encodings, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from designlens import edge_queries
from designlens.analysis_queries import _COALITIONS, _occurrence_sql, occurrence_log_odds, shapley_pair
from designlens.design_queries import _GRAPHS, _SWAPS, _contrast, _edge, _graphs
from designlens.functions import adjacency, slots, truth
from designlens.graph_queries import _NODES
from designlens.operators import attribution, cohort, expectations, graphs, grids, ridge
from designlens.operators.ranks import quantiles
from designlens.registry import QUERIES, _presence_sql, presence_enrichment, query
from designlens.sources.designs import SQL, designs, targets

PLACES = ["early", "middle", "late", "end"]
_PLACED = f"""{_NODES}, pl AS (
  SELECT s.*, dout, CASE WHEN dout = 0 THEN 'end' WHEN dout = 1 THEN 'late' WHEN dout = 2 THEN 'middle' ELSE 'early' END AS place FROM s JOIN nt ON s.design = nt.design AND s.slot = nt.slot
)"""


def _place(depth: Column) -> Column:
    return F.when(depth == 0, "end").when(depth == 1, "late").when(depth == 2, "middle").otherwise("early")


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graphs(spark, sf_dir).select("design", graphs.depths_to_outputs(F.col("nodes"), _edge).alias("depths"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each slot of each design with its part and its depth."""
    d = designs(spark, sf_dir).join(_depths(spark, sf_dir), "design")
    rows = d.select("topology", "design", "growth", F.posexplode(F.arrays_zip("slots", "depths")).alias("slot", "x"))
    return rows.select("topology", "design", "growth", "slot", F.col("x.slots").alias("part"), F.col("x.depths").alias("depth"))


@query(f"""{_PLACED}, gc AS (SELECT part, place, avg(growth) AS mean, count(*) AS n FROM pl GROUP BY ALL)
SELECT part, """ + ", ".join(f"round(max(mean) FILTER (place = '{p}'), 6) AS mean_{p}, coalesce(max(n) FILTER (place = '{p}'), 0) AS n_{p}" for p in PLACES) + ", round(median(mean), 6) AS middle FROM gc GROUP BY part")
def part_place_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir).withColumn("place", _place(F.col("depth")))
    return grids.grid_of_means(rows, "part", "place", PLACES, "growth").withColumns({c: F.round(c, 6) for c in [f"mean_{p}" for p in PLACES] + ["middle"]})


_CELLS = f"{SQL}, ce AS (SELECT part, slot, avg(growth) AS cell FROM s GROUP BY ALL)"


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs(spark, sf_dir).select("topology", "gate_count", "circuit", "growth", F.posexplode("slots").alias("slot", "part"))


@query(f"{_CELLS} SELECT part, count(*) AS n_places, round(avg(cell), 6) AS mean, round(stddev_samp(cell), 6) AS sd, round(max(cell) - min(cell), 6) AS spread FROM ce GROUP BY part")
def position_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grids.position_dependence(_slots(spark, sf_dir), "part", "slot", "growth")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "spread")})


@query(f"""{_CELLS}, bo AS (SELECT 'part' AS factor, CAST(part AS VARCHAR) AS level, cell FROM ce UNION ALL SELECT 'slot', CAST(slot AS VARCHAR), cell FROM ce),
tt AS (SELECT factor, var_pop(cell) * count(*) AS ss, avg(cell) AS m FROM bo GROUP BY factor), lv AS (SELECT factor, level, count(*) AS k, avg(cell) AS lm FROM bo GROUP BY ALL)
SELECT lv.factor, round(sum(k * (lm - m) ** 2) / max(ss), 6) AS eta2 FROM lv JOIN tt ON lv.factor = tt.factor GROUP BY lv.factor""")
def variance_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.explained(_slots(spark, sf_dir), "part", "slot", "growth").withColumn("eta2", F.round("eta2", 6))


@query(f"""SELECT p.role, count(*) AS n, count(*) FILTER (log2_ratio * log_odds < 0) AS sign_flips, round(max(abs(log_odds - log2_ratio)), 6) AS max_change, round(avg(abs(log_odds - log2_ratio)), 6) AS mean_change,
  round(min(o.top_n / nullif(top_part, 0)), 6) AS min_ratio, round(max(o.top_n / nullif(top_part, 0)), 6) AS max_ratio
FROM ({_presence_sql("", "SELECT * FROM t")} SELECT * FROM pr) p JOIN ({_occurrence_sql("", "SELECT * FROM t")}) o ON p.role = o.role AND p.part = o.part GROUP BY p.role""")
def metric_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = presence_enrichment(spark, sf_dir).select("role", "part", "log2_ratio", "top_part")
    new = occurrence_log_odds(spark, sf_dir).select("role", "part", "log_odds", "top_n")
    out = grids.migration(expectations.many_to_one(old, new, ["role", "part"]), ["role"], "log2_ratio", "log_odds", "top_part", "top_n")
    return out.withColumns({c: F.round(c, 6) for c in ("max_change", "mean_change", "min_ratio", "max_ratio")})


_PERMS = "pe AS (SELECT design, string_agg(CAST(part AS VARCHAR), '-' ORDER BY slot) AS perm FROM s GROUP BY design)"


@query(f"""{SQL}, {_PERMS}, ra AS (SELECT d.*, perm, CASE variant WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS r FROM d JOIN pe ON d.design = pe.design)
SELECT topology, perm, first(design ORDER BY r, design) AS design, min(r) AS first_rank, bool_or(variant = 'F') AS from_f, bool_or(variant = 'O') AS from_o, bool_or(variant = 'P') AS from_p, count(*) AS n_rows, max(circuit) AS circuit FROM ra GROUP BY topology, perm""")
def design_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = designs(spark, sf_dir).select("topology", slots.slots_string(F.col("slots")).alias("perm"), "variant", "design", "circuit")
    return grids.master(rows, ["topology"], "perm", "variant", {"F": 0, "O": 1, "P": 2}, "design", "circuit")


SHOWN = [1, 2, 3, 4, 5]
_PHI = f"{_SWAPS}, pp AS (SELECT ph.design, ph.slot, s.part, s.gate_count, s.variant, phi FROM ph JOIN s ON ph.design = s.design AND ph.slot = s.slot)"


@query(f"""{_PHI} SELECT design, CASE WHEN part <= 5 THEN CAST(part AS VARCHAR) ELSE 'other' END AS label, CAST(sign(phi) AS INT) AS sign, round(sum(phi), 4) AS phi, count(*) AS n FROM pp WHERE phi <> 0 GROUP BY 1, 2, 3""")
def contribution_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.contribution_stack(_contrast(spark, sf_dir), ["design"], "part", "phi", SHOWN).withColumn("phi", F.round("phi", 4))


@query(f"""{_PHI}, fa AS (SELECT *, CASE WHEN sum(abs(phi)) OVER w > 0 THEN round(phi / sum(abs(phi)) OVER w, 6) ELSE 0.0 END AS fraction FROM pp WINDOW w AS (PARTITION BY design)),
tp AS (SELECT part, count(*) AS total FROM fa GROUP BY part ORDER BY total DESC, part LIMIT 10), ce AS (SELECT part, gate_count, variant, avg(fraction) AS mean, count(*) AS n FROM fa GROUP BY ALL)
SELECT tp.part, CAST(g AS INT) AS gate_count, v AS variant, round(mean, 5) AS mean, coalesce(n, 0) AS n FROM tp CROSS JOIN range(4, 8) r(g) CROSS JOIN (VALUES ('F'), ('O'), ('P')) x(v) LEFT JOIN ce ON ce.part = tp.part AND ce.gate_count = g AND ce.variant = v""")
def contribution_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attribution.fractions(_contrast(spark, sf_dir), "design", ("part",)).join(designs(spark, sf_dir).select("design", "gate_count", "variant"), "design")
    return grids.contribution_grid(rows, "part", {"gate_count": [4, 5, 6, 7], "variant": ["F", "O", "P"]}, "fraction", 10).withColumn("mean", F.round(F.col("mean") * 100_000) / 100_000)


@query(f"""{_COALITIONS}{_PLACED[len(SQL):]}, la AS (SELECT design, slot, topology, 'f' || part % 12 || '@' || dout AS label FROM pl),
sx AS (SELECT design, i, j, CASE WHEN odd = 0 THEN round(phi, 4) END AS phi FROM sp),
wi AS (SELECT x.topology, least(x.label, y.label) AS first, greatest(x.label, y.label) AS second, avg(phi) AS own FROM sx JOIN la x ON sx.design = x.design AND i = x.slot JOIN la y ON sx.design = y.design AND j = y.slot GROUP BY 1, 2, 3)
SELECT first, second, count(*) AS n_groups, round(avg(own), 1) AS mean, count(DISTINCT sign(own)) = 1 AS consistent, round(sum(abs(own)), 1) AS strength FROM wi GROUP BY first, second""")
def pair_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("f"), (F.col("part") % 12).cast("string"), F.lit("@"), F.col("depth").cast("string"))
    named = _placed(spark, sf_dir).select("topology", "design", "slot", label.alias("label"))
    pairs = shapley_pair(spark, sf_dir).join(named.withColumnsRenamed({"slot": "i", "label": "a"}), ["design", "i"]).join(named.drop("topology").withColumnsRenamed({"slot": "j", "label": "b"}), ["design", "j"])
    return grids.pair_consensus(pairs, "topology", "a", "b", "phi").withColumns({c: F.round(c, 1) for c in ("mean", "strength")})


_MAPS = ", ".join(f"({m}, {i}, {r})" for m, own in enumerate(truth.input_maps(3)) for i, r in enumerate(own))


@query(f"""WITH fm(m, i, r) AS (VALUES {_MAPS}), fu AS (SELECT CAST(p_partkey % 256 AS INT) AS f, count(*) AS k FROM part GROUP BY 1),
fv AS (SELECT f, m, sum(((f >> r) & 1) << i) AS v FROM fu, fm GROUP BY f, m), fc AS (SELECT f, CAST(min(least(v, 255 - v)) AS INT) AS label FROM fv GROUP BY f)
SELECT label, count(*) AS n_items, CAST(sum(k) AS BIGINT) AS n_rows FROM fc JOIN fu ON fc.f = fu.f GROUP BY label""")
def function_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 256).cast("int").alias("f"))
    return grids.class_rollup(rows, "f", truth.function_class(F.col("f"), 3))


@query("""WITH fu AS (SELECT CAST(p_partkey % 256 AS INT) AS f, count(*) AS n_parts FROM part GROUP BY 1)
SELECT f, n_parts, lpad(bin(f), 8, '0') AS bits, CAST(bit_count(f) AS INT) AS ones, (f & 85) <> ((f >> 1) & 85) AS depends_0, (f & 51) <> ((f >> 2) & 51) AS depends_1, (f & 15) <> ((f >> 4) & 15) AS depends_2,
       (f >> 1) & 1 = (f >> 2) & 1 AND (f >> 1) & 1 = (f >> 4) & 1 AND (f >> 3) & 1 = (f >> 5) & 1 AND (f >> 3) & 1 = (f >> 6) & 1 AS symmetric FROM fu""")
def function_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("f")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy((F.col("p_partkey") % 256).cast("int").alias("f")).agg(F.count("*").alias("n_parts"))
    return rows.select("f", "n_parts", truth.bit_text(f, 3).alias("bits"), F.bit_count(f).cast("int").alias("ones"), *[truth.depends_on(f, k, 3).alias(f"depends_{k}") for k in range(3)], truth.symmetric(f, 3).alias("symmetric"))


@query(f"""SELECT motif, n, n_edges, CAST(max_in AS INT) AS max_in, CAST(max_out AS INT) AS max_out, n_edges = 3 AND max_in <= 1 AND max_out <= 1 AS linear FROM (
  SELECT motif, n, CAST(length(replace(motif, '0', '')) AS INT) AS n_edges,
         greatest({", ".join("length(replace(substr(motif, " + str(4 * i + 1) + ", 4), '0', ''))" for i in range(4))}) AS max_out,
         greatest({", ".join(" + ".join(f"CAST(substr(motif, {4 * i + j + 1}, 1) AS INT)" for i in range(4)) for j in range(4))}) AS max_in
  FROM ({edge_queries._motif_sql(4)}))""")
def motif_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("motif")
    n = edge_queries.edge_table_motifs_k4(spark, sf_dir)
    return n.select("motif", "n", adjacency.edges(key).alias("n_edges"), F.array_max(adjacency.in_degrees(key)).alias("max_in"), F.array_max(adjacency.out_degrees(key)).alias("max_out"), adjacency.linear(key).alias("linear"))


@query(f"""WITH mo AS ({edge_queries._motif_sql(4)}), sh AS (SELECT *, length(replace(motif, '0', '')) = 3 AND greatest({", ".join("length(replace(substr(motif, " + str(4 * i + 1) + ", 4), '0', ''))" for i in range(4))}) <= 1
  AND greatest({", ".join(" + ".join(f"CAST(substr(motif, {4 * i + j + 1}, 1) AS INT)" for i in range(4)) for j in range(4))}) <= 1 AS linear FROM mo)
SELECT motif, n, CAST(row_number() OVER (ORDER BY n DESC, motif) AS INT) AS rank FROM sh WHERE NOT linear AND n >= 5""")
def branched_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs of four nodes that are no chain and occur five times or more, by how often they do."""
    table = edge_queries.edge_table_motifs_k4(spark, sf_dir).where(~adjacency.linear(F.col("motif")) & (F.col("n") >= 5))
    # a row for each class of four nodes
    return table.select("motif", "n", F.row_number().over(Window.orderBy(F.desc("n"), "motif")).alias("rank"))


@query(f"""{_PLACED} SELECT design, '[' || string_agg(CAST(part AS VARCHAR), ' ' ORDER BY slot) || ']' AS listed, string_agg(CAST(part AS VARCHAR), '-' ORDER BY slot) AS parsed, string_agg(CAST(slot * 25 + part - 1 AS VARCHAR), ' ' ORDER BY slot) AS ones,
  CAST((max(part) FILTER (slot = 0) - 1) * 25 + max(part) FILTER (slot = 1) - 1 AS INT) AS cell, string_agg('p' || part, ' ' ORDER BY slot) AS names, string_agg(CAST(part AS VARCHAR), ' ' ORDER BY dout DESC, slot) AS deepest FROM pl GROUP BY design""")
def slot_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, text = F.col("slots"), lambda x: F.array_join(F.transform(x, lambda p: p.cast("string")), " ")
    rows = designs(spark, sf_dir).join(_depths(spark, sf_dir), "design").select("*", F.concat(F.lit("["), text(own), F.lit("]")).alias("listed"))
    return rows.select(
        "design", "listed", slots.slots_string(slots.slots_of_text(F.col("listed"))).alias("parsed"), text(slots.feature_ids(own, 25)).alias("ones"), slots.joint_cell(own, 0, 1, 25).alias("cell"),
        text(slots.named(own, [f"p{i}" for i in range(1, 26)])).alias("names"), text(slots.deepest_first(own, F.col("depths"))).alias("deepest"),
    )


def _space_sql(k: int) -> str:
    names = [f"l{i}" for i in range(k)]
    apart = " AND ".join(f"{a}.family <> {b}.family" for i, a in enumerate(names) for b in names[i + 1 :]) or "true"
    return f"SELECT {k} AS slots, count(*) AS n FROM {', '.join('li ' + a for a in names)} WHERE {apart}"


@query("WITH li AS (SELECT DISTINCT CAST(substr(p_brand, 7, 3) AS INT) AS part, CAST(substr(p_brand, 7, 3) AS INT) % 12 AS family FROM part) " + " UNION ALL ".join(_space_sql(k) for k in (1, 2, 3, 4)))
def assignment_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.substring("p_brand", 7, 3).cast("int").alias("part")).distinct()
    counts = [grids.assignment_space(library, "part", F.col("part") % 12, k).groupBy(F.size("slots").alias("slots")).agg(F.count("*").alias("n")) for k in (1, 2, 3, 4)]
    return reduce(DataFrame.union, counts)


@query(f"""{SQL}, tr AS (SELECT CAST(i AS INT) AS group_no FROM range(20, 41) r(i) WHERE i % 4 IN (1, 3) OR (i % 3 = 0 AND i % 4 + 1 IN (1, 3)))
SELECT topology, count(*) AS n FROM d SEMI JOIN tr ON d.group_no = tr.group_no GROUP BY topology""")
def target_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = targets(spark).groupBy("group_no").agg(F.collect_list("target").alias("targets"))
    return cohort.with_any_source(designs(spark, sf_dir).join(listed, "group_no"), "targets", ["T1", "t3"]).groupBy("topology").agg(F.count("*").alias("n"))


@query(f"""{_GRAPHS}, el AS (SELECT design, string_agg(i || '>' || j, ' ' ORDER BY i, j) AS edges, count(*) AS n_edges FROM ge GROUP BY design)
SELECT d.design, gate_count AS n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(edges, '') AS edges FROM d LEFT JOIN el ON d.design = el.design""")
def graph_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graphs(spark, sf_dir).select("design", F.size("nodes").alias("n_nodes"), graphs.edge_list(F.col("nodes"), _edge).alias("e"))
    return g.select("design", "n_nodes", F.size("e").cast("bigint").alias("n_edges"), F.array_join(F.transform("e", lambda x: F.concat_ws(">", x["source"].cast("string"), x["target"].cast("string"))), " ").alias("edges"))


@query(f"{SQL} SELECT topology, count(*) AS n, round(avg(circuit), 2) AS mean, round(median(circuit), 2) AS median, min(circuit) AS min, max(circuit) AS max, round(stddev_samp(circuit), 2) AS sd FROM d GROUP BY topology")
def score_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir)
    rest = d.groupBy("topology").agg(F.count("*").alias("n"), F.round(F.avg("circuit"), 2).alias("mean"), F.min("circuit").alias("min"), F.max("circuit").alias("max"), F.round(F.stddev_samp("circuit"), 2).alias("sd"))
    return rest.join(quantiles(d, ["topology"], "circuit", {"median": 0.5}).select("topology", F.round("median", 2).alias("median")), "topology")


def additive_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest and five least effects of parts in slots on growth, by topology; a fit has no SQL."""
    rows = designs(spark, sf_dir).select("topology", slots.feature_ids(F.col("slots"), 25).alias("ones"), "growth")
    return ridge.extremes(ridge.ridge(rows, ["topology"], "ones", "growth"), ["topology"], 5)


QUERIES["additive_fit"] = additive_fit
