"""Queries of graph roles, motifs of four and five nodes, and comparisons of designs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.design_queries import _GRAPHS, _MOTIFS, _edge, _graphs, motif_log_odds
from designlens.operators import compare, graphs, tiers
from designlens.operators.edge_tables import linked
from designlens.registry import _CUTS, _PRED, _predicted, query
from designlens.sources.designs import SQL, designs

_NODES = f"""{_GRAPHS}, di(design, node, len) AS (
  SELECT d.design, slot, 0 FROM d JOIN gn ON d.design = gn.design UNION SELECT ge.design, j, len + 1 FROM di JOIN ge ON di.design = ge.design AND di.node = i
), du(design, node, len) AS (
  SELECT d.design, slot, 0 FROM d JOIN gn ON d.design = gn.design UNION SELECT ge.design, i, len + 1 FROM du JOIN ge ON du.design = ge.design AND du.node = j
), sh(design, node, len) AS (
  SELECT d.design, slot, 0 FROM d JOIN gn ON d.design = gn.design WHERE NOT EXISTS (SELECT 1 FROM ge WHERE ge.design = gn.design AND ge.i = gn.slot)
  UNION SELECT ge.design, i, len + 1 FROM sh JOIN ge ON sh.design = ge.design AND sh.node = j
), a AS (SELECT design, node, max(len) AS din FROM di GROUP BY ALL), b AS (SELECT design, node, max(len) AS dout FROM du GROUP BY ALL), c AS (SELECT design, node, min(len) AS short FROM sh GROUP BY ALL),
pr AS (SELECT ge.design, j AS node, count(*) AS n_in, string_agg(CAST(din AS VARCHAR), ',' ORDER BY din) AS pred FROM ge JOIN a ON ge.design = a.design AND i = a.node GROUP BY ALL),
su AS (SELECT ge.design, i AS node, count(*) AS n_out, string_agg(CAST(dout AS VARCHAR), ',' ORDER BY dout) AS succ FROM ge JOIN b ON ge.design = b.design AND j = b.node GROUP BY ALL),
nt AS (
  SELECT a.design, a.node AS slot, din, dout, short, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(pred, '') AS pred, coalesce(succ, '') AS succ,
         CASE WHEN coalesce(n_in, 0) = 0 THEN 'IN' WHEN coalesce(n_out, 0) = 0 THEN 'OUT' WHEN n_in = 1 THEN 'NOT' ELSE 'NOR' END AS type
  FROM a JOIN b ON a.design = b.design AND a.node = b.node JOIN c ON a.design = c.design AND a.node = c.node LEFT JOIN pr ON a.design = pr.design AND a.node = pr.node LEFT JOIN su ON a.design = su.design AND a.node = su.node
)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.node_table(_graphs(spark, sf_dir), ["design", "gate_count"], "nodes", _edge)


@query(f"""{_NODES} SELECT 'depth_out=' || dout || '|depth_in=' || din || '|n_in=' || n_in || '|n_out=' || n_out || '|type=' || type || '|pred_depths=' || pred || '|succ_depths=' || succ AS fingerprint, count(*) AS n, CAST(sum(short) AS BIGINT) AS shortest FROM nt GROUP BY 1""")
def node_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).groupBy("fingerprint").agg(F.count("*").alias("n"), F.sum("shortest_out").alias("shortest"))


@query(f"""{_NODES} SELECT type, CASE WHEN dout = 0 THEN 'end' WHEN dout = 1 THEN 'late' WHEN dout = 2 THEN 'middle' ELSE 'early' END AS place, count(*) AS n FROM nt GROUP BY ALL""")
def position_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = graphs.parse_fingerprint(F.col("fingerprint"))
    depth = known["depth_out"].cast("int")
    place = F.when(depth == 0, "end").when(depth == 1, "late").when(depth == 2, "middle").otherwise("early")
    return _nodes(spark, sf_dir).groupBy(known["type"].alias("type"), place.alias("place")).agg(F.count("*").alias("n"))


@query(f"""{_NODES}, gs AS (SELECT design, count(*) AS n_nodes, CAST(sum(n_in) AS BIGINT) AS n_edges, count(*) FILTER (type IN ('NOT', 'NOR')) AS energy FROM nt GROUP BY design) SELECT n_nodes, n_edges, energy, count(*) AS n FROM gs GROUP BY ALL""")
def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.graph_sizes(_nodes(spark, sf_dir), ["design"]).groupBy("n_nodes", "n_edges", "energy").agg(F.count("*").alias("n"))


def _refined(k: int) -> str:
    last = "nt" if k == 1 else f"w{k - 1}"
    name = "type" if k == 1 else "label"
    side = lambda a, b: f"coalesce((SELECT string_agg(o.{name}, ',' ORDER BY o.{name}) FROM ge JOIN {last} o ON o.design = ge.design AND o.slot = ge.{b} WHERE ge.design = x.design AND ge.{a} = x.slot), '')"
    return f"w{k} AS (SELECT x.design, x.slot, sha256(x.{name} || '|' || {side('j', 'i')} || '|' || {side('i', 'j')}) AS label FROM {last} x)"


@query(f"""{_NODES}, {_refined(1)}, {_refined(2)}, {_refined(3)}, hs AS (SELECT design, sha256(string_agg(label, ',' ORDER BY label)) AS shape FROM w3 GROUP BY design) SELECT shape, count(*) AS n FROM hs GROUP BY shape""")
def structural_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = graphs.shapes(_graphs(spark, sf_dir), [], "nodes", _edge, {"n": F.count("*")})
    return known.groupBy(graphs.structural_hash(F.col("nodes"), linked, 3).alias("shape")).agg(F.sum("n").alias("n"))


def _motif_sql(k: int) -> str:
    names = [f"g{i}" for i in range(k)]
    joins = " ".join(f"JOIN gn {b} ON {b}.design = {a}.design AND {a}.slot < {b}.slot" for a, b in zip(names, names[1:]))
    bits = " || ".join(f"CASE WHEN ({a}.node + {b}.node) % 3 = 0 THEN '1' ELSE '0' END" for i, a in enumerate(names) for b in names[i + 1 :])
    table = ", ".join(f"('{raw}', '{motif}')" for raw, motif in sorted(graphs.iso_classes(k).items()))
    return f"""{_GRAPHS}, rw AS (SELECT d.gate_count, {bits} AS raw, count(*) AS n, count(DISTINCT d.design) AS n_designs FROM d JOIN gn g0 ON d.design = g0.design {joins} GROUP BY ALL), iso(raw, motif) AS (VALUES {table})
SELECT gate_count, motif, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_raw FROM rw JOIN iso ON rw.raw = iso.raw GROUP BY gate_count, motif"""


@query(_motif_sql(4))
def motif_counts_k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.motif_counts(_graphs(spark, sf_dir), ["gate_count"], "nodes", _edge, 4)


@query(_motif_sql(5))
def motif_counts_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.motif_counts(_graphs(spark, sf_dir), ["gate_count"], "nodes", _edge, 5)


@query(f"""{_NODES}, it AS (SELECT nt.design, nt.slot, gn.node FROM nt JOIN gn ON nt.design = gn.design AND nt.slot = gn.slot WHERE type IN ('NOT', 'NOR')),
tr AS (SELECT a.design, (a.node + b.node) % 3 = 0 AS ab, (a.node + c.node) % 3 = 0 AS ac, (b.node + c.node) % 3 = 0 AS bc FROM it a JOIN it b ON a.design = b.design AND a.slot < b.slot JOIN it c ON a.design = c.design AND b.slot < c.slot)
SELECT gate_count, CASE WHEN ab AND ac AND bc THEN '000100110' WHEN ab AND ac THEN '000000110' WHEN ab AND bc THEN '000001100' ELSE '000100100' END AS motif, count(*) AS n
FROM tr JOIN d ON tr.design = d.design WHERE CAST(ab AS INT) + CAST(ac AS INT) + CAST(bc AS INT) >= 2 GROUP BY ALL""")
def motif_counts_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _graphs(spark, sf_dir).select("gate_count", graphs.internal(F.col("nodes"), _edge).alias("nodes"))
    return graphs.motif_counts(view, ["gate_count"], "nodes", _edge, 3).drop("n_raw")


@query(f"""{_MOTIFS}, {_CUTS}, ti AS (SELECT design, d.gate_count, circuit >= top_10 AS is_top, circuit <= bot_10 AS is_bottom FROM d JOIN cu ON d.gate_count = cu.gate_count),
sz AS (SELECT gate_count, count(*) FILTER (is_top) AS n_top, count(*) FILTER (is_bottom) AS n_bottom FROM ti GROUP BY gate_count),
ow AS (SELECT ti.gate_count, motif, count(*) FILTER (is_top) AS top_with, count(*) FILTER (is_bottom) AS bottom_with FROM mt JOIN ti ON mt.design = ti.design WHERE is_top OR is_bottom GROUP BY ALL),
lo AS (SELECT ow.gate_count, motif, CASE WHEN top_with > 0 AND bottom_with > 0 THEN round(log2((top_with / n_top) / (bottom_with / n_bottom)), 6) END AS log_odds FROM ow JOIN sz ON ow.gate_count = sz.gate_count)
SELECT gate_count, CASE WHEN log_odds > 0 THEN 'up' ELSE 'down' END AS direction, CAST(row_number() OVER w AS INT) AS rank, motif, log_odds FROM lo WHERE log_odds IS NOT NULL AND log_odds <> 0
WINDOW w AS (PARTITION BY gate_count, log_odds > 0 ORDER BY abs(log_odds) DESC, motif) QUALIFY row_number() OVER w <= 2""")
def top_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.top_both_ways(motif_log_odds(spark, sf_dir), ["gate_count"], "log_odds", "motif", 2)


@query(f"""{SQL}, x AS (SELECT d.*, CAST(z AS DOUBLE) AS z FROM d JOIN (SELECT design, sum(part) AS z FROM s GROUP BY design) q ON d.design = q.design),
m AS (SELECT topology, count(*) AS n, corr(circuit, growth) AS xy, corr(circuit, z) AS xz, corr(growth, z) AS yz FROM x GROUP BY topology)
SELECT topology, n, CASE WHEN n >= 3 AND sqrt((1 - xz * xz) * (1 - yz * yz)) > 1e-12 THEN round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) END AS partial_r FROM m""")
def partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("slots", F.lit(0), lambda a, p: a + p).cast("double")
    d = designs(spark, sf_dir).select("topology", F.col("circuit").cast("double").alias("circuit"), F.col("growth").cast("double").alias("growth"), total.alias("z"))
    return compare.partial_correlation(d, ["topology"], "circuit", "growth", "z")


def _front_sql(name: str, x: str) -> str:
    return f"{name} AS (SELECT topology, design FROM (SELECT *, max(growth) OVER (PARTITION BY topology ORDER BY {x} DESC, growth DESC, design ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM pg) WHERE b IS NULL OR growth > b)"


@query(f"""{SQL}, {_PRED}, pg AS (SELECT pd.*, growth FROM pd JOIN d ON pd.design = d.design), {_front_sql('fa', 'circuit')}, {_front_sql('fp', 'predicted')}
SELECT fa.topology, count(*) AS n_actual, round(count(fp.design) / count(*), 6) AS recall FROM fa LEFT JOIN fp ON fa.design = fp.design GROUP BY fa.topology""")
def pareto_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predicted(spark, sf_dir).join(designs(spark, sf_dir).select("design", "growth"), "design")
    return compare.front_recall(p, ["topology"], ("circuit", "growth"), ("predicted", "growth"), "design")


_ANCHOR = "an AS (SELECT topology, min(design) AS design FROM d GROUP BY topology)"


@query(f"""{SQL}, {_PRED}, {_ANCHOR} SELECT o.topology, an.design AS chosen, count(*) FILTER (p.predicted > o.predicted) + 1 AS rank FROM an JOIN pd o ON o.design = an.design JOIN pd p ON p.topology = an.topology GROUP BY o.topology, an.design""")
def design_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predicted(spark, sf_dir)
    chosen = p.groupBy("topology").agg(F.min(F.struct("design", "predicted")).alias("m")).select("topology", "m.*")
    return compare.rank_of(p, chosen, ["topology"], "predicted", "design")


@query(f"""{SQL}, {_ANCHOR}, hd AS (
  SELECT an.design AS anchor, o.design AS other, count(*) FILTER (x.part <> y.part) AS distance FROM an JOIN d o ON o.topology = an.topology AND o.design <> an.design JOIN s x ON x.design = an.design JOIN s y ON y.design = o.design AND y.slot = x.slot GROUP BY ALL
), ro AS (
  SELECT anchor, other, CAST(distance AS INT) AS distance, abs(o.circuit - a.circuit) AS gap, unnest(list_filter([CASE WHEN abs(o.growth - a.growth) * 20 <= a.growth AND o.circuit < a.circuit THEN 'logic_failure' END, CASE WHEN abs(o.circuit - a.circuit) * 5 <= a.circuit AND o.growth < a.growth THEN 'growth_failure' END,
         CASE WHEN distance <= 2 AND o.circuit < a.circuit THEN 'near_miss' END], lambda x: x IS NOT NULL)) AS role
  FROM hd JOIN d o ON o.design = other JOIN d a ON a.design = anchor
)
SELECT anchor, role, count(*) AS n_fit, first(distance ORDER BY distance, gap, other) AS distance, first(other ORDER BY distance, gap, other) AS other FROM ro GROUP BY anchor, role""")
def matched_comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir).select("topology", "design", "slots", "circuit", "growth")
    anchors = d.groupBy("topology").agg(F.min(F.struct("design", "slots", "circuit", "growth")).alias("m")).select("topology", "m.*")
    gap = lambda c: F.abs(F.col(c) - F.col(f"anchor_{c}"))
    worse = lambda c: F.col(c) < F.col(f"anchor_{c}")
    roles = {
        "logic_failure": (gap("growth") * 20 <= F.col("anchor_growth")) & worse("circuit"),
        "growth_failure": (gap("circuit") * 5 <= F.col("anchor_circuit")) & worse("growth"),
        "near_miss": (F.col("distance") <= 2) & worse("circuit"),
    }
    return compare.comparators(d, anchors, ["topology"], "design", "slots", roles, gap("circuit"))


@query(f"""{SQL}, tv AS (SELECT gate_count, 'circuit' AS task, CAST(circuit AS DOUBLE) AS y FROM d UNION ALL SELECT gate_count, 'circuit_ln', ln(greatest(CAST(circuit AS DOUBLE), 1e-6)) FROM d UNION ALL SELECT gate_count, 'growth', CAST(growth AS DOUBLE) FROM d UNION ALL SELECT gate_count, 'growth_ln', ln(greatest(CAST(growth AS DOUBLE), 1e-6)) FROM d)
SELECT gate_count, task, count(*) AS n, round(avg(y), 4) AS mean, round(max(y), 4) AS most FROM tv GROUP BY ALL""")
def task_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = compare.task_views(designs(spark, sf_dir), ["gate_count"], ["circuit", "growth"], 1e-6)
    return views.groupBy("gate_count", "task").agg(F.count("*").alias("n"), F.round(F.avg("y"), 4).alias("mean"), F.round(F.max("y"), 4).alias("most"))


@query(f"""{SQL}, {_CUTS} SELECT d.gate_count, v.tier, count(*) FILTER (circuit >= v.cut) AS n, round(count(*) FILTER (circuit >= v.cut) / count(*), 6) AS share, round(v.nominal, 6) AS nominal
FROM d JOIN cu ON d.gate_count = cu.gate_count CROSS JOIN LATERAL (VALUES ('01', top_01, 0.01::DOUBLE), ('05', top_05, 0.05::DOUBLE), ('10', top_10, 0.1::DOUBLE), ('25', top_25, 0.25::DOUBLE)) v(tier, cut, nominal) GROUP BY d.gate_count, v.tier, v.nominal""")
def tier_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.tier_shares(designs(spark, sf_dir), "gate_count", "circuit")


@query(f"""{SQL}, h AS (SELECT gate_count, CAST(least(greatest(floor((growth - 200) / 5), 0), 99) AS BIGINT) AS bin, count(*) AS n FROM d GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY gate_count ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY gate_count) AS total FROM h)
SELECT gate_count, percent, round(200 + 5.0::DOUBLE * (bin + (percent / 100 * total - (upto - n)) / n), 6) AS value FROM u CROSS JOIN (SELECT CAST(unnest([1, 5, 10, 25, 50, 75, 90, 95, 99]) AS DOUBLE) AS percent) p
WHERE percent / 100 * total <= upto AND percent / 100 * total > upto - n""")
def histogram_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = tiers.histogram(designs(spark, sf_dir), ["gate_count"], "growth", 200, 5, 100)
    return tiers.histogram_percentiles(hist, ["gate_count"], 200, 5, [1, 5, 10, 25, 50, 75, 90, 95, 99])
