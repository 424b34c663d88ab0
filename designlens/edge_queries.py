"""Queries over graphs that come as tables of nodes and edges, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.operators import edge_tables, graphs
from designlens.registry import query


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as nodes of their customer's graph; an order points to later ones that hold a part of the same size."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders").select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("node"), F.struct("o_orderdate", "o_orderkey").alias("day"))
    lines = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("node"), F.col("p_size").alias("size"))
    # a size that an order holds twice gives an edge twice, and edges are made distinct
    held = lines.join(orders, "node")
    # orders of one customer meet where they share a size; the rows of a (customer, size) are few
    earlier, later = held.selectExpr("graph", "size", "node as source", "day as d"), held.selectExpr("graph", "size", "node as target", "day as e")
    edges = earlier.join(later, ["graph", "size"]).where("d < e").select("graph", "source", "target").distinct()
    return orders.select("graph", "node"), edges


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_tables.packed(*_tables(spark, sf_dir), ["graph"])


_SQL = """
WITH RECURSIVE gn AS (SELECT o_custkey AS graph, o_orderkey AS node, o_orderdate AS day FROM orders), sz AS (
  SELECT DISTINCT l_orderkey AS node, p_size AS size FROM lineitem JOIN part ON l_partkey = p_partkey
), ge AS (
  SELECT DISTINCT a.graph, a.node AS source, b.node AS target FROM gn a JOIN gn b ON a.graph = b.graph AND (a.day < b.day OR (a.day = b.day AND a.node < b.node))
  JOIN sz x ON x.node = a.node JOIN sz y ON y.node = b.node AND x.size = y.size
), di(graph, node, len) AS (
  SELECT graph, node, 0 FROM gn UNION SELECT ge.graph, target, len + 1 FROM di JOIN ge ON di.graph = ge.graph AND di.node = source
), du(graph, node, len) AS (
  SELECT graph, node, 0 FROM gn UNION SELECT ge.graph, source, len + 1 FROM du JOIN ge ON du.graph = ge.graph AND du.node = target
), sh(graph, node, len) AS (
  SELECT graph, node, 0 FROM gn WHERE NOT EXISTS (SELECT 1 FROM ge WHERE ge.graph = gn.graph AND ge.source = gn.node)
  UNION SELECT ge.graph, source, len + 1 FROM sh JOIN ge ON sh.graph = ge.graph AND sh.node = target
), a AS (SELECT graph, node, max(len) AS din FROM di GROUP BY ALL), b AS (SELECT graph, node, max(len) AS dout FROM du GROUP BY ALL), c AS (SELECT graph, node, min(len) AS short FROM sh GROUP BY ALL),
pr AS (SELECT ge.graph, target AS node, count(*) AS n_in, string_agg(CAST(din AS VARCHAR), ',' ORDER BY din) AS pred FROM ge JOIN a ON ge.graph = a.graph AND source = a.node GROUP BY ALL),
su AS (SELECT ge.graph, source AS node, count(*) AS n_out, string_agg(CAST(dout AS VARCHAR), ',' ORDER BY dout) AS succ FROM ge JOIN b ON ge.graph = b.graph AND target = b.node GROUP BY ALL),
nt AS (
  SELECT a.graph, a.node, row_number() OVER (PARTITION BY a.graph ORDER BY din, a.node) - 1 AS place, din, dout, short, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(pred, '') AS pred, coalesce(succ, '') AS succ,
         CASE WHEN coalesce(n_in, 0) = 0 THEN 'IN' WHEN coalesce(n_out, 0) = 0 THEN 'OUT' WHEN n_in = 1 THEN 'NOT' ELSE 'NOR' END AS type
  FROM a JOIN b ON a.graph = b.graph AND a.node = b.node JOIN c ON a.graph = c.graph AND a.node = c.node LEFT JOIN pr ON a.graph = pr.graph AND a.node = pr.node LEFT JOIN su ON a.graph = su.graph AND a.node = su.node
), pl AS (
  SELECT ge.graph, s.place AS i, t.place AS j FROM ge JOIN nt s ON s.graph = ge.graph AND s.node = source JOIN nt t ON t.graph = ge.graph AND t.node = target
)"""


@query(f"""{_SQL} SELECT 'depth_out=' || dout || '|depth_in=' || din || '|n_in=' || n_in || '|n_out=' || n_out || '|type=' || type || '|pred_depths=' || pred || '|succ_depths=' || succ AS fingerprint, count(*) AS n, CAST(sum(short) AS BIGINT) AS shortest FROM nt GROUP BY 1""")
def edge_table_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graphs.node_table(_packed(spark, sf_dir), ["graph"], "nodes", edge_tables.linked)
    return nodes.groupBy("fingerprint").agg(F.count("*").alias("n"), F.sum("shortest_out").alias("shortest"))


@query(f"""{_SQL}, gs AS (SELECT graph, count(*) AS n_nodes, CAST(sum(n_in) AS BIGINT) AS n_edges, count(*) FILTER (type IN ('NOT', 'NOR')) AS energy, CAST(max(din) AS INT) AS depth FROM nt GROUP BY graph) SELECT n_nodes, n_edges, energy, depth, count(*) AS n FROM gs GROUP BY ALL""")
def edge_table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graphs.node_table(_packed(spark, sf_dir), ["graph"], "nodes", edge_tables.linked)
    depth = nodes.groupBy("graph").agg(F.max("depth_in").alias("depth"))
    return graphs.graph_sizes(nodes, ["graph"]).join(depth, "graph").groupBy("n_nodes", "n_edges", "energy", "depth").agg(F.count("*").alias("n"))


def _refined(k: int) -> str:
    last, name = ("nt", "type") if k == 1 else (f"w{k - 1}", "label")
    side = lambda own, other: f"SELECT x.graph, x.node, string_agg(o.{name}, ',' ORDER BY o.{name}) AS t FROM {last} x JOIN ge ON ge.graph = x.graph AND ge.{own} = x.node JOIN {last} o ON o.graph = ge.graph AND o.node = ge.{other} GROUP BY ALL"
    return f"p{k} AS ({side('target', 'source')}), q{k} AS ({side('source', 'target')}), w{k} AS (SELECT x.graph, x.node, sha256(x.{name} || '|' || coalesce(p.t, '') || '|' || coalesce(q.t, '')) AS label FROM {last} x LEFT JOIN p{k} p ON p.graph = x.graph AND p.node = x.node LEFT JOIN q{k} q ON q.graph = x.graph AND q.node = x.node)"


@query(f"""{_SQL}, {_refined(1)}, {_refined(2)}, {_refined(3)}, hs AS (SELECT graph, sha256(string_agg(label, ',' ORDER BY label)) AS shape FROM w3 GROUP BY graph) SELECT shape, count(*) AS n FROM hs GROUP BY shape""")
def edge_table_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).groupBy(graphs.structural_hash(F.col("nodes"), edge_tables.linked, 3).alias("shape")).agg(F.count("*").alias("n"))


def _motif_sql(k: int, view: str = "true") -> str:
    names = [f"g{i}" for i in range(k)]
    joins = " ".join(f"JOIN vw {b} ON {b}.graph = {a}.graph AND {a}.place < {b}.place" for a, b in zip(names, names[1:]))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    links = " ".join(f"LEFT JOIN pl {a}{b} ON {a}{b}.graph = g0.graph AND {a}{b}.i = {a}.place AND {a}{b}.j = {b}.place" for a, b in pairs)
    bits = " || ".join(f"CASE WHEN {a}{b}.i IS NULL THEN '0' ELSE '1' END" for a, b in pairs)
    table = ", ".join(f"('{raw}', '{motif}')" for raw, motif in sorted(graphs.iso_classes(k).items()))
    return f"""{_SQL}, vw AS (SELECT graph, place FROM nt WHERE {view}), rw AS (SELECT {bits} AS raw, count(*) AS n FROM vw g0 {joins} {links} GROUP BY ALL), iso(raw, motif) AS (VALUES {table})
SELECT motif, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_raw FROM rw JOIN iso ON rw.raw = iso.raw GROUP BY motif"""


def _motifs(spark: SparkSession, sf_dir: str, k: int, inputs: bool = True, outputs: bool = True) -> DataFrame:
    rows = _packed(spark, sf_dir)
    if not (inputs and outputs):
        rows = rows.select(graphs.internal(F.col("nodes"), edge_tables.linked, inputs, outputs).alias("nodes"))
    return graphs.motif_counts(rows, [], "nodes", edge_tables.linked, k)


@query(_motif_sql(3))
def edge_table_motifs_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motifs(spark, sf_dir, 3)


@query(_motif_sql(3, "n_in > 0"))
def edge_table_motifs_no_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motifs(spark, sf_dir, 3, inputs=False)


@query(_motif_sql(3, "n_out > 0"))
def edge_table_motifs_no_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motifs(spark, sf_dir, 3, outputs=False)


@query(_motif_sql(3, "n_in > 0 AND n_out > 0"))
def edge_table_motifs_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motifs(spark, sf_dir, 3, inputs=False, outputs=False)


@query(_motif_sql(4))
def edge_table_motifs_k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motifs(spark, sf_dir, 4)


def _cyclic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same with some edges both ways, so that some graphs have a cycle."""
    nodes, edges = _tables(spark, sf_dir)
    # both ways from one pass: a second reading of the edges would make them anew
    ways = F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
    some = F.slice(ways, 1, F.when((F.col("source") + 3 * F.col("target")) % 17 == 0, 2).otherwise(1))
    return nodes, edges.select("graph", F.inline(some))


_CYCLES = """
WITH RECURSIVE gn AS (SELECT o_custkey AS graph, o_orderkey AS node, o_orderdate AS day FROM orders), sz AS (
  SELECT DISTINCT l_orderkey AS node, p_size AS size FROM lineitem JOIN part ON l_partkey = p_partkey
), g0 AS (
  SELECT DISTINCT a.graph, a.node AS source, b.node AS target FROM gn a JOIN gn b ON a.graph = b.graph AND (a.day < b.day OR (a.day = b.day AND a.node < b.node))
  JOIN sz x ON x.node = a.node JOIN sz y ON y.node = b.node AND x.size = y.size
), ge AS (
  SELECT * FROM g0 UNION SELECT graph, target, source FROM g0 WHERE (source + 3 * target) % 17 = 0
), re(graph, source, target) AS (
  SELECT * FROM ge UNION SELECT re.graph, re.source, ge.target FROM re JOIN ge ON re.graph = ge.graph AND re.target = ge.source
), bad AS (
  SELECT graph, source AS node FROM re WHERE source = target UNION SELECT r.graph, r.target FROM re r JOIN re x ON r.graph = x.graph AND r.source = x.source AND x.source = x.target
), ok AS (SELECT gn.graph, gn.node FROM gn ANTI JOIN bad ON gn.graph = bad.graph AND gn.node = bad.node), di(graph, node, len) AS (
  SELECT graph, node, 0 FROM ok UNION SELECT ge.graph, ge.target, len + 1 FROM di JOIN ge ON di.graph = ge.graph AND di.node = ge.source SEMI JOIN ok ON ok.graph = ge.graph AND ok.node = ge.target
), lv AS (SELECT graph, node, CAST(max(len) AS INT) AS level FROM di GROUP BY ALL)"""


@query(f"""{_CYCLES} SELECT level, count(*) AS n_nodes, count(DISTINCT gn.graph) AS n_graphs FROM gn LEFT JOIN lv ON gn.graph = lv.graph AND gn.node = lv.node GROUP BY level""")
def edge_table_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edge_tables.levels(*_cyclic(spark, sf_dir), ["graph"])
    return found.groupBy("level").agg(F.count("*").alias("n_nodes"), F.count_distinct("graph").alias("n_graphs"))


@query(f"""{_CYCLES} SELECT acyclic, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_nodes FROM (SELECT gn.graph, count(*) AS k, count(lv.node) = count(*) AS acyclic FROM gn LEFT JOIN lv ON gn.graph = lv.graph AND gn.node = lv.node GROUP BY gn.graph) GROUP BY acyclic""")
def edge_table_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edge_tables.packed(*_cyclic(spark, sf_dir), ["graph"])
    return found.groupBy("acyclic").agg(F.count("*").alias("n"), F.sum(F.size("nodes")).alias("n_nodes"))
