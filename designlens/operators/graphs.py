"""Roles of nodes and structure of many small graphs at once: a row for each graph, its nodes in an array, edges from earlier to later nodes; ``edge_tables`` makes such rows of any tables of nodes and edges."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.operators.motif import Edge
from designlens.shared import once


def _places(nodes: Column) -> Column:
    return F.when(F.size(nodes) > 0, F.sequence(F.lit(0), F.size(nodes) - 1)).otherwise(F.array().cast("array<int>"))


def before(nodes: Column, i: Column, edge: Edge) -> Column:
    """Places of the nodes that point to the node at ``i``."""
    return F.filter(_places(nodes), lambda j: (j < i) & edge(F.get(nodes, j), F.get(nodes, i)))


def after(nodes: Column, i: Column, edge: Edge) -> Column:
    """Places of the nodes that the node at ``i`` points to."""
    return F.filter(_places(nodes), lambda j: (j > i) & edge(F.get(nodes, i), F.get(nodes, j)))


def depths_from_inputs(nodes: Column, edge: Edge) -> Column:
    """The longest path that ends at each node."""
    step = lambda done, i: F.array_append(done, F.coalesce(F.array_max(F.transform(before(nodes, i, edge), lambda j: F.get(done, j) + 1)), F.lit(0)))
    return F.aggregate(_places(nodes), F.array().cast("array<int>"), step)


def depths_to_outputs(nodes: Column, edge: Edge, shortest: bool = False) -> Column:
    """The longest path that starts at each node, or the shortest to a node without successors."""
    pick = F.array_min if shortest else F.array_max
    step = lambda done, i: F.concat(F.array(F.coalesce(pick(F.transform(after(nodes, i, edge), lambda j: F.get(done, j - i - 1) + 1)), F.lit(0))), done)
    return F.aggregate(F.reverse(_places(nodes)), F.array().cast("array<int>"), step)


def node_type(n_in: Column, n_out: Column) -> Column:
    return F.when(n_in == 0, "IN").when(n_out == 0, "OUT").when(n_in == 1, "NOT").otherwise("NOR")


def node_table(graphs: DataFrame, keep: list[str], nodes: str, edge: Edge) -> DataFrame:
    """A row for each node: ``keep``, slot, n_in, n_out, type, depth_in, depth_out, shortest_out, and its fingerprint with the depths of its neighbours."""
    x = F.col(nodes)
    rows = graphs.select(*keep, x.alias("nodes"), depths_from_inputs(x, edge).alias("din"), depths_to_outputs(x, edge).alias("dout"), depths_to_outputs(x, edge, True).alias("short"))
    each = rows.select("*", F.posexplode("nodes").alias("slot", "node"))
    p, s = before(F.col("nodes"), F.col("slot"), edge), after(F.col("nodes"), F.col("slot"), edge)
    each = each.withColumns({"pred": p, "succ": s}).withColumns({"n_in": F.size("pred"), "n_out": F.size("succ")})
    listed = lambda places, depths: F.array_join(F.transform(F.array_sort(F.transform(places, lambda j: F.get(depths, j))), lambda d: d.cast("string")), ",")
    at = lambda c: F.get(F.col(c), F.col("slot"))
    found = each.select(*keep, "slot", "n_in", "n_out", node_type(F.col("n_in"), F.col("n_out")).alias("type"), at("din").alias("depth_in"), at("dout").alias("depth_out"), at("short").alias("shortest_out"), listed(F.col("pred"), F.col("din")).alias("pred_depths"), listed(F.col("succ"), F.col("dout")).alias("succ_depths"))
    return found.withColumn("fingerprint", F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("depth_out", "depth_in", "n_in", "n_out", "type", "pred_depths", "succ_depths")]))


def parse_fingerprint(key: Column) -> Column:
    """The parts of a fingerprint, by name."""
    return F.str_to_map(key, F.lit(r"\|"), F.lit("="))


def graph_sizes(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """n_nodes, n_edges and energy (nodes inside, neither inputs nor outputs) of each graph of a ``node_table``."""
    return nodes.groupBy(*keep).agg(F.count("*").alias("n_nodes"), F.sum("n_in").alias("n_edges"), F.count_if(F.col("type").isin("NOT", "NOR")).alias("energy"))


def node_types(nodes: Column, edge: Edge) -> Column:
    """The type of each node."""
    return F.transform(_places(nodes), lambda i: node_type(F.size(before(nodes, i, edge)), F.size(after(nodes, i, edge))))


def edge_list(nodes: Column, edge: Edge) -> Column:
    """The edges as structs of places, which count from 0."""
    return F.flatten(F.transform(_places(nodes), lambda i: F.transform(after(nodes, i, edge), lambda j: F.struct(i.alias("source"), j.alias("target")))))


def structural_hash(nodes: Column, edge: Edge, rounds: int) -> Column:
    """A hash that graphs of the same shape share: labels refined ``rounds`` times by those of the neighbours, then sorted."""
    label = node_types(nodes, edge)
    joined = lambda labels, places: F.array_join(F.array_sort(F.transform(places, lambda j: F.get(labels, j))), ",")
    refine = lambda labels: F.transform(_places(nodes), lambda i: F.sha2(F.concat_ws("|", F.get(labels, i), joined(labels, before(nodes, i, edge)), joined(labels, after(nodes, i, edge))), 256))
    final = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), label, lambda labels, _: refine(labels))
    return F.sha2(F.array_join(F.array_sort(final), ","), 256)


def iso_classes(k: int) -> dict[str, str]:
    """Edge bits of connected graphs of k nodes (pairs of places in order) and the least adjacency string that relabelling gives."""
    pairs, out = list(combinations(range(k), 2)), {}
    for n in range(1 << len(pairs)):
        bits = format(n, f"0{len(pairs)}b")
        edges = [p for p, b in zip(pairs, bits) if b == "1"]
        reached = {0}
        for _ in range(k):
            reached |= {b for a, b in edges if a in reached} | {a for a, b in edges if b in reached}
        if len(reached) == k:
            own = set(edges)
            out[bits] = min("".join("1" if (p[i], p[j]) in own else "0" for i in range(k) for j in range(k)) for p in permutations(range(k)))
    return out


def iso_table(spark: SparkSession, k: int) -> DataFrame:
    """raw, motif: a row for each connected pattern of edge bits."""
    return spark.createDataFrame(sorted(iso_classes(k).items()), "raw string, motif string")


def connected_sets(graphs: DataFrame, keep: list[str], nodes: str, edge: Edge, k: int, also: list[str] | None = None) -> DataFrame:
    """``keep``, ``also``, own (places, ascending), raw (edge bits of its pairs): every connected set of k nodes, once.

    A set grows from its first node: of the neighbours that are open to it one joins, those before that one are shut
    out, and the new node opens those of its neighbours that no member has touched. Only connected sets are made, and
    no row leaves its task.
    """
    x, also = F.col(nodes), also or []
    succ = F.transform(_places(x), lambda i: after(x, i, edge))
    rows = graphs.select(*keep, *also, succ.alias("_succ"))
    both = F.transform("_succ", lambda own, i: F.concat(F.filter(_places(F.col("_succ")), lambda j: F.array_contains(F.get("_succ", j), i)), own))
    rows = rows.withColumn("_near", both).select("*", F.explode(_places(F.col("_succ"))).alias("_root"))
    near = F.get("_near", F.col("_root"))
    rows = rows.select("*", F.array("_root").alias("own"), F.filter(near, lambda u: u > F.col("_root")).alias("_open"), F.array_append(near, F.col("_root")).alias("_seen"))
    for _ in range(k - 1):
        rows = rows.select("*", F.posexplode("_open").alias("_at", "_new"))
        near = F.get("_near", F.col("_new"))
        fresh = F.filter(near, lambda u: (u > F.col("_root")) & ~F.array_contains("_seen", u))
        open_ = F.concat(F.slice("_open", F.col("_at") + 2, F.size("_open")), fresh)
        rows = rows.select(*keep, *also, "_succ", "_near", "_root", F.array_append("own", F.col("_new")).alias("own"), open_.alias("_open"), F.array_union("_seen", near).alias("_seen"))
    rows = rows.select(*keep, *also, "_succ", F.array_sort("own").alias("own"))
    bit = lambda a, b: F.when(F.array_contains(F.get("_succ", F.get("own", F.lit(a))), F.get("own", F.lit(b))), "1").otherwise("0")
    return rows.select(*keep, *also, "own", F.concat(*[bit(a, b) for a, b in combinations(range(k), 2)]).alias("raw"))


def sets_in_row(succ: Column, near: Column, k: int) -> Column:
    """The sets that ``connected_sets`` makes, as an array in the row of a graph of few nodes: ``succ`` and ``near`` hold the places that each node points to, and is linked with."""
    wider = lambda s, u: (F.filter(F.get(near, u), lambda v: (v > s["root"]) & ~F.array_contains(s["seen"], v)), F.array_union(s["seen"], F.get(near, u)))
    state = lambda root, own, open_, seen: F.struct(root.alias("root"), own.alias("own"), open_.alias("open"), seen.alias("seen"))

    def grown(s: Column, u: Column, at: Column) -> Column:
        fresh, seen = wider(s, u)
        return state(s["root"], F.array_append(s["own"], u), F.concat(F.slice(s["open"], at + 2, F.size(s["open"])), fresh), seen)

    found = F.transform(_places(succ), lambda r: state(r, F.array(r), F.filter(F.get(near, r), lambda u: u > r), F.array_append(F.get(near, r), r)))
    for _ in range(k - 2):
        found = F.flatten(F.transform(found, lambda s: F.transform(s["open"], lambda u, at: grown(s, u, at))))
    return F.flatten(F.transform(found, lambda s: F.transform(s["open"], lambda u: F.array_sort(F.array_append(s["own"], u)))))


def linked_places(graphs: DataFrame, keep: list[str], nodes: str, edge: Edge) -> DataFrame:
    """``keep``, succ, near: the places that each node points to, and those that it is linked with."""
    rows = once(graphs, keep, succ=F.transform(_places(F.col(nodes)), lambda i: after(F.col(nodes), i, edge)))
    both = F.transform("succ", lambda own, i: F.concat(F.filter(_places(F.col("succ")), lambda j: F.array_contains(F.get("succ", j), i)), own))
    return once(rows, [*keep, "succ"], near=both)


def shapes(graphs: DataFrame, keep: list[str], nodes: str, edge: Edge, counts: dict[str, Column]) -> DataFrame:
    """``keep``, nodes (structs place, succ), ``counts``: a row for each set of edges that graphs of ``keep`` have, not for each graph.

    What follows from the edges alone is worked out once a shape; ``edge_tables.linked`` is the edge of its nodes.
    """
    x = F.col(nodes)
    named = [*keep, *[c for c in graphs.columns if c not in keep]]
    rows = once(graphs, named, _succ=F.transform(_places(x), lambda i: after(x, i, edge)))
    found = rows.groupBy(*keep, "_succ").agg(*[c.alias(name) for name, c in counts.items()])
    return found.select(*keep, F.transform("_succ", lambda s, i: F.struct(i.alias("place"), s.alias("succ"))).alias("nodes"), *counts)


def motif_counts(graphs: DataFrame, keep: list[str], nodes: str, edge: Edge, k: int) -> DataFrame:
    """``keep``, motif, n, n_raw (patterns of the class that occur): connected induced subgraphs of k nodes, by graph.

    Patterns are counted before they meet their class.
    """
    raw = connected_sets(graphs, keep, nodes, edge, k).groupBy(*keep, "raw").agg(F.count("*").alias("n"))
    return raw.join(iso_table(graphs.sparkSession, k), "raw").groupBy(*keep, "motif").agg(F.sum("n").alias("n"), F.count("*").alias("n_raw"))


def internal(nodes: Column, edge: Edge, inputs: bool = False, outputs: bool = False) -> Column:
    """The nodes of a view: without inputs and outputs, unless they are asked for."""
    has = lambda i: (F.lit(inputs) | (F.size(before(nodes, i, edge)) > 0)) & (F.lit(outputs) | (F.size(after(nodes, i, edge)) > 0))
    return F.transform(F.filter(_places(nodes), has), lambda i: F.get(nodes, i))
