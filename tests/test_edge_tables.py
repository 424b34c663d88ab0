"""Graphs from tables of nodes and edges: order, cycles, and connected sets against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from designlens.operators import edge_tables, graphs

NODES, EDGES = "graph string, node long", "graph string, source long, target long"


def made(name, n, degree, seed):
    """A directed graph without cycles whose ids say nothing about its order."""
    r = random.Random(seed)
    ids = r.sample(range(1000), n)
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(n * degree // 2)}
    edges = [(name, ids[a], ids[b]) for a, b in pairs]
    return [(name, i) for i in ids], r.sample(edges, len(edges))


def tables(spark, *graphs_):
    nodes, edges = [x for g in graphs_ for x in g[0]], [x for g in graphs_ for x in g[1]]
    random.Random(0).shuffle(nodes)
    return spark.createDataFrame(nodes, NODES).repartition(3), spark.createDataFrame(edges, EDGES).repartition(3)


def plain_levels(nodes, edges):
    done, left, level = {}, set(nodes), 0
    while True:
        ready = {v for v in left if all(s in done for s, t in edges if t == v)}
        if not ready:
            return done | dict.fromkeys(left)
        done |= dict.fromkeys(ready, level)
        left, level = left - ready, level + 1


def test_levels_and_order_with_shuffled_ids_cycles_and_odd_rows(spark):
    a, b = made("a", 20, 3, 1), made("b", 9, 2, 2)
    cycle = ([("c", 1), ("c", 2), ("c", 3), ("c", 4), ("c", 9)], [("c", 1, 2), ("c", 2, 3), ("c", 3, 2), ("c", 3, 4)])
    odd = ([("d", 5), ("d", 5), ("d", None)], [("d", 7, 5), ("d", 7, 5), ("d", None, 5), ("d", 8, 8)])
    nodes, edges = tables(spark, a, b, cycle, odd)
    rows = {r.graph: r for r in edge_tables.packed(nodes, edges, ["graph"]).collect()}
    found = {(r.graph, r.node): r.level for r in edge_tables.levels(nodes, edges, ["graph"]).collect()}
    assert {g: r.acyclic for g, r in rows.items()} == {"a": True, "b": True, "c": False, "d": False}
    for name, g in {"a": a, "b": b, "c": cycle, "d": ([("d", 5), ("d", 7), ("d", 8)], [("d", 7, 5), ("d", 8, 8)])}.items():
        own, links = {v for _, v in g[0]}, {(s, t) for _, s, t in g[1]}
        depth = plain_levels(own, links)
        assert {v: d for (n, v), d in found.items() if n == name} == depth
        packed = rows[name].nodes
        assert [x.place for x in packed] == list(range(len(own)))
        assert [x.node for x in packed] == sorted(own, key=lambda v: (depth[v] is None, depth[v] or 0, v))
        assert {(x.node, packed[j].node) for x in packed for j in x.succ} == links
    assert edge_tables.packed(nodes.where("1 = 0"), edges.where("1 = 0"), ["graph"]).count() == 0
    assert edge_tables.levels(nodes.where("1 = 0"), edges.where("1 = 0"), ["graph"]).count() == 0
    alone = edge_tables.packed(nodes.where("graph = 'b'"), edges.where("1 = 0"), ["graph"]).first()
    assert len(alone.nodes) == 9 and alone.acyclic


def plain_sets(n, links, k):
    near = {v: {a if b == v else b for a, b in links if v in (a, b)} for v in range(n)}

    def connected(s):
        reached, todo = {s[0]}, [s[0]]
        while todo:
            new = (near[todo.pop()] & set(s)) - reached
            reached |= new
            todo += new
        return len(reached) == k

    return {s for s in combinations(range(n), k) if connected(s)}


@pytest.mark.parametrize("n, k", [(30, 3), (30, 4), (60, 3)])
def test_connected_sets_of_larger_graphs(spark, n, k):
    row = edge_tables.packed(*tables(spark, made("g", n, 3, n)), ["graph"])
    nodes = row.first().nodes
    links = {(x.place, j) for x in nodes for j in x.succ}
    sets = [tuple(r.own) for r in graphs.connected_sets(row, ["graph"], "nodes", edge_tables.linked, k).collect()]
    assert len(sets) == len(set(sets)) and set(sets) == plain_sets(n, links, k)
    classes, expected = graphs.iso_classes(k), {}
    for s in sets:
        raw = "".join("1" if p in links else "0" for p in combinations(s, 2))
        expected.setdefault(classes[raw], []).append(raw)
    counts = graphs.motif_counts(row, ["graph"], "nodes", edge_tables.linked, k).collect()
    assert {(r.motif, r.n, r.n_raw) for r in counts} == {(m, len(raws), len(set(raws))) for m, raws in expected.items()}
    assert k < 4 or any(r.n_raw > 1 for r in counts)  # three nodes in topological order have one pattern a class


def test_relabelled_graphs_share_hash_and_roles(spark):
    nodes, edges = made("x", 12, 3, 5)
    name = {v: 5000 - 7 * v for _, v in nodes}
    twin = ([("y", name[v]) for _, v in nodes], [("y", name[s], name[t]) for _, s, t in edges])
    other = (twin[0], twin[1][1:])
    other = ([("z", v) for _, v in other[0]], [("z", s, t) for _, s, t in other[1]])
    rows = edge_tables.packed(*tables(spark, (nodes, edges), twin, other), ["graph"])
    shape = {r.graph: r.h for r in rows.select("graph", graphs.structural_hash(F.col("nodes"), edge_tables.linked, 3).alias("h")).collect()}
    assert shape["x"] == shape["y"] != shape["z"]
    roles = graphs.node_table(rows, ["graph"], "nodes", edge_tables.linked).groupBy("graph").agg(F.sort_array(F.collect_list("fingerprint")).alias("f"))
    roles = {r.graph: r.f for r in roles.collect()}
    assert roles["x"] == roles["y"] != roles["z"]
