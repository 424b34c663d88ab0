import json
import random
from itertools import combinations, permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from designlens.functions import adjacency, slots, truth
from designlens.operators import cohort, expectations, features, graphs, grids, ridge, typed
from designlens.sources import readers


def test_slots_of_text(spark):
    texts = ["3-1-7", "[3 1 7]", "[3, 1, 7]", "  ", "[]", "3-x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(slots.slots_of_text(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [[3, 1, 7]] * 3 + [[], [], [3, None], None]


def test_slot_views(spark):
    df = spark.createDataFrame([([3, 1, 2], [0, 2, 2])], "a array<int>, d array<int>")
    row = df.select(slots.differing(F.col("a"), F.array(F.lit(3), F.lit(2), F.lit(2))).alias("m"), slots.feature_ids(F.col("a"), 5).alias("f"), slots.joint_cell(F.col("a"), 0, 1, 5).alias("c"), slots.named(F.col("a"), ["p", "q"]).alias("n"), slots.deepest_first(F.col("a"), F.col("d")).alias("o")).first()
    assert tuple(row) == ([False, True, False], [2, 5, 11], 10, [None, "p", "q"], [1, 2, 3])


def test_function_classes_are_the_fourteen_of_three_inputs(spark):
    rows = spark.range(256).select(F.col("id").cast("int").alias("f")).select("f", truth.function_class(F.col("f"), 3).alias("c"), truth.symmetric(F.col("f"), 3).alias("s"), *[truth.depends_on(F.col("f"), k, 3).alias(f"d{k}") for k in range(3)]).collect()
    assert len({r.c for r in rows}) == 14 and all(r.c <= min(r.f, 255 - r.f) for r in rows)
    bit = lambda f, i: f >> i & 1
    for r in rows:
        assert r.s == all(bit(r.f, i) == bit(r.f, j) for i in range(8) for j in range(8) if i.bit_count() == j.bit_count())
        assert [r.d0, r.d1, r.d2] == [any(bit(r.f, i) != bit(r.f, i ^ 1 << k) for i in range(8)) for k in range(3)]


def test_adjacency(spark):
    keys = ["000100110", "000001100", "0000000000010110"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = df.select(adjacency.edges(F.col("k")), adjacency.in_degrees(F.col("k")), adjacency.out_degrees(F.col("k")), adjacency.linear(F.col("k"))).collect()
    assert [tuple(r) for r in rows] == [(3, [2, 1, 0], [0, 1, 2], False), (2, [1, 0, 1], [0, 1, 1], True), (3, [0, 1, 1, 1], [0, 0, 1, 2], False)]


def test_typed_motifs_equal_a_plain_count(spark):
    random.seed(2)
    rows = [(i, [random.randrange(30) for _ in range(6)], [random.choice("ab") for _ in range(6)]) for i in range(12)] + [(12, [], []), (13, [1], ["a"])]
    got = {(r.g, r.motif, r.typed): r.n for r in typed.typed_motifs(spark.createDataFrame(rows, "g int, nodes array<int>, types array<string>"), ["g"], "nodes", "types", lambda a, b: (a + b) % 3 == 0, 4).collect()}
    want = {}
    for g, nodes, types in rows:
        for own in combinations(range(len(nodes)), 4):
            edge = lambda i, j: own[i] < own[j] and (nodes[own[i]] + nodes[own[j]]) % 3 == 0  # noqa: B023, E731
            seen, links = {0}, [(i, j) for i in range(4) for j in range(4) if edge(i, j)]
            for _ in range(4):
                seen |= {b for a, b in links if a in seen} | {a for a, b in links if b in seen}
            if len(seen) == 4:
                name = min(("".join(str(int(edge(p[i], p[j]))) for i in range(4) for j in range(4)), ",".join(types[own[i]] for i in p)) for p in permutations(range(4)))
                want[(g, *name)] = want.get((g, *name), 0) + 1
    assert got == want


def test_floor_relaxes_until_enough_are_left(spark):
    rows = [("x", n, e, s) for n, e, s in (("a", 1.0, 5), ("b", -3.0, 4), ("c", 2.0, 1))] + [("y", "d", 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, k string, e double, s int")
    assert [(r.g, r.floor, r.k) for r in typed.top_with_floor(df, ["g"], "e", "k", "s", [5, 3, 1], 2).orderBy("g", "rank").collect()] == [("x", 3, "b"), ("x", 3, "a"), ("y", 1, "d")]
    assert [(r.g, r.k) for r in typed.strongest(df, ["g"], "e", "k", "s", 5, 1).orderBy("g").collect()] == [("x", "a"), ("y", "d")]


def test_assignment_space_equals_all_arrays(spark):
    library = spark.createDataFrame([(p,) for p in [1, 2, 3, 4, 5, 5, None]], "part int")
    got = sorted(tuple(r.slots) for r in grids.assignment_space(library, "part", F.col("part") % 3, 3).collect())
    assert got == sorted(a for a in product([1, 2, 3, 4, 5], repeat=3) if len({p % 3 for p in a}) == 3)
    assert grids.assignment_space(library.limit(0), "part", F.col("part") % 3, 3).count() == 0
    with pytest.raises(ValueError):
        grids.assignment_space(library, "part", F.col("part"), 2, most=3)


def test_many_to_one_fails_on_repeated_and_missing_keys(spark):
    left, right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string"), spark.createDataFrame([(1, 5)], "k int, y int")
    assert sorted(map(tuple, expectations.many_to_one(left, right, ["k"]).collect())) == [(1, "a", 5), (1, "b", 5)]
    for bad in (right.union(right), right.where("k > 1")):
        with pytest.raises(Exception, match="rows? for"):
            expectations.many_to_one(left, bad, ["k"]).collect()


def test_sources_in_any_case(spark):
    df = spark.createDataFrame([(1, ["T1", "t2"]), (2, ["t3"]), (3, [])], "k int, s array<string>")
    assert [r.k for r in cohort.with_any_source(df, "s", ["t1"]).collect()] == [1] and cohort.with_any_source(df, "s", []).count() == 3


def test_nearest_without_partner_and_ties(spark):
    a = spark.createDataFrame([("g", "m", 0.0), ("h", "q", 1.0)], "g string, k string, x double")
    b = spark.createDataFrame([("g", "o", 1.0), ("g", "n", -1.0)], "g string, k string, x double")
    got = {r.k: r.partner for r in features.nearest(a, b, ["g"], "k", ["x"]).collect()}
    assert got == {"m": "n", "q": None}


def test_ridge_equals_the_closed_form(spark):
    random.seed(4)
    rows = [("a", [random.randrange(3), 3 + random.randrange(4)], 1e6 + random.gauss(0, 5)) for _ in range(200)] + [("b", [1], 2.0), ("b", [1], 2.0), ("a", None, 1.0)]
    fit = ridge.ridge(spark.createDataFrame(rows, "g string, f array<int>, y double"), ["g"], "f", "y")
    got = {r.feature: (r.coefficient, r.r2) for r in fit.where("g = 'a'").collect()}
    own = [r for r in rows if r[0] == "a" and r[1]]
    x, y = np.zeros((len(own), 7)), np.array([r[2] for r in own])
    for i, r in enumerate(own):
        x[i, r[1]] = 1
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(7), xc.T @ yc)
    assert np.allclose([got[k][0] for k in range(7)], w, atol=1e-6) and np.isclose(got[None][0], y.mean() - x.mean(0) @ w)
    assert np.isclose(got[0][1], 1 - ((yc - xc @ w) ** 2).sum() / (yc**2).sum(), atol=1e-8)
    assert {r.r2 for r in fit.where("g = 'b'").collect()} == {None}
    assert ridge.extremes(fit, ["g"], 1).where("g = 'a'").count() == 2


def test_readers(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    m = readers.read_metrics(spark, write("m.csv", "t,v,task,n,mse,rmse,r2,pearson\nx,1,circuit,5,1.0,1.0,0.5,0.7\nx,1,growth,5,1.0,1.0,0.25,0.5\ny,2,circuit,3,1,1,0.1,0.2\n"), {"t": "string", "v": "int"}, ["circuit", "growth"])
    assert {(r.t, r.circuit.r2, r.growth and r.growth.r2) for r in m.collect()} == {("x", 0.5, 0.25), ("y", 0.1, None)}
    ranked = readers.read_ranked(spark, write("r.csv", 'rank,slots\n1,[3 1]\n2,"[4, 5]"\n3,6-7\n'), "slots", "rank int, slots string")
    assert [r.slots for r in ranked.orderBy("rank").collect()] == [[3, 1], [4, 5], [6, 7]]
    shards = [write("a.json", json.dumps({"perm": "1-2", "score": 1.5})), write("b.json", json.dumps({"perm": [3, 4], "value": 2.5, "more": 1}))]
    assert sorted((r.perm, r.value, r.more) for r in readers.read_records(spark, shards, "perm", {"score": "value"}).collect()) == [([1, 2], 1.5, None), ([3, 4], 2.5, 1)]
    wide = readers.read_wide_counts(spark, write("w.csv", "t,full:3:000100110,no_in:4:0000\nx,2,0\ny,,3\n"), ["t"])
    assert sorted(map(tuple, wide.collect())) == [("x", "full", 3, "000100110", 2), ("y", "no_in", 4, "0000", 3)]
    nodes, edges = readers.read_graphs(spark, write("g.json", json.dumps({"graph": "a", "nodes": [7, 3, 9], "edges": [{"source": 7, "target": 9}, {"source": 3, "target": 7}]}) + "\n" + json.dumps({"graph": "b", "nodes": [1], "edges": []})))
    got = {r.graph: (r.n_nodes, [tuple(e) for e in r.edges]) for r in readers.graph_records(nodes, edges).collect()}
    assert got == {"a": (3, [(0, 1), (1, 2)]), "b": (1, [])}
    lists = spark.createDataFrame([('["a", "b"]',), ("['c']",), (None,), ("x",)], "t string").select(readers.listed_texts(F.col("t")).alias("l"))
    assert [r.l for r in lists.collect()] == [["a", "b"], ["c"], None, None]


def test_tables_that_are_missing_and_broken_rules(spark, tmp_path):
    df = spark.createDataFrame([(1,), (-1,)], "x int")
    with pytest.raises(ValueError, match="positive"):
        readers.emit(df, str(tmp_path / "t"), {"positive": F.col("x") > 0})
    assert not (tmp_path / "t").exists()
    readers.emit(df.where("x > 0"), str(tmp_path / "t"), {"positive": F.col("x") > 0})
    with pytest.warns(UserWarning, match="no table b"):
        assert [tuple(r) for r in readers.read_all(spark, {"a": str(tmp_path / "t"), "b": str(tmp_path / "u")}, "view").collect()] == [(1, "a")]
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        readers.read_all(spark, {"b": str(tmp_path / "u")}, "view")


def test_edges_and_types_of_small_graphs(spark):
    df = spark.createDataFrame([([1, 2, 1],), ([],)], "n array<int>")
    rows = df.select(graphs.edge_list(F.col("n"), lambda a, b: (a + b) % 3 == 0).alias("e"), graphs.node_types(F.col("n"), lambda a, b: (a + b) % 3 == 0).alias("t")).collect()
    assert ([tuple(e) for e in rows[0].e], rows[0].t, rows[1].e, rows[1].t) == ([(0, 1), (1, 2)], ["IN", "NOT", "OUT"], [], [])
