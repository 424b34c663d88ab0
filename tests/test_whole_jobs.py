"""Queries that once did less than their whole job, differed from their SQL, or grew faster than their tables."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from designlens import analysis_queries, edge_queries, feature_queries, graph_queries, match_queries, table_queries
from designlens.functions import sources
from designlens.operators import attribution, coalitions, edge_tables, graphs, grids, typed
from designlens.shared import materialize
from designlens.sources import designs

DIR = "/root/testdata/sf0.001"


def test_calibration_states_ranges_of_every_size(spark):
    rows = analysis_queries.calibration(spark, DIR).collect()
    assert {r.topology[0] for r in rows} == {"4", "5", "6", "7"}
    assert all(r[c] is not None for r in rows for c in ("low", "high", "inside", "near_low", "near_high", "near"))
    assert {r.near for r in rows} == {True, False}


def test_grid_means_do_not_depend_on_the_order_of_rows(spark):
    values = [-0.092905, -0.002894, -0.268466, -0.041635]  # their mean is -0.101475; added as doubles in this order it falls below
    rows = spark.createDataFrame([(1, 4, v) for v in values], "part int, size int, x double").coalesce(1)
    grid = grids.contribution_grid(rows, "part", {"size": [4, 5]}, "x", 3)
    assert sorted((r.size, r.mean, r.n) for r in grid.select("size", "mean", "n").collect()) == [(4, -0.101475, 4), (5, None, 0)]


def shuffles(df):
    """The exchanges of a plan, as text."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "Broadcast" not in line]


@pytest.mark.parametrize("k", [3, 4])
def test_typed_motifs_inside_a_row_equal_those_over_rows(spark, k):
    random.seed(5)
    rows = [(i, [random.randrange(30) for _ in range(i % 8)], [random.choice("abc") for _ in range(i % 8)]) for i in range(40)] + [(40, [None, 1, 2, 5], ["a", "b", "c", "a"])]
    df = spark.createDataFrame(rows, "g int, nodes array<int>, types array<string>")
    found = lambda f: sorted(tuple(r) for r in f(df, ["g"], "nodes", "types", lambda a, b: (a + b) % 3 == 0, k).collect())
    assert found(typed.typed_by_row) == found(typed.typed_motifs) != []
    assert shuffles(typed.typed_by_row(df, ["g"], "nodes", "types", lambda a, b: (a + b) % 3 == 0, k)) == []


def test_family_expansions_shuffle_counts_only(spark):
    own = shuffles(feature_queries.motif_family_expansions(spark, DIR))
    assert len(own) == 1 and "hashpartitioning(gate_count" in own[0]


def test_a_part_that_is_listed_twice_is_one_node(spark, tmp_path):
    for name in ("lineitem", "orders"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    part = spark.read.parquet(f"{DIR}/part.parquet")
    part.union(part.where("p_partkey % 5 = 0")).write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("design")).agg(F.expr("transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey))), x -> x.l_suppkey)").alias("own"))
    found = designs.design_graphs(spark, str(tmp_path))
    assert found.where("size(slots) > size(nodes)").count() > 0
    assert found.join(lines, "design").where("nodes <> own").count() == 0


def _odd_tables(spark, path):
    """Tables with parts that are listed twice, lines of equal number, orders without lines and lines without orders, null keys and prices."""
    part = spark.read.parquet(f"{DIR}/part.parquet")
    part.union(part.where("p_partkey % 5 = 0")).write.parquet(f"{path}/part.parquet")
    line = spark.read.parquet(f"{DIR}/lineitem.parquet")
    odd = line.withColumns({"l_orderkey": F.when(F.col("l_orderkey") % 50 != 7, F.col("l_orderkey")), "l_linenumber": F.col("l_linenumber") % 3, "l_extendedprice": F.when(F.col("l_orderkey") % 40 != 9, F.col("l_extendedprice"))})
    hot = line.limit(900).withColumn("l_orderkey", F.lit(10_000).cast("bigint"))
    odd.unionByName(hot).write.parquet(f"{path}/lineitem.parquet")
    order = spark.read.parquet(f"{DIR}/orders.parquet")
    order.where("o_orderkey % 11 <> 3").union(order.limit(1).withColumn("o_orderkey", F.lit(10_000).cast("bigint"))).write.parquet(f"{path}/orders.parquet")


@pytest.mark.parametrize("lines", [100, 500_000])
def test_bound_designs_equal_the_sql_on_odd_tables(spark, tmp_path, monkeypatch, lines):
    monkeypatch.setattr(designs, "LINES", lines)
    _odd_tables(spark, tmp_path)
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(f"{designs.SQL} SELECT topology, gate_count, group_no, variant, d.design, (SELECT list(part ORDER BY slot) FROM s WHERE s.design = d.design), circuit, growth FROM d").fetchall()
    found = designs.bound_designs(spark, str(tmp_path)).select("topology", "gate_count", "group_no", "variant", "design", "slots", "circuit", "growth").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want)) != []
    assert any(r.circuit is None for r in found)


def test_the_binding_has_more_partitions_for_more_lines(spark, monkeypatch):
    monkeypatch.setattr(designs, "LINES", 100)
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    own = shuffles(designs.bound_designs(spark, DIR))
    wide = [x for x in own if f", {-(-lines // 100)})" in x]
    assert any("l_orderkey" in x for x in wide) and any("l_partkey" in x for x in wide)


def test_the_binding_collects_no_order(spark):
    assert "collect_list" not in designs.bound_designs(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


def _weighted(slots):
    return F.aggregate(F.transform(slots, lambda p, i: (p * p + i * p).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)


def test_double_swaps_come_from_the_row_of_their_design(spark):
    random.seed(8)
    rows = [(g, random.sample(range(1, 13), 3 + g % 3)) for g in range(6)] + [(6, []), (7, [5])]
    found = coalitions.double_swaps(spark.createDataFrame(rows, "design int, slots array<int>"), "design", _weighted, 2, 15, 12)
    assert shuffles(found) == []
    score, want = lambda s: sum(p * p + i * p for i, p in enumerate(s)), set()
    for g, s in rows:
        put = lambda i, p: [p if k == i else q for k, q in enumerate(s)]  # noqa: B023, E731
        valid = lambda s: len({p % 12 for p in s}) == len(s)
        best = [sorted((p for p in range(1, 16) if p != s[i] and valid(put(i, p))), key=lambda p: (-abs(score(put(i, p)) - score(s)), p))[:2] for i in range(len(s))]  # noqa: B023
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for p in best[i]:
                    for q in best[j]:
                        new = [q if k == j else v for k, v in enumerate(put(i, p))]
                        if valid(new):
                            want.add((g, i, j, p, q, score(new) - score(s)))
    assert sorted(map(tuple, found.collect())) == sorted(want) != []


def test_swaps_of_a_slot_are_worked_out_once(spark):
    plan = table_queries.contribution_stack(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_contains(") == 1


def test_swaps_of_a_sum_read_no_other_slot(spark):
    random.seed(9)
    rows = [(g, [random.randrange(1, 31) for _ in range(g % 8)]) for g in range(60)] + [(60, [None, 3, 4]), (61, [None]), (62, None), (63, list(range(1, 13)))]
    df, score = spark.createDataFrame(rows, "design int, slots array<int>"), attribution.Additive(lambda p, i: p * p + i * p)
    found = lambda x: sorted(map(repr, x.select("design", "slot", "part", "phi").collect()))
    for parts, families in ((25, 12), (3, 12), (15, 1)):
        want = found(attribution.replacement_contrast(attribution.swaps(df, "design", _weighted, parts, families), "design", ("part",)))
        assert found(attribution.replacement_contrast(attribution.swaps(df, "design", score, parts, families), "design", ("part",))) == want
        assert found(attribution.contrast(df, "design", score, parts, families)) == want
    plan = table_queries.contribution_stack(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "delta" not in plan


def test_source_texts_are_counted_with_their_class(spark):
    rows = spark.createDataFrame([(t,) for t in (["0x17", '["0x47", "0x1B"]', None, "baseline:0x17/3"] * 50)], "source string")
    classes = spark.createDataFrame([("0x17", "c0"), ("0x47", "c1")], "target string, class string")
    found = sources.class_counts(rows, "source", classes)
    assert set(map(tuple, found.collect())) == {("0x17", "0x17", "c0", 100), ('["0x47", "0x1B"]', "0x47", "c1", 50), (None, None, "?", 50)}


def test_classes_are_worked_out_once_a_function(spark):
    plan = match_queries.source_classes(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[f#\d+\], \[f#\d+\]", plan)


def test_levels_by_rounds_and_in_rows_are_the_same(spark):
    random.seed(4)
    links = [(g, random.randrange(9), random.randrange(9)) for g in range(30) for _ in range(g)] + [(3, None, 20), (4, 21, None), (5, None, None)]
    nodes = spark.createDataFrame([(g, v) for g in range(31) for v in range(5)] + [(2, None)], "graph int, node int")
    edges = spark.createDataFrame([(g, s, t) for g, s, t in links if None in (s, t) or s < t or (g % 3 == 0 and s != t)], "graph int, source int, target int")
    found = lambda fits: sorted((tuple(r) for r in edge_tables.levels(nodes, edges, ["graph"], fits=fits).collect()), key=repr)
    assert found(0) == found(10) == found(400)
    assert any(level is None for _, _, level in found(400)) and (3, 20, 0) in found(400)


def test_levels_of_small_graphs_take_one_shuffle_by_graph(spark, monkeypatch):
    written = []
    monkeypatch.setattr(edge_tables, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    edge_queries.edge_table_levels(spark, DIR)
    assert written == ["levels"]


def test_typed_counts_come_from_shapes(spark):
    assert not [x for x in shuffles(feature_queries.typed_motif_counts(spark, DIR)) if "design" in x or "orderkey" in x]


def test_hashes_of_shapes(spark):
    random.seed(6)
    rows = spark.createDataFrame([([random.randrange(9) for _ in range(i % 7)],) for i in range(80)], "nodes array<int>")
    edge = lambda a, b: (a + b) % 3 == 0
    each = rows.groupBy(graphs.structural_hash(F.col("nodes"), edge, 3).alias("h")).agg(F.count("*").alias("n"))
    known = graphs.shapes(rows, [], "nodes", edge, {"n": F.count("*")})
    once = known.groupBy(graphs.structural_hash(F.col("nodes"), edge_tables.linked, 3).alias("h")).agg(F.sum("n").alias("n"))
    assert known.count() < 80 and set(map(tuple, each.collect())) == set(map(tuple, once.collect()))
    assert not [x for x in shuffles(graph_queries.structural_hashes(spark, DIR)) if "design" in x or "orderkey" in x]


def test_typed_log_odds_shuffles_nothing_by_design(spark):
    assert not [x for x in shuffles(feature_queries.typed_log_odds(spark, DIR)) if "design" in x or "orderkey" in x]


def test_motif_breadth_shuffles_nothing_by_design(spark):
    assert not [x for x in shuffles(feature_queries.motif_breadth(spark, DIR)) if "design" in x or "orderkey" in x]


def test_best_typed_variants_shuffles_nothing_by_design(spark):
    assert not [x for x in shuffles(feature_queries.best_typed_variants(spark, DIR)) if "design" in x or "orderkey" in x]


def test_broad_motifs_shuffles_nothing_by_design(spark):
    assert not [x for x in shuffles(feature_queries.broad_motifs(spark, DIR)) if "design" in x or "orderkey" in x]
