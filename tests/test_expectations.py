"""Bad rows fail before anything is counted or written; attributions add up."""

import os

import pytest
from pyspark.sql import functions as F

from designlens.operators import coalitions, enrichment, expectations, qc, ranks


def test_bad_designs_fail_first(spark):
    rules = expectations.design_rules("slots", ["circuit"], 20, 12, F.lit(3))
    good = spark.createDataFrame([([0 + 1, 2, 3], 1.0), ([4, 5, 6], 2.0)], "slots array<int>, circuit double")
    assert expectations.require(good, rules) is good
    for bad, rule in ((([1, 13, 2], 1.0), "family_once"), (([1, 2, 21], 1.0), "part_in_library"), (([1, 2], 1.0), "slot_count"), (([1, 2, 3], float("nan")), "circuit_finite"), (([1, 2, 3], None), "circuit_finite")):
        with pytest.raises(expectations.ExpectationError, match=f"{rule}: 1 rows"):
            expectations.require(good.union(spark.createDataFrame([bad], good.schema)), rules)


def test_bad_counts_are_rejected(spark):
    rules = expectations.count_rules(["top_part"], ["top_n"])
    rows = [(5, 10), (-1, 10), (11, 10), (0, 0), (1, 1 << 54)]
    found = {r.rule: r.violations for r in expectations.report(spark.createDataFrame(rows, "top_part long, top_n long"), rules).collect()}
    assert found == {"top_part_is_count": 1, "top_n_is_count": 1, "top_n_positive": 1, "top_part_within_top_n": 1}


def test_nothing_is_written_of_a_partial_table(spark, tmp_path):
    table, keys = spark.createDataFrame([(1, 2.0)], "k long, v double"), spark.createDataFrame([(1,), (2,)], "k long")
    with pytest.raises(expectations.ExpectationError, match="1 keys are missing"):
        expectations.write_complete(table, keys, f"file://{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out")
    expectations.write_complete(table, keys.where("k = 1"), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1
    assert [r.k for r in expectations.pending(keys, table, ["k"]).collect()] == [2]
    assert {(r.k, r.there) for r in expectations.flagged(keys, table, ["k"], "there").collect()} == {(1, True), (2, False)}
    assert expectations.union_all([table, keys]).count() == 3


def test_grid_report_finds_missing_and_repeated_cells(spark):
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "role string, part int")
    parts = spark.createDataFrame([(1,), (2,)], "part int")
    assert tuple(expectations.grid_report(table, ["role"], parts, ["part"]).first()) == (4, 4, 1, 1)
    with pytest.raises(expectations.ExpectationError, match="missing columns: x"):
        expectations.grid_report(table, ["role"], parts, ["x"])


def test_quantiles_equal_percentile_on_a_skewed_group(spark):
    rows = [("big", float(i % 37)) for i in range(3000)] + [("small", 1.5), ("small", 4.0), ("none", None), (None, 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, y double")
    asked = {"a": 0.05, "b": 0.5, "c": 1.0}
    got = {r.g: (r.a, r.b, r.c) for r in ranks.quantiles(df, ["g"], "y", asked).collect()}
    expected = {r.g: tuple(r.p) for r in df.where("y is not null").groupBy("g").agg(F.percentile("y", F.array(*map(F.lit, asked.values()))).alias("p")).collect()}
    assert set(got) == set(expected) and all(got[g] == pytest.approx(expected[g]) for g in got)


def test_occurrence_counts_positions_and_presence_counts_designs(spark):
    rows = [("f", 1, 0, [0, 1, 2], 0.0), ("f", 1, 1, [1, 0, 3], 0.0), ("f", 1, 2, [1, 1, 4], 1.0), ("f", 1, 3, [2, 3, 4], 2.0)]
    d = spark.createDataFrame(rows, "topology string, group_no int, design long, slots array<int>, circuit double")
    roles = spark.createDataFrame([(1, 0, "K"), (1, 1, "K"), (1, 2, "L")], "group_no int, slot int, role string")
    parts = spark.range(0, 5).select(F.col("id").cast("int").alias("part"))
    occurrence = {(r.role, r.part): (r.top_n, r.bottom_n) for r in enrichment.occurrence(d, roles, "circuit", parts).collect()}
    presence = {(r.role, r.part): (r.top_part, r.bottom_part, r.top_n, r.bottom_n) for r in enrichment.presence(d, roles, "circuit", parts).collect()}
    assert sum(v[0] for k, v in occurrence.items() if k[0] == "K") == 2 and sum(v[1] for k, v in occurrence.items() if k[0] == "K") == 4
    assert presence["K", 2] == (1, 0, 1, 2) and presence["K", 3] == (1, 0, 1, 2) and presence["K", 1] == (0, 2, 1, 2)


def test_shapley_values_add_up_and_pairs_vanish_for_additive_scores(spark):
    d = spark.createDataFrame([(1, [1, 2, 3, 4])], "design long, slots array<int>").withColumn("g", F.lit("x"))
    pool = spark.createDataFrame([([5, 6, 7, 8],), ([8, 9, 10, 11],)], "pool_slots array<int>").withColumn("g", F.lit("x"))
    scorer = lambda s: F.aggregate(s, F.lit(0).cast("bigint"), lambda a, p: a + p * p)
    v = coalitions.coalition_values(coalitions.hybrids(d, pool, ["g"], "design", 12), "design", scorer)
    main = {r.slot: r.phi for r in coalitions.shapley_main(v, "design").collect()}
    assert sum(main.values()) == pytest.approx(30 - (174 + 366) / 2) and main[0] == pytest.approx(1 - (25 + 64) / 2)
    assert all(abs(r.phi) < 1e-9 for r in coalitions.shapley_pair(v, "design").collect())
    none = coalitions.coalition_values(coalitions.hybrids(d, pool.limit(1).select(F.array(*[F.lit(5)] * 4).alias("pool_slots"), "g"), ["g"], "design", 12), "design", scorer)
    assert {r.phi for r in coalitions.shapley_main(none, "design").collect()} >= {None}


def test_quality_tiers_need_both_measures(spark):
    df = spark.createDataFrame([(0.9, 0.9), (0.9, 0.5), (0.9, 0.1), (None, 0.9)], "a double, b double")
    assert [r.t for r in df.select(qc.tier(F.col("a"), F.col("b"), 0.8, 0.4).alias("t")).collect()] == ["A1", "A2", "A3", "BROKEN"]
