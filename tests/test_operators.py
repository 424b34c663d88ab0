import math
import random

from pyspark.sql import functions as F

from designlens.functions.slots import family_valid, hamming, slots_string
from designlens.operators import enrichment, pareto, tiers


def test_presence_statistics_cases(spark):
    rows = [(5, 10, 10, 20), (477162, 340642, 7700606, 4374044)]
    df = spark.createDataFrame(rows, "a long, b long, n long, m long").withColumns(enrichment.presence_statistics(F.col("a"), F.col("b"), F.col("n"), F.col("m")))
    out = sorted(df.collect(), key=lambda r: r.a)
    assert (out[0].p_top, out[0].p_bottom, out[0].log2_ratio) == (0.5, 0.5, 0.0)
    assert out[1].log2_ratio < 0 < math.log2(477163 / 340643)


def test_tails_keep_ties_and_may_overlap(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)], "design long, y double").withColumn("g", F.lit("x"))
    row = enrichment.tail_bookkeeping(df, ["g"], "y").first()
    assert (row.n_top, row.n_bottom, row.overlap) == (4, 4, 4)


def test_skyline_equals_pairwise_domination(spark):
    random.seed(3)
    rows = [(f"g{random.randrange(3)}", i, random.randrange(12), random.randrange(12)) for i in range(400)]
    got = {r.k for r in pareto.skyline(spark.createDataFrame(rows, "g string, k long, x long, y long"), ["g"], "x", "y", "k").collect()}
    beats = lambda b, a: b[0] == a[0] and b[2] >= a[2] and b[3] >= a[3] and ((b[2], b[3]) != (a[2], a[3]) or b[1] < a[1])
    assert got == {a[1] for a in rows if not any(beats(b, a) for b in rows if b[1] != a[1])}


def test_histogram_percentile_is_within_one_bin(spark):
    random.seed(5)
    df = spark.createDataFrame([(random.gauss(50, 10),) for _ in range(2000)], "y double").withColumn("g", F.lit(1))
    got = {r.percent: r.value for r in tiers.histogram_percentiles(tiers.histogram(df, ["g"], "y", 0, 0.5, 200), ["g"], 0, 0.5, [1, 50, 99]).collect()}
    exact = df.select(F.percentile("y", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))).first()[0]
    assert all(abs(got[p] - e) <= 0.5 for p, e in zip((1.0, 50.0, 99.0), exact))


def test_slot_expressions(spark):
    df = spark.createDataFrame([([0, 1, 2], [0, 3, 2]), ([1, 13, 2], [1, 13, 2])], "a array<int>, b array<int>")
    out = df.select(hamming(F.col("a"), F.col("b")), family_valid(F.col("a")), slots_string(F.col("a"))).collect()
    assert [tuple(r) for r in out] == [(1, True, "0-1-2"), (0, False, "1-13-2")]
