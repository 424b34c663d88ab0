"""Exact quantiles from refined histograms against numpy, on skewed, tied and odd groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from designlens.operators import ranks, tiers

ASKED = {"q0": 0.0, "q01": 0.01, "q25": 0.25, "median": 0.5, "q9": 0.9, "q99": 0.99, "q1": 1.0}


def made(kind, n):
    r = random.Random(n)
    return {
        "even": lambda: [r.uniform(-5, 5) for _ in range(n)],
        "skewed": lambda: [math.exp(r.gauss(0, 12)) for _ in range(n)],
        "outlier": lambda: [r.random() for _ in range(n - 2)] + [1e300, -1e300],
        "tied": lambda: [float(r.randrange(3)) for _ in range(n)],
        "one": lambda: [7.0] * n,
        "near": lambda: [1.0 + r.randrange(5) * 2.0**-52 for _ in range(n)],
        "tiny": lambda: [r.randrange(4) * 5e-324 for _ in range(n)],
        "wide": lambda: [r.choice([-1, 1]) * 1.7e308 * r.random() for _ in range(n)],
    }[kind]()


KINDS = ["even", "skewed", "outlier", "tied", "one", "near", "tiny", "wide"]


@pytest.mark.parametrize("bins, exact", [(2048, 1 << 16), (40, 3)])
def test_quantiles_equal_sorted_values(spark, monkeypatch, bins, exact):
    monkeypatch.setattr(ranks, "BINS", bins)
    monkeypatch.setattr(ranks, "EXACT", exact)
    groups = {k: made(k, 300 + i) for i, k in enumerate(KINDS)} | {None: made("even", 5), "alone": [3.0]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("even", None), ("empty", None)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, y double").repartition(5)
    found = {r.g: r for r in ranks.quantiles(df, ["g"], "y", ASKED).collect()}
    assert set(found) == set(groups)
    for g, own in groups.items():
        own = np.sort(np.array(own))
        for name, p in ASKED.items():
            h = (len(own) - 1) * p
            low, high = own[math.floor(h)], own[math.ceil(h)]
            with np.errstate(over="ignore"):
                assert found[g][name] == pytest.approx(float(low + (high - low) * (h - math.floor(h))), rel=1e-12), (g, name)


@pytest.mark.parametrize("exact", [1 << 16, 2])
def test_quantiles_of_longs_infinite_and_missing_numbers(spark, monkeypatch, exact):
    monkeypatch.setattr(ranks, "EXACT", exact)
    inf, nan = float("inf"), float("nan")
    rows = [("inf", v) for v in (-inf, 1.0, 2.0, 3.0, inf)] + [("nan", v) for v in (1.0, 2.0, nan, nan, nan)] + [("low", v) for v in (-inf, -inf, 5.0)]
    found = {r.g: r.median for r in ranks.quantiles(spark.createDataFrame(rows, "g string, y double"), ["g"], "y", {"median": 0.5}).collect()}
    assert found["inf"] == 2.0 and math.isnan(found["nan"]) and found["low"] == -inf
    big = [2**62 + i for i in range(9)]
    longs = spark.createDataFrame([(v,) for v in big], "y long")
    assert ranks.quantiles(longs, [], "y", {"least": 0.0, "median": 0.5}).first().asDict() == {"least": float(2**62), "median": float(2**62 + 4)}
    assert ranks.quantiles(longs.where("y = 0"), [], "y", {"median": 0.5}).count() in (0, 1)
    assert ranks.quantiles(longs.withColumn("g", F.lit(1)).where("y = 0"), ["g"], "y", {"median": 0.5}).count() == 0


def test_what_is_shuffled_does_not_grow_with_the_rows(spark, monkeypatch):
    """Every table that quantiles write after the scores has a few rows a group."""
    monkeypatch.setattr(ranks, "EXACT", 100)
    written, write = [], ranks.materialize
    monkeypatch.setattr(ranks, "materialize", lambda df, name: written.append((name, write(df, name))) or written[-1][1])
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.hash("id") % 1_000_003).alias("y"))
    tiers.tier_thresholds(df, "g", "y").collect()
    assert all(table.count() <= 2 * 2 * 8 for name, table in written if name == "intervals")
