"""Ridge fits by conjugate gradients against the closed form."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from designlens.operators import pair_ridge


def closed_form(rows, size, penalty):
    """Weights and R2 of (features, y) rows."""
    x = np.zeros((len(rows), size))
    for i, (own, _) in enumerate(rows):
        x[i, own] = 1
    y = np.array([v for _, v in rows])
    centred, level = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(centred.T @ centred + penalty * np.eye(size), centred.T @ level)
    return w, 1 - ((level - centred @ w) ** 2).sum() / (level**2).sum() if level.any() else None


@pytest.mark.parametrize("pairs", [False, True])
def test_fits_equal_the_closed_form(spark, pairs):
    r, parts, slots = random.Random(5), 3, 3
    data = []
    for g, n in (("a", 80), ("b", 25)):
        for _ in range(n):
            own = [r.randrange(1, parts + 1) for _ in range(slots)]
            data.append((g, own, 3.0 * own[0] + own[1] * own[2] + r.gauss(0, 0.5)))
    odd = [("flat", [1, 2, 3], 4.0), ("flat", [2, 2, 2], 4.0), ("one", [1, 1, 1], 2.0), (None, [1, 1, 1], 9.0), ("a", [1, 1, 1], None)]
    df = spark.createDataFrame(data + odd, "g string, slots array<int>, y double").repartition(3)
    size = pair_ridge.feature_count(parts, slots, pairs)
    features = pair_ridge.pair_features(F.col("slots"), parts, slots) if pairs else pair_ridge.main_features(F.col("slots"), parts)
    listed = df.where("g = 'a' and y is not null").select(features.alias("f"), "y").collect()
    assert all(len(set(x.f)) == len(x.f) == (6 if pairs else 3) and max(x.f) < size for x in listed)
    fits = {x.g: x for x in pair_ridge.ridge_by_gradients(df, ["g"], features, "y", size, 0.7).collect()}
    assert set(fits) == {"a", "b", "flat", "one"} and fits["flat"].r2 is None and fits["one"].r2 is None
    assert all(w == 0 for g in ("flat", "one") for w in fits[g].weights) and fits["flat"].mean == 4.0
    for g in ("a", "b"):
        rows = [(x.f, x.y) for x in df.where((F.col("g") == g) & F.col("y").isNotNull()).select(features.alias("f"), "y").collect()]
        w, r2 = closed_form(rows, size, 0.7)
        assert fits[g].weights == pytest.approx(list(w), abs=1e-6) and fits[g].r2 == pytest.approx(r2, abs=1e-9) and fits[g].n == len(rows)


def test_joined_weights_and_fits_that_do_not_settle(spark, monkeypatch):
    rows = [("a", [i % 4, 4 + i % 3], float(i * i % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, f array<int>, y double")
    sent = pair_ridge.ridge_by_gradients(df, ["g"], F.col("f"), "y", 7, 1.0).first()
    monkeypatch.setattr(pair_ridge, "SENT", 0)
    joined = pair_ridge.ridge_by_gradients(df, ["g"], F.col("f"), "y", 7, 1.0).first()
    assert joined.weights == pytest.approx(sent.weights, abs=1e-9) and joined.r2 == pytest.approx(sent.r2)
    with pytest.raises(RuntimeError):
        pair_ridge.ridge_by_gradients(df, ["g"], F.col("f"), "y", 7, 1.0, steps=1)
    assert pair_ridge.ridge_by_gradients(df.where("1 = 0"), ["g"], F.col("f"), "y", 7, 1.0).count() == 0
