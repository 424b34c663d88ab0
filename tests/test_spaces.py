"""Variance by sets of slots, sampled attribution, and spaces by their places, against brute force."""

import random
from collections import Counter
from itertools import combinations, permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from designlens.operators import coalitions, spaces, variance

#: Families of the library of twenty parts: eight of one part, then 3, 3, 2 and 4.
SIZES = [1, 1, 1, 3, 1, 1, 1, 1, 3, 1, 2, 4]


def made_space(sizes, slots):
    parts = iter(range(sum(sizes)))
    return spaces.Space([[next(parts) for _ in range(n)] for n in sizes], slots)


@pytest.mark.parametrize("slots, n", [(4, 74_736), (5, 875_520), (6, 8_739_360), (7, 72_999_360)])
def test_sizes_of_the_library(slots, n):
    assert made_space(SIZES, slots).size() == n


@pytest.mark.parametrize("sizes, slots", [([1, 3, 2], 2), ([2, 2, 1, 3], 3), ([1, 1], 3), ([4], 1), ([2, 1], 0)])
def test_places_are_a_bijection(sizes, slots):
    space = made_space(sizes, slots)
    family = {p: i for i, own in enumerate(space.families) for p in own}
    expected = {a for a in permutations(family, slots) if len({family[p] for p in a}) == slots}
    assert space.size() == len(expected)
    assert {tuple(r) for r in spaces.unranked(space, np.arange(space.size())).tolist()} == expected


def test_the_whole_space_and_samples(spark):
    space = made_space(SIZES, 4)
    rows = spaces.whole_space(spark, space, 7)
    assert rows.select("slots").distinct().count() == rows.count() == 74_736
    sizes = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1
    large = made_space(SIZES, 7)
    family = {p: i for i, own in enumerate(large.families) for p in own}
    sample = spaces.sampled_space(spark, large, 20_000, seed=3).collect()
    assert len({r.place for r in sample}) == 20_000 and all(0 <= r.place < large.size() for r in sample)
    assert all(len({family[p] for p in r.slots}) == 7 for r in sample)
    # by symmetry every slot holds a part as often as any other, and the parts of a family are even
    first = Counter(r.slots[0] for r in sample)
    last = Counter(r.slots[6] for r in sample)
    assert all(abs(first[p] - last[p]) < 6 * (first[p] + last[p] + 1) ** 0.5 for p in family)
    assert max(first[p] for p in (16, 17, 18, 19)) - min(first[p] for p in (16, 17, 18, 19)) < 6 * first[16] ** 0.5
    assert spaces.sampled_space(spark, made_space([1, 2], 2), 100).count() == 4
    assert spaces.whole_space(spark, made_space([1], 2)).count() == 0


def test_library_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (3, 1), (None, 1), (4, None)], "p int, f int")
    assert spaces.library_space(rows, "p", F.col("f"), 2).families == [[1, 2], [3]]
    with pytest.raises(ValueError):
        spaces.library_space(rows, "p", F.col("f"), 2, most=2)


def plain_effects(rows, order):
    """{slots: effect} of (slots, score) rows by inclusion and exclusion over dictionaries."""
    n, y = len(rows[0][0]), np.array([v for _, v in rows], float)

    def together(own):
        cells = {}
        for (s, _), v in zip(rows, y):
            cells.setdefault(tuple(s[i] for i in own), []).append(v)
        return sum(len(c) * (np.mean(c) - y.mean()) ** 2 for c in cells.values()) / len(y) / y.var()

    out = {}
    for size in range(1, min(order, n) + 1):
        for own in combinations(range(n), size):
            out[own] = together(own) - sum(out[t] for k in range(1, size) for t in combinations(own, k))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_effects_of_sets_of_slots(spark, order):
    r = random.Random(order)
    grid = [(list(s), float(r.randrange(100))) for s in product(range(3), range(2), range(3))]
    ragged = [([r.randrange(3) for _ in range(4)], float(r.randrange(100))) for _ in range(60)]
    rows = [("grid", s, v) for s, v in grid] + [("ragged", s, v) for s, v in ragged] + [("flat", [1, 2], 5.0), ("flat", [2, 2], 5.0), (None, [1], 1.0), (None, [2], 3.0), ("none", [], 3.0)]
    df = spark.createDataFrame(rows, "g string, slots array<int>, y double")
    effects = variance.subset_effects(df.where("g is not null"), ["g"], "y", order)
    found = {}
    for x in effects.collect():
        found.setdefault(x.g, {})[tuple(x.own)] = x.effect
    assert set(found) == {"grid", "ragged", "flat"} and all(v is None for v in found["flat"].values())
    for name, own in (("grid", grid), ("ragged", ragged)):
        assert found[name] == pytest.approx(plain_effects(own, order), abs=1e-9)
    shares = {(x.g, x.size): x.share for x in variance.order_shares(effects, ["g"], order).collect()}
    assert sum(v for (g, _), v in shares.items() if g == "grid") == pytest.approx(1)
    if order >= 3:
        assert shares["grid", order + 1] == pytest.approx(0, abs=1e-9)
        assert all(v >= -1e-9 for (g, size), v in shares.items() if g == "grid")


def _worth(slots):
    total = F.aggregate(F.transform(slots, lambda p, i: ((i + 1) * p).cast("double")), F.lit(0.0), lambda a, v: a + v)
    return total * total


@pytest.mark.parametrize("n", [2, 5, 7])
def test_sampled_values_are_near_the_exact_ones(spark, n):
    r = random.Random(n)
    slots = [12 * r.randrange(5) + i for i in range(n)]
    pool = [[12 * r.randrange(5) + i for i in range(n)] for _ in range(6)]
    anchor = spark.createDataFrame([("g", 1, slots)], "g string, design long, slots array<int>")
    pools = spark.createDataFrame([("g", p) for p in pool], "g string, pool_slots array<int>")
    exact = {x.slot: x.phi for x in coalitions.shapley_main(coalitions.coalition_values(coalitions.hybrids(anchor, pools, ["g"], "design", 12), "design", _worth), "design").collect()}
    steps = coalitions.orderings(spark, n, 60, 1).where(F.col("n") == n)
    values = coalitions.coalition_values(coalitions.hybrids(anchor, pools, ["g"], "design", 12, steps), "design", _worth)
    found = {x.slot: x for x in coalitions.shapley_sampled(values, steps, "design").collect()}
    assert set(found) == set(exact)
    for slot, x in found.items():
        assert abs(x.phi - exact[slot]) <= 3 * x.error + 1e-6 * abs(exact[slot])
    ends = {x.mask: x.v for x in values.collect()}
    assert sum(x.phi for x in found.values()) == pytest.approx(ends[2**n - 1] - ends[0])


def test_sampled_values_of_sixteen_slots_and_of_unsafe_coalitions(spark):
    n = 16
    anchor = spark.createDataFrame([("g", 1, list(range(n)))], "g string, design long, slots array<int>")
    pools = spark.createDataFrame([("g", [100 + i for i in range(n)])], "g string, pool_slots array<int>")
    steps = coalitions.orderings(spark, n, 5, 2).where(F.col("n") == n)
    assert steps.where("back = 0 and sample = 0").orderBy("place").select("slot").collect()[1:] == steps.where("back = 1 and sample = 0").orderBy(F.desc("place")).select("slot").collect()[:-1]
    assert steps.select("mask").distinct().count() < 5 * 2 * n
    values = coalitions.coalition_values(coalitions.hybrids(anchor, pools, ["g"], "design", 1000, steps), "design", _worth)
    found = coalitions.shapley_sampled(values, steps, "design").collect()
    assert len(found) == n and all(x.phi is not None and x.error is not None for x in found)
    # a pool that always repeats a family leaves mixed coalitions without a value
    bad = spark.createDataFrame([("g", [5] * n)], "g string, pool_slots array<int>")
    values = coalitions.coalition_values(coalitions.hybrids(anchor, bad, ["g"], "design", 1000, steps), "design", _worth)
    assert all(x.phi is None and x.error is None for x in coalitions.shapley_sampled(values, steps, "design").collect())
