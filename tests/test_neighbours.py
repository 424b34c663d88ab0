"""Neighbours by index keys, skylines by ranges, rank correlations and source texts, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from designlens.functions import sources
from designlens.operators import features, neighbours, pareto


def test_bands_equal_brute_force(spark):
    r = random.Random(1)
    values = [r.uniform(-50, 50) for _ in range(150)] + [0.0, 0.0, 1e-9, -1e-9, 1e12, 100.0, 105.0, 95.0, 94.99, None, 20.0, 21.0, 19.0]
    rows = [(g, i, v) for i, v in enumerate(values) for g in ("a", "b")]
    df = spark.createDataFrame(rows, "g string, k long, y double")
    anchors = df.where("k % 6 = 0 or k >= 150")
    for share in (0.05, 0.2):
        found = sorted((x.g, x.anchor_k, x.k) for x in neighbours.band_matches(df, anchors, ["g"], "y", share).collect())
        chosen = [(g, i, v) for g, i, v in rows if v is not None and (i % 6 == 0 or i >= 150)]
        assert found == sorted((g, i, j) for g, i, a in chosen for h, j, b in rows if g == h and b is not None and abs(b - a) <= abs(a) * share)


@pytest.mark.parametrize("n, most", [(7, 2), (4, 1), (3, 2), (2, 3)])
def test_few_differing_slots_equal_brute_force(spark, n, most):
    r = random.Random(n)
    rows = [("g" if i % 3 else "h", i, [r.randrange(3) for _ in range(n)]) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, k long, slots array<int>")
    plan = neighbours.hamming_matches(df, df.where("k % 5 = 0"), ["g"], "k", "slots", most)
    found = sorted((x.anchor_k, x.k, x.distance) for x in plan.collect())
    gap = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert found == sorted((i, j, gap(a, b)) for g, i, a in rows if i % 5 == 0 for h, j, b in rows if g == h and 1 <= gap(a, b) <= most)


def test_roles_of_several_anchors(spark):
    r = random.Random(4)
    rows = [(f"g{i % 2}", i, [r.randrange(3) for _ in range(4)], float(r.randrange(1, 60)), float(r.randrange(100, 130)), float(r.randrange(1, 60)), r.random() < 0.3, r.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, slots array<int>, x double, y double, p double, bad boolean, old boolean")
    found = {(m.anchor, m.role): (m.other, m.distance, m.mask) for m in neighbours.matched_roles(df, df.where("k < 12"), ["g"], "k", "slots", "x", "y", "p", "bad", "old").collect()}
    expected = {}
    for g, k, s, x, y, *_ in rows[:12]:
        own = [o for o in rows if o[0] == g and o[1] != k]
        gap = lambda o: sum(a != b for a, b in zip(o[2], s))  # noqa: B023, E731
        fits = {
            "logic_failure": (lambda o: not o[6] and abs(o[4] - y) <= y * 0.05, lambda o: o[3]),
            "growth_failure": (lambda o: not o[6] and abs(o[3] - x) <= x * 0.2, lambda o: o[4]),
            "near_miss": (lambda o: not o[6] and 1 <= gap(o) <= 2 and o[3] * 10 < x * 7, lambda o: -o[3]),
            "interference": (lambda o: o[6] and o[5] * 2 > x, lambda o: -o[5]),
            "top_in_training": (lambda o: o[7], lambda o: -o[3]),
        }
        for role, (fit, by) in fits.items():
            best = min((o for o in own if fit(o)), key=lambda o: (by(o), o[1]), default=None)
            if best:
                expected[k, role] = (best[1], gap(best), "".join(str(int(a != b)) for a, b in zip(best[2], s)))
    assert found == expected and {role for _, role in found} == {"logic_failure", "growth_failure", "near_miss", "interference", "top_in_training"}


def front_rows(kind, n):
    r = random.Random(n)
    return {
        "line": lambda: [(float(i), float(n - i)) for i in range(n)],  # all of it on the front
        "ties": lambda: [(float(r.randrange(6)), float(r.randrange(6))) for _ in range(n)],
        "cloud": lambda: [(r.random(), r.random()) for _ in range(n)],
        "one": lambda: [(1.0, 1.0)],
    }[kind]()


def test_skylines_by_ranges_equal_those_of_one_sort(spark, monkeypatch):
    rows = [(kind if kind != "one" else None, i, x, y) for kind in ("line", "ties", "cloud", "one") for i, (x, y) in enumerate(front_rows(kind, 400))]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, x double, y double")
    small = sorted(pareto.skyline(df, ["g"], "x", "y", "k").collect(), key=repr)
    monkeypatch.setattr(pareto, "LARGE", 0)
    assert sorted(pareto.skyline(df, ["g"], "x", "y", "k").collect(), key=repr) == small
    for kind in ("line", "ties", "cloud", "one"):
        own = [(x, y) for x, y in front_rows(kind, 400)]
        beaten = lambda p: any(q != p and q[0] >= p[0] and q[1] >= p[1] for q in own)  # noqa: B023, E731
        assert sorted({p for p in own if not beaten(p)}) == sorted((r.x, r.y) for r in small if r.g == (kind if kind != "one" else None))
    assert pareto.skyline(df.where("1 = 0"), ["g"], "x", "y", "k").count() == 0


def test_floors_and_knees_of_targets(spark):
    rows = spark.createDataFrame([("a", 1, 2.0, 5.0), ("b", 2, 4.0, 6.0), ("c", 3, 9.0, 0.0), ("d", 4, 3.0, 9.0)], "g string, k long, x double, y double")
    fit = {r.k: r.combined for r in pareto.combined_by_floors(rows, "x", "y", 2.0, 5.0, 10.0).collect()}
    assert fit == {1: 0.0, 2: pytest.approx(1 + 0.2), 4: pytest.approx(0.5 + 0.8)}
    targets = spark.createDataFrame([("a", "t"), ("b", "t"), ("b", "u"), ("d", "u"), ("c", "v")], "g string, target string")
    best = pareto.best_knees(pareto.combined_by_floors(rows, "x", "y", 2.0, 5.0, 10.0), targets, "g", "k").collect()
    assert [(r.target, r.k, r["rank"]) for r in best] == [("u", 4, 1), ("t", 2, 2)]
    assert pareto.combined_by_floors(rows, "x", "y", 100.0, 0.0, 1.0).count() == 0


def test_rank_correlations_rank_within_each_pair(spark):
    r = random.Random(2)
    cells = [(p, c, float(r.randrange(5))) for p in range(4) for c in range(30) if r.random() < 0.7] + [(9, 0, 1.0), (9, 1, 1.0)]
    found = {(x.a, x.b): (x.n_shared, x.r) for x in features.profile_rank_correlations(spark.createDataFrame(cells, "p int, c int, v double"), "p", ["c"], "v", 5).collect()}
    by = {p: {c: v for q, c, v in cells if q == p} for p in (0, 1, 2, 3, 9)}
    mean_rank = lambda v: np.array([(sum(b < a for b in v) + sum(b <= a for b in v) + 1) / 2 for a in v])
    for (a, b), (n, rho) in found.items():
        both = sorted(by[a].keys() & by[b].keys())
        assert n == len(both)
        x, y = mean_rank([by[a][c] for c in both]), mean_rank([by[b][c] for c in both])
        assert rho is None if x.std() * y.std() == 0 else rho == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_source_texts(spark):
    texts = ["0x17", "baseline:0x2B/abc/d", '["0x47", "0x1B"]', "['0x03','0x0F']", "[]", "", None, "baseline:0x01"]
    df = spark.createDataFrame([(t,) for t in texts], "source string")
    found = df.select(sources.parent_target(F.col("source")).alias("p"), sources.primary_source(F.col("source")).alias("s")).collect()
    assert [r.p for r in found] == ["0x17", "0x2B", '["0x47", "0x1B"]', "['0x03','0x0F']", "[]", "", None, "0x01"]
    assert [r.s for r in found] == ["0x17", "0x2B", "0x47", "0x03", "[]", "", None, "0x01"]
    classes = spark.createDataFrame([("0x17", "c1"), ("0x17", "c0"), ("0x47", "c2")], "target string, class string")
    assert sorted((r.source or "", r["class"]) for r in sources.with_class(df, "source", classes).collect()) == sorted((t or "", {"0x17": "c0", '["0x47", "0x1B"]': "c2"}.get(t, "?")) for t in texts)
