"""Variance of a score by slots: cell means, main and pair effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from designlens.operators.ranks import quantiles


def score_summary(designs: DataFrame, group: list[str], score: str) -> DataFrame:
    plain = designs.groupBy(*group).agg(F.count("*").alias("n"), F.min(score).alias("min"), F.max(score).alias("max"), F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 4).alias("sd_pop"))
    return plain.join(quantiles(designs, group, score, {"median": 0.5}), group)


def _moments(designs: DataFrame, group: list[str], score: str) -> DataFrame:
    return designs.groupBy(*group).agg(F.count("*").alias("n"), F.avg(score).alias("m"), F.var_pop(score).alias("v"))


def _share(cells: DataFrame, totals: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """Variance between cell means, as a share of the whole."""
    joined = cells.join(totals, group)
    between = F.sum(F.col("k") * (F.col("mean") - F.col("m")) ** 2) / F.max("n")
    return joined.groupBy(*group, *by).agg((between / F.nullif(F.max("v"), F.lit(0.0))).alias("share"))


def main_effects(designs: DataFrame, group: list[str], score: str) -> DataFrame:
    """Share of the variance that each slot explains alone."""
    cells = designs.select(*group, score, F.posexplode("slots").alias("slot", "part")).groupBy(*group, "slot", "part").agg(F.count("*").alias("k"), F.avg(score).alias("mean"))
    return _share(cells, _moments(designs, group, score), group, ["slot"]).withColumnRenamed("share", "main")


def pair_effects(designs: DataFrame, group: list[str], score: str) -> DataFrame:
    """Share of the variance that two slots explain together beyond each alone, at least 0.

    The pairs of slots are made inside the row; partial aggregation leaves a row
    for each pair of parts.
    """
    pairs = F.expr("flatten(transform(sequence(0, size(slots) - 2), i -> transform(sequence(i + 1, size(slots) - 1), j -> struct(i as i, j as j, slots[i] as a, slots[j] as b))))")
    cells = designs.select(*group, score, F.explode(pairs).alias("p")).select(*group, score, "p.*").groupBy(*group, "i", "j", "a", "b").agg(F.count("*").alias("k"), F.avg(score).alias("mean"))
    both = _share(cells, _moments(designs, group, score), group, ["i", "j"])
    main = main_effects(designs, group, score)
    one = lambda c: main.select(*group, F.col("slot").alias(c), F.col("main").alias(f"main_{c}"))
    joined = both.join(one("i"), [*group, "i"]).join(one("j"), [*group, "j"])
    return joined.select(*group, "i", "j", F.greatest(F.col("share") - F.col("main_i") - F.col("main_j"), F.lit(0.0)).alias("pair"))


def _slot_sets(n: Column, order: int) -> Column:
    """All ascending sets of ``order`` slots of n; of fewer slots the one set of all."""
    sets = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(i))
    for size in range(2, order + 1):
        more = lambda s: F.transform(F.sequence(F.element_at(s, -1) + 1, n - 1), lambda i: F.array_append(s, i))
        open_ = F.filter(sets, lambda s: F.element_at(s, -1) < n - 1)
        sets = F.when(n >= size, F.flatten(F.transform(open_, more))).otherwise(sets)
    return sets


def subset_effects(designs: DataFrame, group: list[str], score: str, order: int) -> DataFrame:
    """``group``, own (ascending slots, at most ``order``), size, together, effect: shares of the variance by sets of slots.

    together is the share that the means of the set's cells explain, effect what is left of it without the effects of
    all smaller sets inside (negative ones are kept); on a full grid of parts the effects of all sets add up to 1. A row
    meets its sets of the highest order only: the cells of smaller sets are sums of those cells. Shares are null where
    the score is constant. All slot arrays of a group have one length.
    """
    n = F.size("slots")
    each = designs.where(n > 0).select(*group, F.col(score).cast("double").alias("_y"), "slots", n.alias("_n"), F.explode(_slot_sets(n, order)).alias("own"))
    parts = F.transform("own", lambda i: F.get("slots", i)).alias("parts")
    top = each.select(*group, "_n", "_y", "own", parts).groupBy(*group, "_n", "own", "parts").agg(F.count("*").alias("k"), F.sum("_y").alias("s"))
    # a smaller set is summed from the one set that adds the first slots it lacks
    inside = F.filter(F.transform(F.sequence(F.lit(1), F.shiftleft(F.lit(1), order).cast("int") - 1), lambda m: F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: F.getbit(m, i) == 1)), lambda at: F.size(at) > 0)
    inside = F.array_distinct(inside)
    slots = lambda at: F.transform(at, lambda i: F.get("own", i))
    lacking = lambda t: F.slice(F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), t), 1, F.size("own") - F.size(t))
    rolled = top.select("*", F.explode(F.filter(inside, lambda at: F.array_sort(F.concat(slots(at), lacking(slots(at)))) == F.col("own"))).alias("at"))
    cells = rolled.select(*group, "k", "s", slots(F.col("at")).alias("set"), F.transform("at", lambda i: F.get("parts", i)).alias("values"))
    cells = cells.groupBy(*group, "set", "values").agg(F.sum("k").alias("k"), (F.sum("s") / F.sum("k")).alias("mean"))
    shares = _share(cells, _moments(designs, group, score), group, ["set"])
    # a group has one row for each of its sets, of which there are as many as slots allow, whatever its designs
    lattice = shares.groupBy(*group).agg(F.collect_list(F.struct(F.col("set").alias("own"), F.coalesce("share", F.lit(float("nan"))).alias("share"))).alias("all"))
    rows = lattice.select(*group, "all", F.explode("all").alias("x")).select(*group, "all", "x.own", F.col("x.share").alias("together"))
    below = F.filter("all", lambda t: F.size(F.array_except(t["own"], F.col("own"))) == 0)
    sign = lambda t: F.when((F.size("own") - F.size(t["own"])) % 2 == 0, 1.0).otherwise(-1.0)
    effect = F.aggregate(below, F.lit(0.0), lambda a, t: a + sign(t) * t["share"])
    return rows.select(*group, "own", F.size("own").alias("size"), F.nanvl("together", F.lit(None)).alias("together"), F.nanvl(effect, F.lit(None)).alias("effect"))


def order_shares(effects: DataFrame, group: list[str], order: int) -> DataFrame:
    """``group``, size, share: the effects of ``subset_effects`` summed by size, and what they leave as size ``order`` + 1."""
    by_size = effects.groupBy(*group, "size").agg(F.sum("effect").alias("share"))
    rest = by_size.groupBy(*group).agg(F.lit(order + 1).alias("size"), (1 - F.sum("share")).alias("share"))
    return by_size.unionByName(rest)
