"""Attribution over coalitions of slots: what a design's parts are worth together.

A coalition keeps some slots of a design; the others are completed from a pool
of designs of the same group. A completion is safe if no family is used twice.
Coalitions are numbered by bit masks, so a design of n slots has 2^n of them.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from designlens.operators.attribution import Scorer, candidates, strongest
from designlens.operators.expectations import report
from designlens.shared import once


def completion_pool(designs: DataFrame, group: list[str], key: str, n: int) -> DataFrame:
    """At most ``n`` distinct slot arrays of each group, in the order of a hash of the key: ``group``, pool_slots."""
    distinct = designs.groupBy(*group, "slots").agg(F.min(key).alias("k"))
    order = [F.pmod(F.col("k") * 7919, F.lit(10007)), F.col("k")]
    return distinct.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("r") <= n).select(*group, F.col("slots").alias("pool_slots"))


def hybrids(anchors: DataFrame, pool: DataFrame, group: list[str], key: str, families: int, masks: DataFrame | None = None) -> DataFrame:
    """``key``, n, mask, mixed (slots kept by the mask, the others from the pool), safe: every coalition with every row of the pool.

    With ``masks`` (n, mask) only those coalitions are made; without, all 2^n of them.
    """
    met = anchors.select(*group, key, "slots").join(pool, group)
    n = F.size("slots")
    each = met.select(key, "slots", "pool_slots", n.alias("n"))
    if masks is None:
        each = each.select("*", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), n).cast("int") - 1)).alias("mask"))
    else:
        each = each.join(masks.select("n", "mask").distinct(), "n")
    kept = F.transform("slots", lambda p, i: F.when(F.floor(F.col("mask") / F.pow(F.lit(2), i)) % 2 == 1, p).otherwise(F.get("pool_slots", i)))
    mixed = each.select(key, "n", "mask", kept.alias("mixed"))
    own = F.transform("mixed", lambda p: p % families)
    return mixed.withColumn("safe", F.size(F.array_distinct(own)) == F.size("mixed"))


def coalition_values(mixed: DataFrame, key: str, scorer: Scorer) -> DataFrame:
    """``key``, n, mask, v: the mean score of a coalition's safe completions; null if it has none, never an unsafe one instead."""
    return mixed.groupBy(key, "n", "mask").agg(F.avg(F.when(F.col("safe"), scorer(F.col("mixed")))).alias("v"), F.count_if("safe").alias("n_safe"))


def _by_mask(values: DataFrame, key: str) -> DataFrame:
    # at most 2^n values of a design
    return values.groupBy(key, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("mask", "v"))), lambda x: x["v"]).alias("v"))


def _weights(n: int, taken: int) -> list[float]:
    """Weight of a coalition by its size: s! (n - s - taken)! / (n - taken + 1)!."""
    return [factorial(s) * factorial(n - s - taken) / factorial(n - taken + 1) for s in range(n - taken + 1)]


def _weight(size: Column, taken: int, largest: int) -> Column:
    table = F.array(*[F.array(*[F.lit(w) for w in (_weights(n, taken) if n >= taken else [0.0])]) for n in range(largest + 1)])
    return F.get(F.get(table, F.col("n")), size)


def _at(mask: Column) -> Column:
    return F.get("v", mask.cast("int"))


def _bit(i: Column) -> Column:
    return F.pow(F.lit(2), i).cast("int")


def shapley_main(values: DataFrame, key: str, largest: int = 7) -> DataFrame:
    """``key``, slot, phi: exact main values; they add up to v(all) - v(none). Null where a coalition has no value."""
    rows = _by_mask(values, key).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    free = F.filter(F.sequence(F.lit(0), F.size("v") - 1), lambda m: F.floor(m / _bit(F.col("slot"))) % 2 == 0)
    gain = lambda a, m: a + _weight(F.bit_count(m), 1, largest) * (_at(m + _bit(F.col("slot"))) - _at(m))
    return rows.select(key, "slot", F.aggregate(free, F.lit(0.0), gain).alias("phi"))


def shapley_pair(values: DataFrame, key: str, largest: int = 7) -> DataFrame:
    """``key``, i, j (i < j), phi: exact pair interactions, the four-term difference over coalitions without both."""
    pairs = F.expr("flatten(transform(sequence(0, n - 2), i -> transform(sequence(i + 1, n - 1), j -> struct(i as i, j as j))))")
    rows = _by_mask(values, key).select("*", F.explode(pairs).alias("p")).select(key, "n", "v", "p.*")
    a, b = _bit(F.col("i")), _bit(F.col("j"))
    free = F.filter(F.sequence(F.lit(0), F.size("v") - 1), lambda m: (F.floor(m / a) % 2 == 0) & (F.floor(m / b) % 2 == 0))
    gain = lambda t, m: t + _weight(F.bit_count(m), 2, largest) * (_at(m + a + b) - _at(m + a) - _at(m + b) + _at(m))
    return rows.select(key, "i", "j", F.aggregate(free, F.lit(0.0), gain).alias("phi"))


def orderings(spark: SparkSession, largest: int, samples: int, seed: int) -> DataFrame:
    """n, sample, back, place, slot, mask: orderings of up to ``largest`` slots and their reverses, step by step.

    Place 0 is the empty coalition, mask the coalition after the step. An ordering is
    sorted by a hash of seed, sample and slot, so it is the same in every run; many
    orderings share their prefixes. At most ``largest`` * ``samples`` orderings of n <= 62.
    """
    hashed = lambda i: F.struct(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("sample").cast("string"), i.cast("string"))).alias("h"), i.alias("i"))
    sizes = spark.range(samples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(1), F.lit(largest))).alias("n"))
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n") - 1), hashed)), lambda x: x["i"])
    both = sizes.select("n", "sample", order.alias("order")).select("n", "sample", F.posexplode(F.array("order", F.reverse("order"))).alias("back", "order"))
    steps = both.select("n", "sample", "back", "order", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("place"))
    mask = F.aggregate(F.slice("order", 1, F.col("place")), F.lit(0).cast("bigint"), lambda a, i: a + F.pow(F.lit(2), i).cast("bigint"))
    return steps.select("n", "sample", "back", "place", F.when(F.col("place") > 0, F.get("order", F.col("place") - 1)).alias("slot"), mask.alias("mask"))


def shapley_sampled(values: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """``key``, slot, phi, error: main values from the orderings ``steps``, and their standard errors.

    A slot's gain is the value after it joins less the one before; an ordering and its
    reverse count as one draw, whose error is the lesser for it. Values of an ordering
    add up to v(all) - v(none). Null where a coalition that is needed has no value; the
    error is null with fewer than two samples.
    """
    met = values.withColumn("mask", F.col("mask").cast("bigint")).join(steps, ["n", "mask"])
    before = F.lag("v").over(Window.partitionBy(key, "sample", "back").orderBy("place"))
    gains = met.select(key, "sample", "place", "slot", (F.col("v") - before).alias("gain")).where("place > 0")
    # null gains must not shift the mean of a draw
    draws = gains.groupBy(key, "slot", "sample").agg(F.when(F.count("gain") == F.count("*"), F.avg("gain")).alias("g"))
    whole = F.count("g") == F.count("*")
    return draws.groupBy(key, "slot").agg(F.when(whole, F.avg("g")).alias("phi"), F.when(whole, F.stddev_samp("g") / F.sqrt(F.count("g"))).alias("error"))


def validity_by_size(mixed: DataFrame) -> DataFrame:
    """Share of completions that use a family twice, by the number of slots of the design and of those kept."""
    return mixed.groupBy("n", F.bit_count("mask").cast("int").alias("kept")).agg(F.count("*").alias("n_mixed"), F.round(F.avg((~F.col("safe")).cast("double")), 6).alias("unsafe"))


def double_swaps(designs: DataFrame, key: str, scorer: Scorer, n: int, parts: int = 25, families: int = 12) -> DataFrame:
    """``key``, i, j, to_i, to_j, delta: pairs of the ``n`` strongest single swaps of two slots that use no family twice; ``designs`` use none twice.

    The pairs of a design are made from its row, without a shuffle.
    """
    rows = candidates(designs, key, scorer, parts, families)
    best = F.transform("swaps", lambda s, i: F.transform(strongest(s, F.get("slots", i), n), lambda x: x["to"]))
    rows = once(rows, [key, "slots", "score"], best=best)
    first = rows.select("*", F.posexplode("best").alias("i", "own")).select("*", F.explode("own").alias("to_i"))
    later = first.select("*", F.posexplode(F.slice("best", F.col("i") + 2, F.size("best"))).alias("at", "other")).select("*", F.explode("other").alias("to_j"))
    fit = later.where(F.col("to_i") % families != F.col("to_j") % families).withColumn("j", F.col("i") + F.col("at") + 1)
    mixed = F.transform("slots", lambda p, k: F.when(k == F.col("i"), F.col("to_i")).when(k == F.col("j"), F.col("to_j")).otherwise(p))
    return fit.select(key, "i", "j", "to_i", "to_j", (scorer(mixed) - F.col("score")).alias("delta"))


def attribution_rules(main: DataFrame, pairs: DataFrame, totals: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """rule, violations over designs: finite values, a pair for every two slots, main values that add up to ``total``."""
    m = main.groupBy(key).agg(F.sum("phi").alias("sum_phi"), F.count("*").alias("n_main"), F.count_if(F.col("phi").isNull() | F.isnan("phi")).alias("odd_main"))
    p = pairs.groupBy(key).agg(F.count("*").alias("n_pair"), F.count_if(F.col("phi").isNull() | F.isnan("phi")).alias("odd_pair"))
    met = totals.join(m, key, "left").join(p, key, "left")
    return report(met, {
        "finite": (F.col("odd_main") == 0) & (F.col("odd_pair") == 0),
        "complete": (F.col("n_main") == F.col("n")) & (2 * F.col("n_pair") == F.col("n") * (F.col("n") - 1)),
        "efficient": F.abs(F.col("sum_phi") - F.col("total")) <= tolerance * F.greatest(F.abs("total"), F.lit(1.0)),
    })
