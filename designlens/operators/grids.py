"""Grids, dependences and roll-ups over designs and their attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_of_means(rows: DataFrame, row: str, column: str, values: list[str], score: str) -> DataFrame:
    """A row for each ``row`` value: mean and count of each of the stated ``column`` values (null and 0 where empty), and the median of its means."""
    cells = rows.groupBy(row, column).agg(F.avg(score).alias("mean"), F.count(score).alias("n"))
    at = lambda v, c: F.max(F.when(F.col(column) == v, F.col(c)))
    wide = cells.groupBy(row).agg(*[at(v, "mean").alias(f"mean_{v}") for v in values], *[F.coalesce(at(v, "n"), F.lit(0).cast("bigint")).alias(f"n_{v}") for v in values])
    known = F.array_sort(F.array_compact(F.array(*[F.col(f"mean_{v}") for v in values])))
    half = F.floor((F.size(known) - 1) / 2).cast("int")
    return wide.withColumn("middle", (F.get(known, half) + F.get(known, F.size(known) - 1 - half)) / 2)


def position_dependence(rows: DataFrame, item: str, place: str, score: str) -> DataFrame:
    """For each item the places it stands in, and mean, sample deviation and range of its mean score over them."""
    cells = rows.groupBy(item, place).agg(F.avg(score).alias("cell"))
    return cells.groupBy(item).agg(F.count("*").alias("n_places"), F.avg("cell").alias("mean"), F.stddev_samp("cell").alias("sd"), (F.max("cell") - F.min("cell")).alias("spread"))


def explained(rows: DataFrame, item: str, place: str, score: str) -> DataFrame:
    """factor, eta2: the share of the variance of cell means that the items, and that the places, explain."""
    cells = rows.groupBy(item, place).agg(F.avg(score).alias("cell"))
    both = cells.select(F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level"), "cell") for c in (item, place)])).alias("x")).select("x.*")
    total = both.groupBy("factor").agg((F.var_pop("cell") * F.count("*")).alias("ss"), F.avg("cell").alias("m"))
    level = both.groupBy("factor", "level").agg(F.count("*").alias("k"), F.avg("cell").alias("lm"))
    return level.join(total, "factor").groupBy("factor").agg((F.sum(F.col("k") * (F.col("lm") - F.col("m")) ** 2) / F.nullif(F.max("ss"), F.lit(0.0))).alias("eta2"))


def migration(rows: DataFrame, group: list[str], old: str, new: str, old_n: str, new_n: str) -> DataFrame:
    """How a metric changes between two definitions: sign flips, largest and mean change, range of the ratio of exposures."""
    ratio = F.col(new_n) / F.nullif(F.col(old_n), F.lit(0))
    change = F.abs(F.col(new) - F.col(old))
    return rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if(F.col(old) * F.col(new) < 0).alias("sign_flips"), F.max(change).alias("max_change"), F.avg(change).alias("mean_change"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio")
    )


def master(rows: DataFrame, group: list[str], item: str, source: str, order: dict[str, int], key: str, score: str) -> DataFrame:
    """One row for each item of a group: the key from its first source by ``order``, a flag for each source, its best score."""
    rank = F.coalesce(*[F.when(F.col(source) == s, r) for s, r in order.items()], F.lit(len(order)))
    flags = [F.bool_or(F.coalesce(F.col(source) == s, F.lit(False))).alias(f"from_{s.lower()}") for s in order]
    return rows.groupBy(*group, item).agg(F.min(F.struct(rank.alias("rank"), F.col(key).alias("key"))).alias("first"), *flags, F.count("*").alias("n_rows"), F.max(score).alias(score)).withColumns({key: F.col("first.key"), "first_rank": F.col("first.rank")}).drop("first")


def contribution_stack(rows: DataFrame, key: list[str], part: str, phi: str, shown: list[int]) -> DataFrame:
    """Contributions by sign: the shown parts under their number, the others folded into ``other``; zeros left out."""
    label = F.when(F.col(part).isin(shown), F.col(part).cast("string")).otherwise("other")
    return rows.where(F.col(phi) != 0).groupBy(*key, label.alias("label"), F.signum(phi).cast("int").alias("sign")).agg(F.sum(phi).alias("phi"), F.count("*").alias("n"))


def contribution_grid(rows: DataFrame, part: str, axes: dict[str, list], value: str, n: int, decimals: int = 6) -> DataFrame:
    """Mean contribution of the ``n`` most frequent parts in each cell of the stated axes; null where a cell has no row.

    Values have at most ``decimals`` decimals; they are added as such, so a mean does not depend on the order of the rows.
    """
    top = rows.groupBy(part).agg(F.count("*").alias("total")).orderBy(F.desc("total"), part).limit(n)
    grid = top.select(part)
    for axis, values in axes.items():
        grid = grid.withColumn(axis, F.explode(F.array(*[F.lit(v) for v in values])))
    total = F.sum(F.col(value).cast(f"decimal({12 + decimals},{decimals})")).cast("double")
    means = rows.groupBy(part, *axes).agg((total / F.nullif(F.count(value), F.lit(0))).alias("mean"), F.count("*").alias("n"))
    return grid.join(means, [part, *axes], "left").fillna(0, ["n"])


def pair_consensus(pairs: DataFrame, group: str, a: str, b: str, phi: str) -> DataFrame:
    """Pairs of labels over groups: mean within a group, then across groups, whether the sign is the same in all, total strength.

    A pair has its lesser label first.
    """
    first, second = F.least(a, b).alias("first"), F.greatest(a, b).alias("second")
    within = pairs.select(group, first, second, phi).groupBy(group, "first", "second").agg(F.avg(phi).alias("own"))
    return within.groupBy("first", "second").agg(
        F.count("*").alias("n_groups"), F.avg("own").alias("mean"), (F.count_distinct(F.signum("own")) == 1).alias("consistent"), F.sum(F.abs("own")).alias("strength")
    )


def class_rollup(rows: DataFrame, item: str, label: Column) -> DataFrame:
    """label, n_items (distinct), n_rows. The label is worked out once for each item, not for each row."""
    items = rows.groupBy(item).agg(F.count("*").alias("k"))
    return items.groupBy(label.alias("label")).agg(F.count("*").alias("n_items"), F.sum("k").alias("n_rows"))


def assignment_space(library: DataFrame, part: str, family: Column, slots: int, most: int = 10_000) -> DataFrame:
    """Every array of ``slots`` parts of the library that uses no family twice.

    The library, at most ``most`` parts (more raise an error), goes along as an array; arrays grow by a slot at a time and are dealt anew after each.
    """
    spark = library.sparkSession
    own = library.select(F.col(part).alias("part"), family.alias("family")).where("part is not null").distinct()
    rows = own.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a library of more than {most} parts")
    if not rows:
        return spark.createDataFrame([], "slots array<int>")
    parts = F.array(*[F.struct(F.lit(int(r.part)).alias("part"), F.lit(int(r.family)).alias("family")) for r in sorted(rows)])
    grown = spark.range(1).select(F.array().cast("array<int>").alias("slots"), F.array().cast("array<int>").alias("used"))
    for k in range(slots):
        free = F.filter(parts, lambda p: ~F.array_contains("used", p["family"]))
        grown = grown.select("slots", "used", F.explode(free).alias("p")).select(F.array_append("slots", F.col("p.part")).alias("slots"), F.array_append("used", F.col("p.family")).alias("used"))
        if k < slots - 1:
            grown = grown.repartition(F.col("slots"))
    return grown.select("slots")
