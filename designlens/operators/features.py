"""Features of designs against their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlations(rows: DataFrame, group: list[str], features: list[str], score: str) -> DataFrame:
    """``group``, feature, n, r: Pearson correlation of each feature with the score; null where either is constant."""
    each = rows.select(*group, F.col(score).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("f")).select(*group, "y", "f.*")
    m = each.groupBy(*group, "feature").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    scale = F.sqrt(F.col("xx") * F.col("yy"))
    return m.select(*group, "feature", "n", F.when(scale > 0, F.col("xy") / scale).alias("r"))


def differences(rows: DataFrame, group: list[str], features: list[str], one: str, two: str) -> DataFrame:
    """``group``, feature, n_one, n_two, d: difference of the means of two sets of rows over their pooled sample deviation."""
    each = rows.where(F.col(one) | F.col(two)).select(*group, one, two, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("f")).select(*group, one, two, "f.*")
    a, b = F.when(F.col(one), F.col("x")), F.when(F.col(two), F.col("x"))
    m = each.groupBy(*group, "feature").agg(F.count(a).alias("n_one"), F.count(b).alias("n_two"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    pooled = F.sqrt((F.col("n_one") * F.col("va") + F.col("n_two") * F.col("vb")) / F.nullif(F.col("n_one") + F.col("n_two") - 2, F.lit(0)))
    return m.select(*group, "feature", "n_one", "n_two", F.when(pooled > 0, (F.col("ma") - F.col("mb")) / pooled).alias("d"))


def profile_correlations(cells: DataFrame, item: str, cell: list[str], value: str, least: int) -> DataFrame:
    """a, b, n_shared, r, low_confidence for items with a common cell; ``cells`` has at most one value for an item and a cell.

    Items meet in their cells, so the work is bounded by the square of the library for each cell.
    """
    side = lambda n, v: cells.select(*cell, F.col(item).alias(n), F.col(value).cast("double").alias(v))
    met = side("a", "x").join(side("b", "y"), cell).where("a < b")
    m = met.groupBy("a", "b").agg(F.count("*").alias("n_shared"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    scale = F.sqrt(F.col("xx") * F.col("yy"))
    return m.select("a", "b", "n_shared", F.when(scale > 0, F.col("xy") / scale).alias("r"), (F.col("n_shared") < least).alias("low_confidence"))


def profile_rank_correlations(cells: DataFrame, item: str, cell: list[str], value: str, least: int) -> DataFrame:
    """As ``profile_correlations``, of the ranks within each pair's common cells; equal values share their mean rank.

    Ranks change with the pair, so they are taken anew in each; a pair has at most one row a cell.
    """
    side = lambda n, v: cells.select(*cell, F.col(item).alias(n), F.col(value).cast("double").alias(v))
    met = side("a", "x").join(side("b", "y"), cell).where("a < b")
    rank = lambda v: F.rank().over(Window.partitionBy("a", "b").orderBy(v)) + (F.count("*").over(Window.partitionBy("a", "b", v)) - 1) / 2
    ranked = met.select("a", "b", rank("x").alias("x"), rank("y").alias("y"))
    m = ranked.groupBy("a", "b").agg(F.count("*").alias("n_shared"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    scale = F.sqrt(F.col("xx") * F.col("yy"))
    return m.select("a", "b", "n_shared", F.when(scale > 0, F.col("xy") / scale).alias("r"), (F.col("n_shared") < least).alias("low_confidence"))


def symmetric(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Both halves of a matrix from one: each pair in either order."""
    return pairs.select(F.explode(F.array(F.struct(F.col(a).alias("row"), F.col(b).alias("column")), F.struct(F.col(b).alias("row"), F.col(a).alias("column")))).alias("p"), value).select("p.*", value)


def nearest(rows: DataFrame, others: DataFrame, group: list[str], key: str, features: list[str]) -> DataFrame:
    """For each row the nearest of ``others`` in its group by features that are z-scored within the group; null if there is none.

    Ties go to the least key. Rows meet the others of their group, not all of them.
    """
    both = rows.select(*group, key, *features, F.lit(True).alias("asks")).unionByName(others.select(*group, key, *features, F.lit(False).alias("asks")))
    stats = both.groupBy(*group).agg(*[e for c in features for e in (F.avg(c).alias(f"m_{c}"), F.nullif(F.stddev_pop(c), F.lit(0.0)).alias(f"s_{c}"))])
    scored = both.join(stats, group).select(*group, key, "asks", *[F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), F.lit(0.0)).alias(c) for c in features])
    asked = scored.where("asks").select(*group, key, *[F.col(c).alias(f"own_{c}") for c in features])
    given = scored.where("not asks").select(*group, F.col(key).alias("partner"), *features)
    gap = F.round(F.sqrt(sum((F.col(c) - F.col(f"own_{c}")) ** 2 for c in features)), 6)
    best = F.min(F.when(F.col("partner").isNotNull(), F.struct(gap.alias("distance"), "partner"))).alias("b")
    return asked.join(given, group, "left").groupBy(*group, key).agg(best).select(*group, key, "b.partner", "b.distance")


def coverage_curve(counts: DataFrame, group: list[str], item: str, n: str) -> DataFrame:
    """Items of a group by falling count, with the share of the whole that they and those before them make up."""
    w = Window.partitionBy(*group).orderBy(F.desc(n), item)
    total = F.sum(n).over(Window.partitionBy(*group))
    upto = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*group, item, n, F.row_number().over(w).alias("rank"), (upto / total).alias("share"))


def tier_cells(rows: DataFrame, group: list[str], item: str, tiers: dict[str, str]) -> DataFrame:
    """Share of each tier's rows that hold the item, and whether it falls from the first tier to the last, and how much.

    ``rows`` has a row for each design and item that it holds; ``tiers`` maps names to boolean columns. sharpness is the first share over the last.
    """
    names = list(tiers)
    size = rows.groupBy(*group, "design").agg(*[F.bool_or(c).alias(t) for t, c in tiers.items()]).groupBy(*group).agg(*[F.count_if(t).alias(f"all_{t}") for t in names])
    own = rows.groupBy(*group, item).agg(*[F.count_if(c).alias(f"n_{t}") for t, c in tiers.items()])
    share = {t: F.col(f"n_{t}") / F.nullif(F.col(f"all_{t}"), F.lit(0)) for t in names}
    falls = F.lit(True)
    for t, u in zip(names, names[1:]):
        falls = falls & (share[t] >= share[u])
    return own.join(size, group).select(*group, item, *[F.round(v, 6).alias(f"share_{t}") for t, v in share.items()], falls.alias("monotone"), F.round(share[names[0]] / F.nullif(share[names[-1]], F.lit(0.0)), 6).alias("sharpness"))


def pair_enrichment(tails: DataFrame, roles: DataFrame, min_support: int, min_topologies: int) -> DataFrame:
    """Pairs of parts in pairs of roles: occurrences in both tails and log2 odds, where support and breadth suffice.

    ``tails`` has topology, group_no, slots, is_top, is_bottom; ``roles`` group_no, slot, role. Pairs are made inside the row; the lesser (role, part) comes first.
    """
    named = roles.groupBy("group_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "role"))), lambda r: r["role"]).alias("roles"))
    rows = tails.where("is_top or is_bottom").join(named, "group_no")
    held = F.array_sort(F.zip_with("roles", "slots", lambda r, p: F.struct(r.alias("role"), p.alias("part"))))
    pairs = F.flatten(F.transform(F.col("held"), lambda a, i: F.transform(F.filter(F.col("held"), lambda b, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = rows.withColumn("held", held).select("topology", "is_top", "is_bottom", F.explode(pairs).alias("p"))
    n = each.groupBy(F.col("p.a.role").alias("role_a"), F.col("p.a.part").alias("part_a"), F.col("p.b.role").alias("role_b"), F.col("p.b.part").alias("part_b")).agg(
        F.count_if("is_top").alias("top_n"), F.count_if("is_bottom").alias("bottom_n"), F.count_distinct("topology").alias("n_topologies")
    )
    fit = n.where((F.col("top_n") + F.col("bottom_n") >= min_support) & (F.col("n_topologies") >= min_topologies))
    return fit.withColumn("log_odds", F.round(F.log2((F.col("top_n") + 1) / (F.col("bottom_n") + 1)), 6))
