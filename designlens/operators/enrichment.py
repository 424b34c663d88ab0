"""Top against bottom tails: where parts are over-represented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from designlens.operators.ranks import quantiles


def with_tails(designs: DataFrame, group: list[str], score: str, top: float = 0.95, bottom: float = 0.05) -> DataFrame:
    """``designs`` with ``is_top`` and ``is_bottom``: inclusive tails of each group by interpolated quantiles.

    Thresholds are exact and come from ranges of scores, so no group is held or sorted in one task.
    """
    cuts = quantiles(designs, group, score, {"_top": top, "_bottom": bottom})
    out = designs.join(cuts, group)
    return out.withColumns({"is_top": F.col(score) >= F.col("_top"), "is_bottom": F.col(score) <= F.col("_bottom")})


def tail_bookkeeping(designs: DataFrame, group: list[str], score: str) -> DataFrame:
    """Thresholds, tail sizes, ties at the thresholds and overlap of each group."""
    n = lambda c: F.count_if(c)
    t = with_tails(designs, group, score)
    return t.groupBy(*group).agg(
        F.count("*").alias("n_designs"), F.max("_top").alias("top_threshold"), F.max("_bottom").alias("bottom_threshold"),
        n(F.col("is_top")).alias("n_top"), n(F.col("is_bottom")).alias("n_bottom"),
        n(F.col(score) == F.col("_top")).alias("ties_top"), n(F.col(score) == F.col("_bottom")).alias("ties_bottom"), n(F.col("is_top") & F.col("is_bottom")).alias("overlap"),
    )


def slot_tail_log_odds(designs: DataFrame, group: list[str], score: str, parts: DataFrame) -> DataFrame:
    """ln((top + 1) / (bottom + 1)) for every slot and every part of the library, cells without designs included."""
    t = with_tails(designs, group, score).where("is_top or is_bottom")
    long = t.select(*group, "is_top", "is_bottom", F.posexplode("slots").alias("slot", "part"))
    counts = long.groupBy(*group, "slot", "part").agg(F.count_if(F.col("is_top")).alias("n_top"), F.count_if(F.col("is_bottom")).alias("n_bottom"))
    cells = designs.groupBy(*group).agg(F.max(F.size("slots")).alias("k")).select(*group, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("slot")).crossJoin(parts)
    full = cells.join(counts, [*group, "slot", "part"], "left").fillna(0, ["n_top", "n_bottom"])
    return full.withColumn("log_odds", F.round(F.log((F.col("n_top") + 1) / (F.col("n_bottom") + 1)), 9))


def presence_statistics(top_part: Column, bottom_part: Column, top_n: Column, bottom_n: Column) -> dict[str, Column]:
    """Smoothed presence probabilities of both tails and the log2 of their ratio."""
    p, q = (top_part + 1) / (top_n + 2), (bottom_part + 1) / (bottom_n + 2)
    return {"p_top": F.round(p, 9), "p_bottom": F.round(q, 9), "log2_ratio": F.round(F.log2(p / q), 9)}


def presence(designs: DataFrame, roles: DataFrame, score: str, parts: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Presence of every part in each role context, once per design; exposure by distinct (topology, context).

    ``designs`` has topology, group_no, slots and, for a breakdown, the ``extra``
    columns; tails are those of a topology. Parts are deduplicated inside a row
    before anything is shuffled.
    """
    extra = extra or []
    t = with_tails(designs, ["topology"], score).where("is_top or is_bottom")
    by_role = roles.groupBy("group_no", "role").agg(F.sort_array(F.collect_list("slot")).alias("role_slots"))
    inside = t.join(by_role, "group_no")
    own = F.array_distinct(F.transform(F.col("role_slots"), lambda i: F.element_at("slots", i + 1)))
    counts = inside.select(*extra, "role", "is_top", "is_bottom", F.explode(own).alias("part")).groupBy(*extra, "role", "part").agg(F.count_if(F.col("is_top")).alias("top_part"), F.count_if(F.col("is_bottom")).alias("bottom_part"))
    exposure = inside.groupBy(*extra, "role").agg(F.count_if(F.col("is_top")).alias("top_n"), F.count_if(F.col("is_bottom")).alias("bottom_n"), F.countDistinct("topology").alias("n_topologies"))
    full = exposure.crossJoin(parts).join(counts, [*extra, "role", "part"], "left").fillna(0, ["top_part", "bottom_part"])
    stats = presence_statistics(F.col("top_part"), F.col("bottom_part"), F.col("top_n"), F.col("bottom_n"))
    return full.withColumns(stats).select(*extra, "role", "part", "top_part", "bottom_part", "top_n", "bottom_n", "n_topologies", *stats)


def occurrence(designs: DataFrame, roles: DataFrame, score: str, parts: DataFrame, sources: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """Occurrences of every part in each role, by position: a part in two slots of a role counts twice; log2 odds of the tails.

    With ``sources`` (group_no, ``source``) a design counts once for each of its sources.
    """
    extra = [source] if source else []
    t = with_tails(designs, ["topology"], score).where("is_top or is_bottom").select("topology", "group_no", "is_top", "is_bottom", F.posexplode("slots").alias("slot", "part"))
    inside = t.join(roles, ["group_no", "slot"])
    # sums by topology are small before they are copied to its sources
    sums = inside.groupBy("topology", "group_no", "role", "part").agg(F.count_if("is_top").alias("top_n"), F.count_if("is_bottom").alias("bottom_n"))
    sums = sums.join(sources, "group_no") if sources is not None else sums
    counts = sums.groupBy(*extra, "role", "part").agg(F.sum("top_n").alias("top_n"), F.sum("bottom_n").alias("bottom_n"))
    contexts = sums.groupBy(*extra, "role").agg(F.count_distinct("topology").alias("n_topologies"))
    full = contexts.crossJoin(parts).join(counts, [*extra, "role", "part"], "left").fillna(0, ["top_n", "bottom_n"])
    return full.select(*extra, "role", "part", "top_n", "bottom_n", "n_topologies", F.round(F.log2((F.col("top_n") + 1) / (F.col("bottom_n") + 1)), 9).alias("log_odds"))


def top_rules(table: DataFrame, k: int, effect: str = "log2_ratio", min_topologies: int = 2, min_support: int = 5) -> DataFrame:
    """The k strongest effects with enough support, in a total order, with their direction."""
    enough = table.where((F.col("n_topologies") >= min_topologies) & (F.col("top_part") + F.col("bottom_part") >= min_support))
    best = enough.orderBy(F.abs(effect).desc(), "role", "part").limit(k)
    rank = F.row_number().over(Window.orderBy(F.abs(effect).desc(), "role", "part"))
    return best.select(rank.alias("rank"), "role", "part", effect, F.when(F.col(effect) > 0, "enriched").otherwise("depleted").alias("direction"))
