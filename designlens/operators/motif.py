"""Motifs and depths of many small graphs at once: one row for each graph, nodes in an array, all work inside the row."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: edge(a, b): whether the earlier node a points to the later node b.
Edge = Callable[[Column, Column], Column]


def canonical(key: Column, k: int) -> Column:
    """The least of the adjacency strings (k * k of 0 and 1, by rows) that relabelling the nodes gives."""
    cell = lambda i, j: F.substring(key, i * k + j + 1, 1)
    return F.least(*[F.concat(*[cell(p[i], p[j]) for i in range(k) for j in range(k)]) for p in permutations(range(k))])


def motifs_of_three(graphs: DataFrame, keep: list[str], nodes: str, edge: Edge) -> DataFrame:
    """``keep``, motif (canonical string), n: connected induced subgraphs of three nodes, by graph."""
    bit = lambda a, b: F.when(edge(a.node, b.node), "1").otherwise("0")
    at = lambda name: F.posexplode(nodes).alias(f"{name}_at", name)
    rows = graphs.select(*keep, nodes, at("x")).select("*", at("y")).where("x_at < y_at").select("*", at("z")).where("y_at < z_at")
    named = lambda c: type("N", (), {"node": F.col(c)})
    x, y, z = map(named, "xyz")
    edges = rows.select(*keep, bit(x, y).alias("xy"), bit(x, z).alias("xz"), bit(y, z).alias("yz"))
    linked = edges.where(F.col("xy").cast("int") + F.col("xz").cast("int") + F.col("yz").cast("int") >= 2)
    raw = linked.groupBy(*keep, F.concat(F.lit("0"), "xy", "xz", F.lit("00"), "yz", F.lit("000")).alias("raw")).agg(F.count("*").alias("n"))
    return raw.groupBy(*keep, canonical(F.col("raw"), 3).alias("motif")).agg(F.sum("n").alias("n"))


def depth(nodes: Column, edge: Edge) -> Column:
    """The longest path of a graph whose edges lead from earlier to later nodes."""
    none = F.array().cast("array<struct<node:bigint,depth:int>>")

    def step(done: Column, node: Column) -> Column:
        reached = F.array_max(F.transform(done, lambda d: F.when(edge(d["node"], node), d["depth"] + 1)))
        return F.array_append(done, F.struct(node.cast("bigint").alias("node"), F.coalesce(reached, F.lit(0)).alias("depth")))

    return F.array_max(F.transform(F.aggregate(nodes, none, step), lambda d: d["depth"]))


def tier_log_odds(counts: DataFrame, tiers: DataFrame, key: str, group: list[str]) -> DataFrame:
    """log2 of a motif's presence rate in the top tier over that in the bottom tier, null unless both are above 0.

    ``tiers`` (``key``, ``group``, is_top, is_bottom) has a row for each graph, ``counts`` (``key``, motif) one for each motif in it.
    """
    size = tiers.groupBy(*group).agg(F.count_if("is_top").alias("n_top"), F.count_if("is_bottom").alias("n_bottom"))
    own = counts.join(tiers.where("is_top or is_bottom"), key).groupBy(*group, "motif").agg(F.count_if("is_top").alias("top_with"), F.count_if("is_bottom").alias("bottom_with"))
    top, bottom = F.col("top_with") / F.col("n_top"), F.col("bottom_with") / F.col("n_bottom")
    odds = F.when((F.col("top_with") > 0) & (F.col("bottom_with") > 0), F.round(F.log2(top / bottom), 6))
    return own.join(size, group).select(*group, "motif", "top_with", "bottom_with", "n_top", "n_bottom", odds.alias("log_odds"))


def tier_rates(presence: DataFrame, counts: DataFrame, key: str, group: list[str], tiers: list[str]) -> DataFrame:
    """``group``, motif, tier, n_graphs, n_with, n_designs, with_motif, rate, tier_graphs: shares of a tier's designs whose graph holds a motif.

    ``counts`` (``key``, ``group``, and a column of designs for each tier) has a row for each graph, ``presence`` (``key``,
    motif) one for each motif in it. Every motif has a row for each group and tier, zeros included; the rate is null
    where a tier is empty. n_graphs and n_with count all graphs, tier_graphs those with the motif and a design in the tier.
    """
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.coalesce(t, F.lit(0)).cast("bigint").alias("n")) for t in tiers])).alias("t")
    long = counts.select(key, *group, each).select(key, *group, "t.*")
    own = presence.select(key, "motif").distinct()
    totals = long.groupBy(*group, "tier").agg(F.count("*").alias("n_graphs"), F.sum("n").alias("n_designs"))
    held = long.join(own, key).groupBy(*group, "motif", "tier").agg(F.count("*").alias("n_with"), F.sum("n").alias("with_motif"), F.count_if(F.col("n") > 0).alias("tier_graphs"))
    # classes of one k by tiers: a small grid
    grid = totals.crossJoin(own.select("motif").distinct()).join(held, [*group, "motif", "tier"], "left").fillna(0, ["n_with", "with_motif", "tier_graphs"])
    rate = F.round(F.col("with_motif") / F.nullif(F.col("n_designs"), F.lit(0)), 9)
    return grid.select(*group, "motif", "tier", "n_graphs", "n_with", "n_designs", "with_motif", rate.alias("rate"), "tier_graphs")


def tail_odds(rates: DataFrame, group: list[str], tails: list[str], top: str, bottom: str) -> DataFrame:
    """``group``, motif and log_odds_.. for each of ``tails``: log2 of a motif's rate in the top tail over that in the bottom one, null unless both are above 0."""
    at = lambda name: F.max(F.when(F.col("tier") == name, F.col("rate")))
    wide = rates.groupBy(*group, "motif").agg(*[at(f"{side}_{t}").alias(f"{side}_{t}") for t in tails for side in (top, bottom)])
    odds = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.round(F.log2(F.col(a) / F.col(b)), 6))
    return wide.select(*group, "motif", *[odds(f"{top}_{t}", f"{bottom}_{t}").alias(f"log_odds_{t}") for t in tails])
