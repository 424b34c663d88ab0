"""Neighbours of chosen rows by index keys: score bands and few differing slots, without meeting a whole group."""

from __future__ import annotations

from math import log1p

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from designlens.functions.slots import differing, hamming


def _anchored(anchors: DataFrame, group: list[str]) -> DataFrame:
    return anchors.select(*group, *[F.col(c).alias(f"anchor_{c}") for c in anchors.columns if c not in group])


def band_matches(rows: DataFrame, anchors: DataFrame, group: list[str], score: str, share: float) -> DataFrame:
    """Rows of each anchor's group (and the ``anchor_...`` columns) whose score is within ``share`` of the anchor's, 0 < share < 1.

    Scores fall into cells whose ends grow by that share, so an anchor meets the few cells of its band only; what meets
    is compared exactly. Null scores match nothing, 0 matches 0.
    """
    width = log1p(share)
    cell = lambda v: F.when(v == 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.ln(F.abs(v)) / width))
    value, own = F.col(score).cast("double"), F.col(f"anchor_{score}").cast("double")
    # one cell more at either end, as logarithms are rounded
    cells = F.when(own == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(cell(own * (1 - share)) - 1, cell(own * (1 + share)) + 1))
    asked = _anchored(anchors, group).where(own.isNotNull()).select("*", F.signum(own).alias("_sign"), F.explode(cells).alias("_cell"))
    keyed = rows.where(value.isNotNull()).withColumns({"_sign": F.signum(value), "_cell": cell(value)})
    met = keyed.join(asked, [*group, "_sign", "_cell"]).drop("_sign", "_cell")
    return met.where(F.abs(F.col(score) - F.col(f"anchor_{score}")) <= F.abs(F.col(f"anchor_{score}")) * share)


def hamming_matches(rows: DataFrame, anchors: DataFrame, group: list[str], key: str, slots: str, most: int) -> DataFrame:
    """Rows of each anchor's group that differ from it in 1 to ``most`` slots, with that distance and the ``anchor_...`` columns.

    Slots are cut into ``most`` + 1 blocks; rows that differ in fewer slots share one block at least, so they meet on a
    block's content. Arrays of a group have one length.
    """
    blocks = most + 1
    block = lambda x, b: F.filter(x, lambda _, i: i % blocks == b)
    keys = lambda x: F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block(x, b).alias("part")) for b in range(blocks)])).alias("_block")
    asked = _anchored(anchors, group)
    asked = asked.select("*", keys(F.col(f"anchor_{slots}")))
    met = rows.select("*", keys(F.col(slots))).join(asked, [*group, "_block"])
    # of several common blocks the first counts
    a, b = F.col(slots), F.col(f"anchor_{slots}")
    first = F.array_min(F.array(*[F.when(block(a, i) == block(b, i), i) for i in range(blocks)]))
    near = met.where(F.col("_block.b") == first).drop("_block").withColumn("distance", hamming(a, b))
    return near.where(F.col("distance").between(1, most))


def _leaders(rows: DataFrame, group: list[str], key: str, score: str, others: list[str]) -> DataFrame:
    """The two best rows of each group, as one of them may be the anchor itself; the limit reaches below the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), key)
    return rows.select(*group, key, score, *others).withColumn("_rank", F.row_number().over(order)).where("_rank <= 2").drop("_rank")


def matched_roles(rows: DataFrame, anchors: DataFrame, group: list[str], key: str, slots: str, x: str, y: str, predicted: str, flagged: str, trained: str) -> DataFrame:
    """anchor, role, other, distance, mask: what each anchor is compared with, one row for each role that has any.

    logic_failure: the least ``x`` among rows within 5 % of the anchor's ``y``; growth_failure: the least ``y`` within
    20 % of its ``x``; near_miss: the largest ``x`` below 7/10 of its own in 1 or 2 other slots; interference: the
    largest ``predicted`` of the flagged rows, if it is above half its ``x``; top_in_training: the largest ``x`` of the
    trained rows. The first three leave flagged rows out, all leave out the anchor, ties go to the least key. mask has a
    1 for each slot that differs.
    """
    own = anchors.select(*group, key, slots, x, y)
    plain, other = rows.where(~F.col(flagged)), F.col(key) != F.col(f"anchor_{key}")
    best = lambda df, by: df.where(other).groupBy(F.col(f"anchor_{key}").alias("anchor"), F.col(f"anchor_{slots}").alias("_own")).agg(F.min(F.struct(by.alias("by"), F.col(key).alias("other"), F.col(slots).alias("slots"))).alias("m"))
    found = {
        "logic_failure": best(band_matches(plain, own, group, y, 0.05), F.col(x)),
        "growth_failure": best(band_matches(plain, own, group, x, 0.20), F.col(y)),
        "near_miss": best(hamming_matches(plain, own, group, key, slots, 2).where(F.col(x) * 10 < F.col(f"anchor_{x}") * 7), -F.col(x)),
        "interference": best(_leaders(rows.where(F.col(flagged)), group, key, predicted, [slots]).join(_anchored(own, group), group).where(F.col(predicted) * 2 > F.col(f"anchor_{x}")), -F.col(predicted)),
        "top_in_training": best(_leaders(rows.where(F.col(trained)), group, key, x, [slots]).join(_anchored(own, group), group), -F.col(x)),
    }
    out = None
    for role, df in found.items():
        differ = differing(F.col("m.slots"), F.col("_own"))
        part = df.select("anchor", F.lit(role).alias("role"), F.col("m.other").alias("other"), hamming(F.col("m.slots"), F.col("_own")).alias("distance"), F.array_join(F.transform(differ, lambda d: d.cast("int").cast("string")), "").alias("mask"))
        out = part if out is None else out.unionByName(part)
    return out
