"""Places of rows within their groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from designlens.shared import materialize

#: Rows of one task in ``monotonically_increasing_id`` are numbered below this many bits.
TASK_BITS = 33


def placed(rows: DataFrame, group: str, ranges: list[str | Column], order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with place (0 for the first row of its ``group``, in ``order``) and total (rows of the group).

    ``group`` holds no nulls. Rows are dealt by ranges of ``group`` and ``ranges``, a prefix of what ``order``
    compares, so a group of any size lies in consecutive tasks; only the row counts of each task's groups are
    summed up. Writes the sorted rows once, and runs jobs while the plan is built.
    """
    dealt = rows.repartitionByRange(F.col(group), *ranges).sortWithinPartitions(F.col(group), *order)
    sorted_rows = materialize(dealt.withColumn("_row", F.monotonically_increasing_id()), name)
    task = F.shiftright("_row", TASK_BITS)
    runs = sorted_rows.groupBy(group, task.alias("_task")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        group, "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("total")
    )
    return sorted_rows.withColumn("_task", task).join(runs, [group, "_task"]).withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_task", "_shift")
