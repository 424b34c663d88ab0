"""Assignment spaces without enumeration: any place of a space gives its assignment.

An assignment puts parts of different families into slots. Places count the
choices of parts in mixed radix, families ascending, and the orders of the
chosen parts within each choice, so a space is dealt out evenly and a sample
costs what the sample holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplier of the hash that picks a place in each stratum of a sample.
SPREAD, WORD = 2654435761, 1 << 32


@dataclass
class Space:
    """Parts by family, families and parts ascending, and the number of slots."""

    families: list[list[int]]
    slots: int

    def ways(self) -> list[list[int]]:
        """ways[j][r]: choices of r parts of different families among families j and later."""
        out = [[1] + [0] * self.slots]
        for own in reversed(self.families):
            out.append([1] + [out[-1][r] + len(own) * out[-1][r - 1] for r in range(1, self.slots + 1)])
        return out[::-1]

    def size(self) -> int:
        return factorial(self.slots) * self.ways()[0][self.slots]


def library_space(library: DataFrame, part: str, family: Column, slots: int, most: int = 10_000) -> Space:
    """The space of a table of parts, at most ``most`` distinct ones (more raise an error); null parts and families take no part."""
    rows = library.select(family.alias("f"), F.col(part).alias("p")).where("f is not null and p is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a library of more than {most} parts")
    by_family: dict = {}
    for r in sorted(rows):
        by_family.setdefault(r.f, []).append(int(r.p))
    return Space(list(by_family.values()), slots)


def unranked(space: Space, places: np.ndarray) -> np.ndarray:
    """The assignments (rows) at ``places``."""
    k, n = space.slots, len(places)
    orders, rest = places % factorial(k), places // factorial(k)
    ways = np.array(space.ways(), np.int64)
    chosen, left = np.zeros((n, k), np.int64), np.full(n, k)
    for j, own in enumerate(space.families):
        after = np.where(left > 0, ways[j + 1][left - 1], 0)  # choices of the other parts once this family has one
        taken = rest < len(own) * after
        digit = rest[taken] // after[taken]
        chosen[taken, k - left[taken]] = np.array(own)[digit]
        rest = np.where(taken, rest, rest - len(own) * after)
        rest[taken] -= digit * after[taken]
        left = left - taken
    # the order's digits in factorial radix say which of the parts left comes next
    free, out = np.tile(np.arange(k), (n, 1)), np.zeros((n, k), np.int64)
    for i in range(k):
        digit = orders // factorial(k - 1 - i)
        orders = orders % factorial(k - 1 - i)
        at = free[np.arange(n), digit]
        out[:, i] = chosen[np.arange(n), at]
        keep = np.arange(free.shape[1]) != digit[:, None]
        free = free[keep].reshape(n, k - 1 - i)
    return out


def assignments(places: DataFrame, space: Space) -> DataFrame:
    """``places`` (place, bigint) with the slots of each."""
    if space.size() >= 1 << 63:
        raise ValueError("a space of more places than a long holds")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = unranked(space, batch.column("place").to_numpy())
                slots = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * space.slots, pa.array(rows.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("place"), slots], ["place", "slots"])

    return places.select("place").mapInArrow(run, "place bigint, slots array<int>")


def whole_space(spark: SparkSession, space: Space, partitions: int | None = None) -> DataFrame:
    """place, slots of every assignment, dealt evenly over ``partitions``."""
    return assignments(spark.range(0, space.size(), 1, partitions).select(F.col("id").alias("place")), space)


def sampled_space(spark: SparkSession, space: Space, rows: int, seed: int = 0) -> DataFrame:
    """place, slots of ``rows`` different assignments: one of each of as many even strata, the same in every run.

    A space of fewer places is given whole. At most 2^31 rows and places below 2^62.
    """
    size = space.size()
    if rows >= size:
        return whole_space(spark, space)
    start = F.expr(f"id * {size // rows}L + (id * {size % rows}L) div {rows}L")
    stop = F.expr(f"(id + 1) * {size // rows}L + ((id + 1) * {size % rows}L) div {rows}L")
    picked = start + F.expr(f"((id + {seed}L) * {SPREAD}L) % {WORD}L") % (stop - start)
    return assignments(spark.range(rows).select(picked.cast("bigint").alias("place")), space)
