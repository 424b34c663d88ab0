"""Expressions over truth tables: a number whose bit i is the output for the inputs that the bits of i state."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rows(inputs: int) -> Column:
    return F.sequence(F.lit(0), F.lit((1 << inputs) - 1))


def bit_text(table: Column, inputs: int) -> Column:
    """The outputs as a text, that of the last row first."""
    return F.lpad(F.bin(table), 1 << inputs, "0")


def depends_on(table: Column, k: int, inputs: int) -> Column:
    """Whether input ``k`` ever changes the output."""
    other = lambda i: F.when(F.getbit(i, F.lit(k)) == 1, i - (1 << k)).otherwise(i + (1 << k))
    return F.exists(_rows(inputs), lambda i: F.getbit(table, i) != F.getbit(table, other(i)))


def symmetric(table: Column, inputs: int) -> Column:
    """Whether the output depends on the number of inputs that are on alone."""
    first = {i.bit_count(): (1 << i.bit_count()) - 1 for i in range(1 << inputs)}
    model = F.array(*[F.lit(first[i.bit_count()]) for i in range(1 << inputs)])
    return F.forall(_rows(inputs), lambda i: F.getbit(table, i) == F.getbit(table, F.get(model, i)))


def input_maps(inputs: int) -> list[list[int]]:
    """For each order and negation of the inputs the row that each row reads."""
    rows = range(1 << inputs)
    moved = lambda i, order: sum((i >> k & 1) << order[k] for k in range(inputs))
    return [[moved(i, order) ^ flip for i in rows] for order in permutations(range(inputs)) for flip in rows]


def function_class(table: Column, inputs: int = 3) -> Column:
    """The least truth table that reordering inputs, negating inputs and negating the output can give."""
    maps = F.array(*[F.array(*[F.lit(r) for r in m]) for m in input_maps(inputs)])
    full = (1 << (1 << inputs)) - 1
    value = lambda m: F.aggregate(F.transform(m, lambda r, i: F.getbit(table, r).cast("int") * F.pow(F.lit(2), i).cast("int")), F.lit(0), lambda a, v: a + v)
    return F.array_min(F.transform(maps, lambda m: F.least(value(m), F.lit(full) - value(m))))
