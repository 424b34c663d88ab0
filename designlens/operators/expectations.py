"""Checks that tables must pass, as counts of violations, and writing that refuses what fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest integer that a double holds exactly with all smaller ones.
EXACT = (1 << 53) - 2


class ExpectationError(ValueError):
    """Named rules that a table violates, with the number of rows."""


def report(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: rows for which a condition (rule -> what holds) is false or unknown. One pass over the table."""
    counted = table.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.*")


def require(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``table``, if no rule is violated; raises before anything is counted otherwise. Only the report reaches the driver."""
    bad = [(r.rule, r.violations) for r in report(table, rules).where("violations > 0").collect()]
    if bad:
        raise ExpectationError(", ".join(f"{name}: {n} rows" for name, n in bad))
    return table


def count_rules(parts: list[str], exposures: list[str]) -> dict[str, Column]:
    """Rules of part counts and of the exposures that they belong to, pair by pair."""
    rules: dict[str, Column] = {}
    for part, n in zip(parts, exposures):
        whole = lambda c: (F.col(c) >= 0) & (F.col(c) <= EXACT) & (F.col(c) == F.floor(c))
        rules |= {f"{part}_is_count": whole(part), f"{n}_is_count": whole(n), f"{n}_positive": F.col(n) > 0, f"{part}_within_{n}": F.col(part) <= F.col(n)}
    return rules


def design_rules(slots: str, scores: list[str], parts: int, families: int, size: Column) -> dict[str, Column]:
    """Rules of designs: parts of the library, as many slots as stated, no family twice, finite scores."""
    own = F.col(slots)
    return {
        "part_in_library": F.forall(own, lambda p: p.between(1, parts)),
        "slot_count": F.size(own) == size,
        "family_once": F.size(F.array_distinct(F.transform(own, lambda p: p % families))) == F.size(own),
    } | {f"{s}_finite": F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double")) & (F.abs(F.col(s).cast("double")) != float("inf")) for s in scores}


def grid_report(table: DataFrame, rows: list[str], columns: DataFrame, required: list[str]) -> DataFrame:
    """n_rows, n_cells, missing, repeated of a table that must hold each of its ``rows`` keys with each of ``columns`` once."""
    lacking = [c for c in required if c not in table.columns]
    if lacking:
        raise ExpectationError(f"missing columns: {', '.join(lacking)}")
    keys = [*rows, *columns.columns]
    cells = table.select(*rows).distinct().crossJoin(columns)
    n = table.groupBy(*keys).agg(F.count("*").alias("n"))
    met = cells.join(n, keys, "left")
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_cells"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"))


def derived_report(table: DataFrame, expected: dict[str, Column], tolerance: float) -> DataFrame:
    """rule, violations: rows whose column is further than ``tolerance`` from what is computed anew."""
    return report(table, {c: F.abs(F.col(c) - e) <= tolerance for c, e in expected.items()})


def write_complete(table: DataFrame, keys: DataFrame, path: str) -> None:
    """Write ``table`` only if it has every key of ``keys``; nothing is written otherwise."""
    missing = keys.join(table, keys.columns, "left_anti").count()
    if missing:
        raise ExpectationError(f"{missing} keys are missing, nothing was written")
    table.write.parquet(path)


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``todo`` whose keys are not done yet."""
    return todo.join(done.select(*keys), keys, "left_anti")


def flagged(rows: DataFrame, known: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with whether their keys are among ``known``."""
    return rows.join(known.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Shards of one table; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of the one row of ``right`` with its keys; the job fails on keys that ``right`` repeats or lacks.

    The failing tests are part of the plan: nothing is counted beforehand.
    """
    others = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others])
    met = left.join(once, keys, "left")
    problem = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.to_json(F.struct(*keys))))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated rows for "), F.to_json(F.struct(*keys)))))
    return met.where(problem.cast("string").isNull()).drop("_n")
