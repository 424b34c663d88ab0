"""Results that grow by runs: only keys without a result are computed, and a run counts once its manifest is written.

``path`` holds the rows of each run under its name, and after them the run's
manifest. Rows of a run without a manifest are never read; the run done again
writes over them. Two runs at a time need different keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from designlens.operators.expectations import pending
from designlens.shared import exists


def results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all finished runs: ``schema`` and run; none where nothing has run."""
    full = StructType([*schema.fields]).add("run", "string")
    if not exists(spark, f"{path}/manifest") or not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], full)
    finished = spark.read.schema("n bigint, run string").json(f"{path}/manifest").select("run").distinct()
    return spark.read.schema(full).parquet(f"{path}/rows").join(finished, "run", "left_semi").select(*full.names)


def write_manifest(spark: SparkSession, path: str, run: str, n: int) -> None:
    """Say that a run is finished, with the number of its rows."""
    one = spark.range(1).select(F.lit(run).alias("run"), F.lit(n).cast("bigint").alias("n"))
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(f"{path}/manifest")


def score_pending(todo: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame], path: str, run: str) -> int:
    """Compute the rows of ``todo`` whose keys have no result yet, as ``run``, and return how many results were written.

    ``compute`` gives one row for each row with that row's keys. A run that is already
    finished is left as it is. Null keys equal nothing and are computed in every run.
    """
    spark = todo.sparkSession
    schema = compute(todo.limit(0)).schema
    done = results(spark, path, schema)
    if done.where(F.col("run") == run).head(1):
        return 0
    rows = compute(pending(todo, done, keys)).withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/rows")
    n = spark.read.schema(StructType([*schema.fields]).add("run", "string")).parquet(f"{path}/rows").where(F.col("run") == run).count()
    write_manifest(spark, path, run, n)
    return n
