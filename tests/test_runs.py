"""Incremental runs that are killed, streams that are restarted, and motif rates with empty cells."""

import pytest
from pyspark.sql import functions as F

from designlens.operators import incremental, motif
from designlens.streaming import counts


def scored(rows):
    return rows.select("k", (F.col("v") * 2).alias("score"))


def found(spark, path):
    return sorted((r.k, r.score, r.run) for r in incremental.results(spark, path, scored(spark.createDataFrame([], "k long, v long")).schema).collect())


def test_runs_compute_each_key_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = lambda ks: spark.createDataFrame([(k, 10 * k) for k in ks], "k long, v long").repartition(3)
    assert found(spark, path) == []
    assert incremental.score_pending(rows(range(4)), ["k"], scored, path, "a") == 4
    assert incremental.score_pending(rows(range(7)), ["k"], scored, path, "b/é") == 3
    assert incremental.score_pending(rows(range(9)), ["k"], scored, path, "a") == 0  # finished, whatever it is given
    assert found(spark, path) == [(k, 20 * k, "a" if k < 4 else "b/é") for k in range(7)]
    assert incremental.score_pending(rows(range(7)), ["k"], scored, path, "c") == 0


def test_a_killed_run_is_done_again(spark, tmp_path, monkeypatch):
    """Killed in the middle of its rows, then between its rows and its manifest; each time nothing of it is seen."""
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(k, 10 * k) for k in range(20)], "k long, v long").repartition(4)
    incremental.score_pending(rows.where("k < 5"), ["k"], scored, path, "a")

    def failing(df):
        return scored(df).withColumn("score", F.when(F.col("k") == 13, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("score")))

    with pytest.raises(Exception, match="killed"):
        incremental.score_pending(rows, ["k"], failing, path, "b")
    assert found(spark, path) == [(k, 20 * k, "a") for k in range(5)]
    with monkeypatch.context() as m:
        m.setattr(incremental, "write_manifest", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            incremental.score_pending(rows.where("k < 12"), ["k"], scored, path, "b")
    assert found(spark, path) == [(k, 20 * k, "a") for k in range(5)]
    assert incremental.score_pending(rows, ["k"], scored, path, "b") == 15
    assert found(spark, path) == [(k, 20 * k, "a" if k < 5 else "b") for k in range(20)]


def test_a_stream_equals_the_batch_after_a_restart_and_a_repeated_batch(spark, tmp_path):
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/counts", f"{tmp_path}/checkpoint"
    rows = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") % 3 == 0).alias("top"))
    tally = lambda df: df.groupBy("k").agg(F.count("*").alias("n"), F.count_if("top").alias("n_top"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    expected = lambda df: sorted(map(tuple, tally(df).collect()))
    now = lambda p=out: sorted(map(tuple, counts.merged(spark, p, ["k"]).select("k", "n", "n_top").collect()))
    rows.limit(200).repartition(3).write.parquet(source)
    failing = lambda df: tally(df).withColumn("n", F.when(F.col("k") == 3, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        counts.count_stream(stream(), failing, out, checkpoint).awaitTermination()
    counts.count_stream(stream(), tally, out, checkpoint).awaitTermination()
    assert now() == expected(spark.read.parquet(source))
    rows.where("k > 2").repartition(2).write.mode("append").parquet(source)
    counts.count_stream(stream(), tally, out, checkpoint).awaitTermination()
    assert now() == expected(spark.read.parquet(source))
    # the last batch comes once more, as after a failure between its counts and its commit
    last = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    before = now()
    again = spark.read.parquet(out).where(F.col("batch") == last).drop("batch")
    again = spark.createDataFrame(again.collect(), again.schema)
    counts.write_batch(lambda df: df, out)(again, last)
    assert now() == before
    counts.compact(spark, out, ["k"], f"{out}-once")
    assert now(f"{out}-once") == before


def test_rates_of_empty_tiers_and_missing_motifs(spark):
    sizes = spark.createDataFrame([("a", 4, 10, 0), ("b", 4, 30, 0), ("c", 5, 0, 5), ("d", 5, None, 15)], "g string, size int, n_top long, n_bot long")
    held = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", "y"), ("z", "w")], "g string, motif string")
    rates = motif.tier_rates(held, sizes, "g", ["size"], ["n_top", "n_bot"])
    rows = {(r.size, r.motif, r.tier): (r.n_graphs, r.n_with, r.n_designs, r.with_motif, r.rate, r.tier_graphs) for r in rates.collect()}
    assert len(rows) == 2 * 3 * 2
    assert rows[4, "x", "n_top"] == (2, 1, 40, 10, 0.25, 1) and rows[4, "x", "n_bot"] == (2, 1, 0, 0, None, 0)
    assert rows[5, "y", "n_bot"] == (2, 1, 20, 5, 0.25, 1) and rows[5, "x", "n_bot"] == (2, 0, 20, 0, 0.0, 0) and rows[4, "w", "n_top"][3] == 0
    pooled = {(r.motif, r.tier): r.rate for r in motif.tier_rates(held, sizes, "g", [], ["n_top", "n_bot"]).collect()}
    assert pooled["y", "n_top"] == 0.75 and pooled["y", "n_bot"] == 0.25
    odds = {r.motif: r.log_odds_t for r in motif.tail_odds(motif.tier_rates(held, sizes.withColumnsRenamed({"n_top": "up_t", "n_bot": "down_t"}), "g", [], ["up_t", "down_t"]), [], ["t"], "up", "down").collect()}
    assert odds == {"x": None, "y": pytest.approx(1.584963), "w": None}
