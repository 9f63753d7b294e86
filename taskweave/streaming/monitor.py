"""Monitoring and ingestion that work alike on batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 day"


def _watched(log: DataFrame, ts: str) -> DataFrame:
    return log.withWatermark(ts, LATE) if log.isStreaming else log


def stamp(window: Column) -> Column:
    return F.date_format(window["start"], "yyyy-MM-dd HH:mm:ss")


def class_mix(log: DataFrame, ts: str = "ts") -> DataFrame:
    """(start, cohort, label, n) in windows of a day."""
    return _watched(log, ts).groupBy(F.window(ts, "1 day").alias("w"), "cohort", "label").agg(F.count("*").alias("n")).select(stamp(F.col("w")).alias("start"), "cohort", "label", "n")


def review_rate(log: DataFrame, ts: str = "ts", review_at: float = 0.8, low_coverage: float = 0.2) -> DataFrame:
    """(start, n, review, low_coverage) in windows of six hours, a new one every hour."""
    return (
        _watched(log, ts)
        .groupBy(F.window(ts, "6 hours", "1 hour").alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("review_score") >= review_at).alias("review"), F.count_if(F.col("coverage") < low_coverage).alias("low_coverage"))
        .select(stamp(F.col("w")).alias("start"), "n", "review", "low_coverage")
    )


def mix_shift(log: DataFrame, shares: dict[str, float], ts: str = "ts", alert_at: float = 0.1) -> DataFrame:
    """(start, n, shift, alert): the largest change of a class's share against the reference shares."""
    counts = [F.count_if(F.col("label") == k).alias(f"n_{k}") for k in shares]
    out = _watched(log, ts).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n"), *counts)
    shift = F.round(F.greatest(*[F.abs(F.col(f"n_{k}") / F.col("n") - v) for k, v in shares.items()]), 6)
    return out.select(stamp(F.col("w")).alias("start"), "n", shift.alias("shift"), (shift >= alert_at).alias("alert"))


def quality_sample(log: DataFrame, key: str, high: float = 0.8, rate: int = 10) -> DataFrame:
    """Every row to be looked at with a chance of ``rate`` in 100, others with a tenth of it, by the MD5 of the key."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("quality|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % 1000
    is_high = F.col("review_score") >= high
    return log.where(F.when(is_high, draw < rate * 10).otherwise(draw < rate)).withColumn("stratum", F.when(is_high, "high").otherwise("low"))


def retry_latency(log: DataFrame, by: str, ts: str = "ts", exact: bool = True) -> DataFrame:
    """(start, by, calls, attempts, error_rate, p50, p95) in windows of a day. On streams, and where not ``exact``, quantiles come from mergeable sketches."""
    q = (lambda p: F.percentile("latency_ms", F.lit(p))) if exact and not log.isStreaming else (lambda p: F.percentile_approx("latency_ms", F.lit(p), F.lit(10000)))
    out = _watched(log, ts).groupBy(F.window(ts, "1 day").alias("w"), by)
    out = out.agg(F.count("*").alias("calls"), F.sum("attempt_count").alias("attempts"), F.round(F.avg((F.col("status") == "error").cast("int")), 6).alias("error_rate"), F.round(q(0.5), 6).alias("p50"), F.round(q(0.95), 6).alias("p95"))
    return out.select(stamp(F.col("w")).alias("start"), by, "calls", "attempts", "error_rate", "p50", "p95")


def first_success(rows: DataFrame, key: str = "call_id", ts: str = "ts") -> DataFrame:
    """Successful rows, of each call the first by time. On a stream the first to arrive stays, and repeats inside the watermark are dropped; ``ingest_into`` keeps state beyond it."""
    done = rows.where("status = 'success'")
    if done.isStreaming:
        return done.withWatermark(ts, LATE).dropDuplicatesWithinWatermark([key])
    return done.groupBy(key).agg(F.min_by(F.struct(*done.columns), F.struct(*[c for c in (ts, *sorted(set(done.columns) - {key, ts}))])).alias("_row")).select("_row.*")


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """A batch under its own name: written again, it replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def before_batch(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """What batches before this one have written below ``path``; None if there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    earlier = [f.getPath().toString() for f in (files.listStatus(place) if files.exists(place) else []) if f.getPath().getName().startswith("batch=") and int(f.getPath().getName()[6:]) < batch]
    return spark.read.option("basePath", path).parquet(*earlier) if earlier else None


def ingest_into(path: str, key: str = "call_id", ts: str = "ts"):
    """For ``foreachBatch``: the first success of each call that no earlier batch has. A replayed batch changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        first = first_success(batch, key, ts)
        seen = before_batch(batch.sparkSession, path, number)
        write_batch(first if seen is None else first.join(seen.select(key), key, "left_anti").select(first.columns), path, number)

    return run


def score_into(path: str, error: Column, score):
    """For ``foreachBatch``: valid rows as ``score`` (DataFrame -> DataFrame) has them below ``path/scored``, and the others with their error below ``path/rejects``. A replayed batch changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        valid, rejects = split_valid(batch, error)
        write_batch(score(valid), f"{path}/scored", number)
        write_batch(rejects, f"{path}/rejects", number)
        batch.unpersist()

    return run


def split_valid(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and rejects with it."""
    marked = rows.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")
