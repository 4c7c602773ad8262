"""The ingest queue as an append-only log of states, drained by a stream that ends when it has caught up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("pending", "processing", "done", "failed")


def latest(log: DataFrame) -> DataFrame:
    """id, seq, status, error, retries of each queued item: its last entry in log (id, seq, status, error); an entry that was written twice counts once."""
    once = log.groupBy("id", "seq").agg(F.max(F.struct("status", "error")).alias("e")).select("id", "seq", "e.status", "e.error")
    return once.groupBy("id").agg(F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status"), F.max_by("error", "seq").alias("error"), F.count_if(F.col("status") == "failed").alias("retries"))


def counts(state: DataFrame) -> DataFrame:
    """status and n for all four states, 0 where there is none."""
    spark = state.sparkSession
    every = spark.createDataFrame([(s,) for s in STATES], "status string")
    return every.join(state.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def retryable(state: DataFrame, most: int = 3) -> DataFrame:
    """Failed items that may be tried again."""
    return state.where((F.col("status") == "failed") & (F.col("retries") < most))


def pending(state: DataFrame) -> DataFrame:
    return state.where(F.col("status").isin("pending", "processing"))


def recent_failures(state: DataFrame, k: int = 5) -> DataFrame:
    """The k failed items that failed last (by seq, the order of the log), then those of the highest ids."""
    return state.where("status = 'failed'").orderBy(F.desc("seq"), F.desc("id")).limit(k)


def enqueued(items: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the item table, rows of the log): items (content, ...) as pending, numbered from first_id in order of content."""
    from ..tables import numbered

    rows = numbered(items, F.col("content"), start=first_id - 1)
    return rows, rows.select("id", F.lit(0).cast("long").alias("seq"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"))


def claimed(state: DataFrame, k: int = 1) -> DataFrame:
    """Log entries that take the k oldest pending items into work."""
    return _next(state.where("status = 'pending'").orderBy("id").limit(k), "processing")


def marked(state: DataFrame, results: DataFrame) -> DataFrame:
    """Log entries of results (id, error): done, its error cleared, or failed."""
    rows = state.select("id", "seq").join(results, "id")
    return rows.select("id", (F.col("seq") + 1).alias("seq"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error")


def reset(state: DataFrame, most: int = 3) -> DataFrame:
    """Log entries that make failed items of fewer than ``most`` retries pending again; their error stays to be read."""
    return _next(retryable(state, most), "pending")


def recovered(state: DataFrame) -> DataFrame:
    """Log entries that make items pending again which a worker that ended took and left."""
    return _next(state.where("status = 'processing'"), "pending")


def _next(state: DataFrame, status: str) -> DataFrame:
    return state.select("id", (F.col("seq") + 1).alias("seq"), F.lit(status).alias("status"), "error")


def drain(queue: DataFrame, work: Callable[[DataFrame], DataFrame], log_path: str, checkpoint: str):
    """Work off a stream of items (id, content) to its end; work returns (id, error), error null if all went well.

    What it returns is appended to the log, so a batch that is replayed after
    a failure adds entries for the same items and changes no state.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = work(df)
        rows = done.select("id", F.lit(number * 2 + 1).cast("long").alias("seq"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error")
        rows.write.mode("append").parquet(log_path)

    q = queue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
