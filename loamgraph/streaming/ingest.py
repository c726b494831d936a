"""Continuous ingestion: an inbox as a file stream, status, retries, and usage by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upsert

RETRIES = 3


def inbox(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", clean: bool = False, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder; with `clean` a file is deleted once its batch is committed."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return (reader.option("cleanSource", "delete") if clean else reader).format(fmt).load(folder)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, wait: bool = True) -> StreamingQuery:
    """Every waiting file in batches, then stops. `work` must give the same state when a batch comes again."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query


def ingest_into(target: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch's transformed rows under its own folder, so a repeated batch overwrites itself."""

    def work(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return work


def next_status(status: DataFrame, results: DataFrame, now) -> DataFrame:
    """doc_status after a run: results (doc_id, ok, error_message, chunks_count); a repeated document's version rises."""
    old = status.select("doc_id", F.col("version").alias("old"), F.col("created_at").alias("born"))
    rows = results.join(old, "doc_id", "left").select("doc_id", F.when(F.col("ok"), "completed").otherwise("failed").alias("status"), "error_message", "chunks_count", F.coalesce("born", now).alias("created_at"), now.alias("updated_at"), (F.coalesce("old", F.lit(0)) + 1).alias("version"))
    return upsert(status, rows, ["doc_id"])


def enqueue(status: DataFrame, docs: DataFrame, now) -> DataFrame:
    """doc_status with a pending row for each new document (doc_id); those that it has already stay as they are."""
    new = docs.select("doc_id").distinct().join(status.select("doc_id"), "doc_id", "left_anti")
    return status.unionByName(new.select("doc_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(0).cast("long").alias("chunks_count"), now.alias("created_at"), now.alias("updated_at"), F.lit(0).alias("version")))


def pending(status: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents that wait: pending ones and ones that failed."""
    return docs.join(status.where(F.col("status").isin("pending", "failed")).select("doc_id"), "doc_id", "left_semi")


def reingest(status: DataFrame, docs: DataFrame, now) -> DataFrame:
    """doc_status with the given documents pending again. next_status() raises the version when they are done."""
    again = status.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumns({"status": F.lit("pending"), "error_message": F.lit(None).cast("string"), "updated_at": now})
    return upsert(status, again.select(*status.columns), ["doc_id"])


def take_jobs(jobs: DataFrame, n: int, now) -> DataFrame:
    """The n waiting jobs that are due, lowest priority number first, then oldest."""
    return jobs.where((F.col("status") == "waiting") & (F.col("due_at") <= now)).orderBy("priority", "queued_at", "task_id").limit(n)


def settle_jobs(jobs: DataFrame, results: DataFrame, now, base_seconds: float = 2.0, retries: int = RETRIES) -> DataFrame:
    """jobs after results (task_id, ok): done, or due again after base * 2^(n-1) seconds, or dead after `retries` failures."""
    rows = jobs.join(results.select("task_id", "ok"), "task_id", "left")
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    n = F.col("retries") + failed.cast("int")
    status = F.when(F.col("ok"), "done").when(failed & (n >= retries), "dead").when(failed, "waiting").otherwise(F.col("status"))
    wait = F.make_interval(secs=(base_seconds * F.pow(F.lit(2.0), n - 1)).cast("decimal(18,6)"))
    due = F.when(failed & (n < retries), now + wait).otherwise(F.col("due_at"))
    return rows.select("task_id", "payload", "priority", n.alias("retries"), status.alias("status"), "queued_at", due.alias("due_at"))


def usage_by_day(events: DataFrame, late: str = "1 hour", ts: str = "ts", by: str = "user_id", tokens: str = "tokens") -> DataFrame:
    """by, day, tokens over a stream or a table. Timestamps are event times in UTC; rows later than `late` are dropped from streams."""
    rows = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.col(by), F.window("_t", "1 day").alias("w")).agg(F.sum(tokens).alias("tokens")).select(by, F.col("w.start").cast("date").alias("day"), "tokens")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", by: str = "user_id") -> DataFrame:
    """by, start, end, n of runs of events with no longer pause than `gap`."""
    rows = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.col(by), F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
