"""S1 (stream): latest task status maintained by Structured Streaming.

The status log arrives as files. A streaming ``groupBy(task_id)`` keeps the
latest ``(seq, raw)`` per task in the RocksDB state store, on the executors'
disks: one row per task, kept as long as the query's checkpoint, because the
log has no event time and a finished task may still be polled (with times and limits: ``task_limits``). Each micro-batch's updated rows are appended to an update table in the
shared folder (``foreachBatch``, idempotent per batch id). The current view is
the latest update per task, decoded exactly as in batch (``status.client_view``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.status import client_view
from ..session import scratch_path

LOG_SCHEMA = "task_id bigint, seq bigint, raw string"


def run_latest_status_stream(spark: SparkSession, log_dir: str, out_dir: str | None = None,
                             files_per_trigger: int = 1, key: str = "task_id") -> str:
    """Run the stream over the files now in ``log_dir`` (availableNow); return the update table path."""
    out = out_dir or scratch_path(spark, "status-updates")
    ckpt = scratch_path(spark, "status-stream-ckpt")
    src = (spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(log_dir))
    latest = src.groupBy(key).agg(F.max("seq").alias("seq"), F.max_by("raw", "seq").alias("raw"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one directory per batch id: a retried batch overwrites its own output
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (latest.writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    finally:  # a query keeps the settings it was started with
        spark.conf.set(provider, before)
    q.awaitTermination()
    return out


def current_view(spark: SparkSession, updates_dir: str, key: str = "task_id") -> DataFrame:
    """Latest update per task, decoded: equals ``status.latest_status`` over the whole log."""
    u = spark.read.parquet(updates_dir)
    last = u.groupBy(key).agg(F.max_by("raw", "seq").alias("raw"))
    return client_view(last, key)
