"""S1 (stream) with time limits: tasks that never end become errors, ended tasks leave the state.

The status log (``task_id, seq, raw, at``) arrives as files. ``transformWithState`` keeps the *open* tasks, dealt into shards: their
last entry's place and the time it runs out. A timer that the watermark passes turns a task into an error with the text of an exceeded
limit. An entry that ends a task (completed, error, failed) stays for the time limit too, so that an older entry that comes
after it does not open the task again; an older one that comes later still has run out itself. The state therefore holds the tasks of one
time limit, however long the log. Every change is appended to a :class:`~tallyspark.sources.merged_table.MergedTable`, which is compacted
whenever it has doubled.

Entries may come in any order and however late: the largest ``seq`` of a task counts. The watermark only decides when a timer
fires; no entry is dropped for being late, and one that comes after its task ran out replaces that error. Entries with null
task ids or times are left out of the state; a null time cannot run out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.listings import TIME_LIMIT
from ..operators.status import P_COMPLETED, P_ERROR, P_FAILED, client_view
from ..session import scratch_path
from ..sources.merged_table import MergedTable

LOG_SCHEMA = "task_id bigint, seq bigint, raw string, at timestamp"
UPDATES = "task_id bigint, seq bigint, timed_out boolean, raw string"
LIMIT_SECONDS = 600  # fixed value: the service's default limit of a run
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDS = (P_COMPLETED, P_ERROR, P_FAILED)
SHARDS = 256  # fixed value: a checkpoint's tasks are dealt by it
STATE_PARTITIONS = 64
NEVER = (1 << 63) - 1
KNOWN = {"task_id": "int64", "seq": "int64", "expiry": "int64", "open": "bool"}


def is_open(raw: str | None) -> bool:
    """Whether a stored status leaves its task open; no status at all means an unknown task, which has ended."""
    return bool(raw) and not raw.startswith(ENDS)


def _first(expiry: np.ndarray) -> int:
    return int(expiry.min()) if len(expiry) else NEVER


def _last_entries(entries: pd.DataFrame) -> pd.DataFrame:
    """The last entry of every task, of equal places the first that came."""
    task, seq = entries["task_id"].to_numpy(np.int64), entries["seq"].to_numpy(np.int64)
    order = np.lexsort((-np.arange(len(task)), seq, task))
    task = task[order]
    return entries.iloc[order[np.append(task[1:] != task[:-1], True)]]


class OpenTasks(StatefulProcessor):
    """Per shard of the tasks: each known task's ``seq``, whether it is open, and when it runs out or is forgotten (``NEVER``: not at all).

    The tasks of a shard are handled together, so a batch costs calls to the state by shards, not by tasks, and a shard has
    one timer, for whatever expires first.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getValueState("task", "task_id array<bigint>, seq array<bigint>, expiry array<bigint>, open array<boolean>")

    def _known(self) -> list[np.ndarray]:
        held = self.tasks.get()
        return [np.array(v, dtype=t) for v, t in zip(held or [()] * len(KNOWN), KNOWN.values())]

    def _keep(self, tasks: list[np.ndarray], timer: int) -> None:
        """Store the shard's tasks; ``timer`` is the one that is set (``NEVER``: none)."""
        if len(tasks[0]):
            self.tasks.update(tuple(v.tolist() for v in tasks))
        else:
            self.tasks.clear()
        first = _first(tasks[2])
        if first != timer:
            if timer != NEVER:
                self.handle.deleteTimer(timer)
            if first != NEVER:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            best = _last_entries(pdf if best is None else pd.concat([best, pdf], ignore_index=True))
        known = self._known()  # by task
        task, seq = best["task_id"].to_numpy(np.int64), best["seq"].to_numpy(np.int64)
        at = np.searchsorted(known[0], task)
        there = at < len(known[0])
        there[there] = known[0][at[there]] == task[there]
        newer = ~there
        newer[there] = known[1][at[there]] < seq[there]  # not older entries that came late
        if not newer.any():
            return
        best, task, seq = best[newer], task[newer], seq[newer]
        times = best["at_ms"].tolist()
        expiry = np.array([NEVER if pd.isna(t) else int(t) + self.limit_ms for t in times], np.int64)
        opened = np.array([is_open(None if pd.isna(r) else r) for r in best["raw"].tolist()], bool)
        held = np.ones(len(known[0]), bool)
        held[at[newer & there]] = False
        kept = opened | (expiry != NEVER)
        tasks = [np.concatenate([old[held], new[kept]]) for old, new in zip(known, (task, seq, expiry, opened))]
        order = np.argsort(tasks[0])
        self._keep([v[order] for v in tasks], _first(known[2]))
        yield pd.DataFrame({"task_id": task, "seq": seq, "timed_out": False, "raw": best["raw"].to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        gone = known[2] <= timerValues.getCurrentWatermarkInMs()
        self._keep([v[~gone] for v in known], NEVER)  # the timer that fired is gone by itself
        out = gone & known[3]
        if out.any():
            yield pd.DataFrame({"task_id": known[0][out], "seq": known[1][out], "timed_out": True, "raw": P_ERROR + TIME_LIMIT})

    def close(self) -> None:
        pass


def update_table(spark: SparkSession, path: str) -> MergedTable:
    """The last change per task: the largest ``seq``, and of one entry the time limit after the entry itself."""
    def last(updates: DataFrame) -> DataFrame:
        best = F.max_by(F.struct("seq", "timed_out", "raw"), F.struct("seq", "timed_out"))
        return updates.groupBy("task_id").agg(best.alias("u")).select("task_id", "u.*")

    return MergedTable(spark, path, UPDATES, last)


def run_task_stream(spark: SparkSession, log_dir: str, out_dir: str | None = None, checkpoint: str | None = None,
                    limit_seconds: int = LIMIT_SECONDS, delay: str = "10 minutes", files_per_trigger: int = 1,
                    compact_every: int = 10) -> tuple[str, str]:
    """Run over the files now in ``log_dir``; returns (update table, checkpoint). Called again with both, it goes on where it
    ended."""
    out = out_dir or scratch_path(spark, "task-updates")
    ckpt = checkpoint or scratch_path(spark, "task-stream-ckpt")
    table = update_table(spark, out)
    src = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(log_dir)
    # the time is carried as a number: rows with an event-time column would be dropped when late
    entries = (src.withWatermark("at", delay).filter(F.col("task_id").isNotNull() & F.col("seq").isNotNull())
               .select(F.pmod(F.xxhash64("task_id"), F.lit(SHARDS)).alias("shard"), "task_id", "seq", "raw", F.unix_millis("at").alias("at_ms")))
    changes = entries.groupBy("shard").transformWithStateInPandas(
        OpenTasks(limit_seconds * 1000), UPDATES, "Update", "EventTime")

    def sink(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, batch_id)
        batches, odd = divmod(batch_id + 1, compact_every)
        if not odd and not batches & (batches - 1):  # each time the table has doubled: all compactions together rewrite it a few times
            table.compact()

    provider = "spark.sql.streaming.stateStore.providerClass"
    before, partitions = spark.conf.get(provider, None), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(provider, ROCKSDB)
    # every batch opens and commits a store per partition, however few rows it has
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(partitions), STATE_PARTITIONS)))
    try:
        q = (changes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
    finally:  # a query keeps the settings it was started with
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    q.awaitTermination()
    return out, ckpt


def current_view(spark: SparkSession, updates_dir: str) -> DataFrame:
    """The client's view of every task after its last change."""
    return client_view(update_table(spark, updates_dir).current(), "task_id")


def open_tasks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``task_id, seq, expiry`` of the open tasks in the stream's state."""
    state = spark.read.format("statestore").option("stateVarName", "task").load(checkpoint)
    tasks = state.select(F.inline(F.arrays_zip(*[F.col(f"value.{c}").alias(c) for c in KNOWN])))
    return tasks.filter("open").select("task_id", "seq", F.nullif("expiry", F.lit(NEVER)).alias("expiry"))


def latest_with_limit(log: DataFrame, limit_seconds: int = LIMIT_SECONDS, delay_seconds: int = 600) -> DataFrame:
    """The same view in batch, at the time up to which the log is complete: its newest entry's, less ``delay_seconds``."""
    log = log.filter(F.col("task_id").isNotNull() & F.col("seq").isNotNull())
    now = log.agg(F.max(F.unix_millis("at")) - delay_seconds * 1000).scalar()
    last = log.groupBy("task_id").agg(F.max_by(F.struct("raw", F.unix_millis("at").alias("at")), "seq").alias("e"))
    raw = F.col("e.raw")
    ended = F.coalesce(raw == "", F.lit(True))
    for p in ENDS:
        ended = ended | raw.startswith(p)
    late = ~ended & (F.col("e.at") + limit_seconds * 1000 <= now)
    return client_view(last.select("task_id", F.when(late, P_ERROR + TIME_LIMIT).otherwise(raw).alias("raw")), "task_id")
