"""Sinks: columnar datasets (A6), CER results (A10), rating snapshots and score
tables (A11), the battle chunk store (A12).

Everything is written under a caller path (on a cluster: the shared folder),
partitioned by a low-cardinality column so readers prune partitions. Nothing
is pickled and nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parts(rows: DataFrame, key: str, file_rows: int) -> int:
    """Files per key, so that the key with the most rows has at most ``file_rows`` rows in one."""
    largest = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-largest // file_rows))


def write_candidates(long: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long candidates ``task_id, system, code`` partitioned by system.

    Rows are dealt evenly, whatever their system, and the adaptive planner joins small parts and splits large ones by their bytes: a
    system that holds most rows is not written by one task, and neither are long codes.
    """
    long.hint("rebalance").write.mode(mode).partitionBy("system").parquet(path)


def read_candidates(spark: SparkSession, path: str, systems: list[str] | None = None) -> DataFrame:
    """Read back; a system filter prunes partitions (no other system's files are opened)."""
    df = spark.read.parquet(path)
    return df.filter(F.col("system").isin(*systems)) if systems else df


def write_cer_results(long: DataFrame, path: str, mode: str = "overwrite", file_rows: int = 5_000_000) -> None:
    """A10: long CER outcomes ``suite, item, system, variant, probe, ok`` partitioned by suite.

    Dealt by suite and a hash of the item, so a suite has as many files as its rows need, not one per task.
    """
    part = F.pmod(F.xxhash64("item"), F.lit(_parts(long, "suite", file_rows)))
    long.repartition("suite", part).write.mode(mode).partitionBy("suite").parquet(path)


def write_scores_csv(scores: DataFrame, path: str, partition: str = "arena", mode: str = "overwrite") -> None:
    """Score tables as CSV with a header, one folder per arena (aspect)."""
    scores.write.mode(mode).option("header", True).partitionBy(partition).csv(path)


def read_scores_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Re-read score CSVs with an explicit schema (no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_rating_snapshots(snapshots: DataFrame, path: str, mode: str = "append") -> None:
    """Per-chunk rating snapshots (``chunk_seq, system, rating``), appended."""
    snapshots.write.mode(mode).parquet(path)


def write_battle_chunks(battles: DataFrame, path: str, mode: str = "append") -> None:
    """Battles stored with their ``chunk_id``, range-clustered and sorted by it.

    Chunks are small (100 judgements), so one folder per chunk would mean
    millions of tiny files at scale; clustering instead gives parquet row
    groups tight ``chunk_id`` min/max statistics, so a chunk filter skips the
    rest. Chunks already stored are skipped by the resume anti-join (J9).
    """
    (battles.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
     .write.mode(mode).parquet(path))


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk ids holding at least one stored battle (empty chunks rerun)."""
    return spark.read.parquet(path).select("chunk_id").distinct()
