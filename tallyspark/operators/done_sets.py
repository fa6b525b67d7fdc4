"""Resume from a done set instead of the results.

Ids that have a stored result are kept as bitmaps: bucket k covers 32,768 consecutive ids in 4 KB, whatever the results weigh.
Each result batch appends the bitmaps of its own ids (one aggregate, combined on the map side), bitmaps of a bucket merge by
or, and a repeated batch changes nothing. What is pending follows from the tasks and the bitmaps alone; the results are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col_
from ..sources.merged_table import MergedTable

SCHEMA = "bucket bigint, ok boolean, ids binary"
BITS = 8


def _merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", "ok").agg(F.bitmap_or_agg("ids").alias("ids"))


def done_set(spark: SparkSession, path: str) -> MergedTable:
    """The done set stored under ``path``: ``bucket, ok, ids``."""
    return MergedTable(spark, path, SCHEMA, _merge)


def ids_of(results: DataFrame, key: str = "task_id", ok: Column | None = None) -> DataFrame:
    """The ids of ``results`` as bitmaps; ``ok`` tells results that count when errors are run again (all, if not given). Null ids
    are left out."""
    return (results.filter(F.col(key).isNotNull())
            .groupBy(F.bitmap_bucket_number(key).alias("bucket"), (F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))).alias("ok"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("ids")))


def add_results(spark: SparkSession, path: str, results: DataFrame, batch_id: int, key: str = "task_id", ok: Column | None = None) -> None:
    """Note the ids of a result batch; the same batch again overwrites its own note."""
    done_set(spark, path).append(ids_of(results, key, ok), batch_id)


def has_id(ids: Column, key: Column | str) -> Column:
    """Whether a bucket's bitmap has the id."""
    at = F.bitmap_bit_position(col_(key))
    byte = F.conv(F.hex(F.substring(ids, (F.floor(at / BITS) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (at % BITS).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def pending(tasks: DataFrame, done: DataFrame, key: str = "task_id", retry_errors: bool = False) -> DataFrame:
    """J8 / J9 over a done set (``bucket, ok, ids``): rows of ``tasks`` whose id it lacks; with ``retry_errors`` an id counts only if one of
    its results was ok. Null ids are pending."""
    ids = (done.filter("ok") if retry_errors else done).groupBy("bucket").agg(F.bitmap_or_agg("ids").alias("_ids"))
    t = tasks.withColumn("_bucket", F.bitmap_bucket_number(key))
    return (t.join(ids.withColumnRenamed("bucket", "_bucket"), "_bucket", "left")
            .filter(~has_id(F.col("_ids"), key)).select(*tasks.columns))
