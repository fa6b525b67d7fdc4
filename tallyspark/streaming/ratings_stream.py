"""Incremental ratings as judgement chunks arrive (Structured Streaming).

Each micro-batch parses its judgements, reduces them to pairwise cells (G9,
at most arenas x M x M rows), adds them to the previous cumulative cells and
refits the Bradley-Terry ratings (G10). The cumulative cells are written as a
new version per batch id, so a retried batch recomputes from the previous
version and the state never grows with the number of battles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judgements as J
from ..operators import rating as R
from ..session import scratch_path

# what a batch shuffles are cells and ratings, arenas x M x M rows from a task at most; every part of them costs a task and a file in every step
CELL_PARTITIONS = 4
JUDGEMENT_SCHEMA = "battle_id bigint, model_a string, model_b string, raw string"


def run_incremental_ratings(spark: SparkSession, judgement_dir: str, files_per_trigger: int = 1,
                            out_dir: str | None = None, aspects: list[str] | None = None, keep: int = 2) -> str:
    """Run over the files now in ``judgement_dir``; returns the folder holding
    ``cells/v=<batch>`` and ``ratings/v=<batch>`` versions, of which the last ``keep`` stay."""
    out = out_dir or scratch_path(spark, "incremental-ratings")
    ckpt = scratch_path(spark, "ratings-stream-ckpt")
    src = (spark.readStream.schema(JUDGEMENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(judgement_dir))

    def step(batch: DataFrame, batch_id: int) -> None:
        battles = J.explode_battles(J.parse_judgements(batch))
        cells = J.pairwise_table(battles, aspects=aspects)
        prev = _latest_version(spark, f"{out}/cells", before=batch_id)
        if prev is not None:
            cells = (cells.unionByName(spark.read.parquet(prev))
                     .groupBy("arena", "i", "j").agg(F.sum("w").alias("w"), F.sum("n").alias("n")))
        cells = cells.select("arena", "i", "j", F.col("w").cast("bigint"), F.col("n").cast("bigint"))
        cells.write.mode("overwrite").parquet(f"{out}/cells/v={batch_id}")
        cum = spark.read.parquet(f"{out}/cells/v={batch_id}")
        R.fit_ratings(cum).write.mode("overwrite").parquet(f"{out}/ratings/v={batch_id}")
        for kind in ("cells", "ratings"):
            _drop_versions(spark, f"{out}/{kind}", batch_id - keep)

    parts = "spark.sql.shuffle.partitions"
    before = spark.conf.get(parts)
    spark.conf.set(parts, str(min(int(before), CELL_PARTITIONS)))
    try:
        q = (src.writeStream.foreachBatch(step).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
    finally:  # a query keeps the settings it was started with
        spark.conf.set(parts, before)
    q.awaitTermination()
    return out


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def _drop_versions(spark: SparkSession, path: str, last: int) -> None:
    """Delete versions up to ``last``: a retried batch only needs the one before it."""
    conf = spark._jsc.hadoopConfiguration()
    for v in _versions(spark, path):
        if v <= last:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")
            p.getFileSystem(conf).delete(p, True)


def _latest_version(spark: SparkSession, path: str, before: int | None = None) -> str | None:
    vs = [v for v in _versions(spark, path) if before is None or v < before]
    return f"{path}/v={vs[-1]}" if vs else None


def latest_ratings(spark: SparkSession, out_dir: str) -> DataFrame:
    p = _latest_version(spark, f"{out_dir}/ratings")
    if p is None:
        return spark.createDataFrame([], R.FIT_SCHEMA)
    return spark.read.parquet(p)


def latest_cells(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(_latest_version(spark, f"{out_dir}/cells"))
