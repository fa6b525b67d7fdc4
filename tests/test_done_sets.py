"""Done sets as bitmaps equal the anti-join over the results."""

import random

from pyspark.sql import functions as F

from tallyspark.operators import done_sets as DS
from tallyspark.operators import grids as G
from tallyspark.session import scratch_path


def ids(spark, values, name="task_id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_pending_equals_the_anti_join(spark):
    rng = random.Random(2)
    edge = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 65537, -1, -32768, 10**12, 10**12 + 1, None]
    tasks = ids(spark, sorted({rng.randrange(-70_000, 200_000) for _ in range(20_000)}) + [10**12, 10**12 + 1, 2**62])
    path = scratch_path(spark, "t-done")
    results = []
    for batch in range(6):
        rows = [(rng.choice(edge) if rng.random() < 0.2 else rng.randrange(-70_000, 200_000), rng.choice(["x", "y", "ERROR", None])) for _ in range(2500)]
        results += rows
        df = spark.createDataFrame(rows, "task_id long, code string")
        for _ in range(1 + (batch == 3)):  # a batch that is repeated
            DS.add_results(spark, path, df, batch, ok=F.col("code") != "ERROR")
        if batch in (1, 4):
            DS.done_set(spark, path).compact()
    done = DS.done_set(spark, path).current()
    assert done.groupBy("bucket", "ok").count().filter("count > 1").count() == 0
    all_results = spark.createDataFrame(results, "task_id long, code string")
    for retry in (False, True):
        want = G.pending(tasks, all_results.filter("task_id is not null"), retry_errors=retry)
        got = DS.pending(tasks, done, retry_errors=retry)
        assert sorted(r.task_id for r in got.collect()) == sorted(r.task_id for r in want.collect())
        assert got.columns == ["task_id"]


def test_a_repeated_batch_changes_nothing(spark):
    path = scratch_path(spark, "t-again")
    a, b = ids(spark, range(0, 1000, 3)), ids(spark, range(0, 1000, 5))
    DS.add_results(spark, path, a, 0)
    DS.add_results(spark, path, b, 1)
    before = sorted(map(tuple, DS.done_set(spark, path).current().collect()))
    DS.add_results(spark, path, b, 1)
    DS.done_set(spark, path).compact()
    DS.add_results(spark, path, a, 0)  # older than the compaction
    assert sorted(map(tuple, DS.done_set(spark, path).current().collect())) == before
    assert DS.done_set(spark, path).n_folders() == 1


def test_only_bitmaps_are_read(spark):
    path, results = scratch_path(spark, "t-plan"), scratch_path(spark, "t-results")
    spark.range(0, 50_000, 2).selectExpr("id task_id", "repeat('code', 50) code").write.parquet(results)
    DS.add_results(spark, path, spark.read.parquet(results), 0)
    plan = plan_of(DS.pending(spark.range(0, 60_000).withColumnRenamed("id", "task_id"), DS.done_set(spark, path).current()))
    assert "t-done" in path or path.split("/")[-1] in plan
    assert results.split("/")[-1] not in plan and "code" not in plan
    size = sum(len(r.ids) for r in DS.done_set(spark, path).current().collect())
    assert size <= 4096 * 3  # ids up to 0 have a bucket of their own


def test_empty_and_null(spark):
    path = scratch_path(spark, "t-empty")
    tasks = ids(spark, [1, 2, None])
    assert DS.pending(tasks, DS.done_set(spark, path).current()).count() == 3
    DS.add_results(spark, path, ids(spark, []), 0)
    DS.add_results(spark, path, ids(spark, [None, 2]), 1)
    assert sorted(DS.pending(tasks, DS.done_set(spark, path).current()).collect(), key=str) == sorted([(1,), (None,)], key=str)
