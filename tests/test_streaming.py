"""Streaming forms equal their batch forms."""


from pyspark.sql import functions as F

from tallyspark.operators import judgements as J
from tallyspark.operators import rating as R
from tallyspark.operators import status as STS
from tallyspark.plans import fixtures as fx
from tallyspark.session import scratch_path
from tallyspark.streaming import ratings_stream as RS
from tallyspark.streaming import status_stream as SS
from tallyspark.streaming import task_limits as TL

SF = "/root/testdata/sf0.001"


def test_status_stream_equals_batch(spark):
    log = fx.status_log(spark, SF)
    d = scratch_path(spark, "t-status")
    log.repartitionByRange(3, "seq").write.parquet(d)
    stream = SS.current_view(spark, SS.run_latest_status_stream(spark, d))
    batch = STS.latest_status(log)
    cols = ["task_id", "status", "code", "error"]
    assert sorted(stream.select(cols).collect()) == sorted(batch.select(cols).collect())


def test_incremental_ratings_equal_batch_fit(spark):
    j = fx.judgements(spark, SF)
    d = scratch_path(spark, "t-judge")
    j.repartitionByRange(3, "battle_id").write.parquet(d)
    out = RS.run_incremental_ratings(spark, d)
    inc = {(r.arena, r.system): r.rating for r in RS.latest_ratings(spark, out).collect()}
    batch = {(r.arena, r.system): r.rating
             for r in R.fit_ratings(J.pairwise_table(J.explode_battles(J.parse_judgements(j)))).collect()}
    assert inc.keys() == batch.keys()
    for k in inc:
        assert (inc[k] is None and batch[k] is None) or abs(inc[k] - batch[k]) < 1e-6


COLUMNS = ["task_id", "status", "code", "error"]


def entries(spark, rows):
    return spark.createDataFrame(rows, "task_id long, seq long, raw string, minute int").select(
        "task_id", "seq", "raw", F.expr("timestamp_seconds(1700000000 + minute * 60)").alias("at"))


def view(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_tasks_that_never_end_leave_the_state(spark):
    """Files one by one: ended, run out, still open, reopened, late and out of order; then a restart with more of the log."""
    files = [[(1, 1, "processing: a", 0), (2, 2, "processing: b", 0), (3, 3, "processing: c", 0), (6, 1, None, 0), (7, 1, "odd", 0)],
             [(1, 4, 'completed:{"0x1": "int f"}', 5), (4, 5, "processing: d", 14), (2, 6, "processing: again", 8)],
             [(3, 7, "failed:late", 40), (5, 8, "processing: e", 39), (1, 2, "processing: older", 1)]]
    d = scratch_path(spark, "t-limits")
    for f in files:
        entries(spark, f).coalesce(1).write.mode("append").parquet(d)
    out, ckpt = TL.run_task_stream(spark, d, limit_seconds=600, delay="60 seconds", compact_every=2)
    log = entries(spark, [r for f in files for r in f])
    expected = [(1, "completed", "int f", None), (2, "error", None, "Exceeded time limit"), (3, "error", None, "late"),
                (4, "error", None, "Exceeded time limit"), (5, "processing", None, None), (6, "error", None, "Task not found"),
                (7, "error", None, "Exceeded time limit")]
    assert view(TL.current_view(spark, out)) == expected == view(TL.latest_with_limit(log, 600, 60))
    assert [r.task_id for r in TL.open_tasks(spark, ckpt).collect()] == [5]
    more = [(4, 9, 'completed:{"0x2": "int g"}', 50), (8, 10, "processing: h", 55), (9, 11, "processing: i", 60)]
    entries(spark, more).coalesce(1).write.mode("append").parquet(d)
    assert TL.run_task_stream(spark, d, out, ckpt, limit_seconds=600, delay="60 seconds", compact_every=2) == (out, ckpt)
    log = entries(spark, [r for f in files for r in f] + more)
    now = view(TL.current_view(spark, out))
    assert now == view(TL.latest_with_limit(log, 600, 60))
    assert (4, "completed", "int g", None) in now and (5, "error", None, "Exceeded time limit") in now
    assert sorted(r.task_id for r in TL.open_tasks(spark, ckpt).collect()) == [8, 9]


def test_state_holds_open_tasks_only(spark):
    rows = [(k, 2 * k, "processing: x", k // 10) for k in range(400)] + \
           [(k, 2 * k + 1, "completed:{}", k // 10 + 1) for k in range(400) if k % 7]
    d = scratch_path(spark, "t-open")
    entries(spark, rows).repartitionByRange(4, "at").write.parquet(d)
    out, ckpt = TL.run_task_stream(spark, d, limit_seconds=900, delay="0 seconds", compact_every=3)
    log = entries(spark, rows)
    assert view(TL.current_view(spark, out)) == view(TL.latest_with_limit(log, 900, 0))
    open_now = {r.task_id for r in TL.open_tasks(spark, ckpt).collect()}
    assert open_now == {r[0] for r in view(TL.current_view(spark, out)) if r[1] == "processing"} and 0 < len(open_now) < 40


def test_update_table_survives_lost_compactions(spark):
    path = scratch_path(spark, "t-table")
    t = TL.update_table(spark, path)
    assert t.current().count() == 0
    t.compact()

    def batch(rows):
        return spark.createDataFrame(rows, TL.UPDATES)

    t.append(batch([(1, 1, False, "a"), (2, 1, False, "b")]), 0)
    t.append(batch([(1, 2, False, "c")]), 1)
    batch([(9, 9, False, "lost")]).write.parquet(f"{path}/upto=1")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/upto=1/_SUCCESS")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)  # a compaction that did not end
    rows = [(1, 2, False, "c"), (2, 1, False, "b")]
    assert sorted(tuple(r) for r in t.current().collect()) == rows
    t.compact()
    assert t.n_folders() == 1 and sorted(tuple(r) for r in t.current().collect()) == rows
    t.append(batch([(1, 99, False, "repeated")]), 1)  # a batch that was merged already
    t.append(batch([(2, 1, True, "timeout")]), 2)
    t.append(batch([(2, 1, True, "timeout")]), 2)
    assert t.n_folders() == 2
    assert sorted(tuple(r) for r in t.current().collect()) == [(1, 2, False, "c"), (2, 1, True, "timeout")]


def test_shards_hold_ended_tasks_for_the_limit_only(spark):
    """Entries before and after the one that ended their task, null times, equal places; many tasks of a shard in one batch."""
    n = 3 * TL.SHARDS
    files = [[(k, 10, "completed:{}", 5) for k in range(n)] + [(-1, 1, "processing: never", None), (-2, 3, "processing: a", 4)],
             [(k, 9, "processing: older", 4) for k in range(n)] + [(-2, 4, "processing: b", 6), (-2, 2, "failed:older", 6), (-3, 1, "error:c", None)],
             [(-4, 1, "processing: d", 30)]]
    d = scratch_path(spark, "t-shards")
    out = ckpt = None
    for f in files:
        entries(spark, f).coalesce(1).write.mode("append").parquet(d)
        out, ckpt = TL.run_task_stream(spark, d, out, ckpt, limit_seconds=900, delay="0 seconds")
        if f is files[1]:
            assert sorted(tuple(r) for r in TL.open_tasks(spark, ckpt).select("task_id", "seq").collect()) == [(-2, 4), (-1, 1)]
    log = entries(spark, [r for f in files for r in f])
    assert view(TL.current_view(spark, out)) == view(TL.latest_with_limit(log, 900, 0))
    left = spark.read.format("statestore").option("stateVarName", "task").load(ckpt).select(F.explode("value.task_id").alias("t"))
    assert sorted(r.t for r in left.collect()) == [-4, -1]
    assert {r.task_id: r.expiry for r in TL.open_tasks(spark, ckpt).collect()}[-1] is None


def test_ratings_versions_have_few_files_whatever_the_session_partitions(spark):
    rows = [(k, f"s{k % 3}", f"s{(k + 1) % 3}", '```json\n{"R": {"asp%d": {"winner": "%s"}}}\n```' % (k % 12, "AB"[k // 36 % 2])) for k in range(216)]
    d = scratch_path(spark, "t-parts")
    spark.createDataFrame(rows, RS.JUDGEMENT_SCHEMA).coalesce(2).write.parquet(d)
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "40")
    try:
        out = RS.run_incremental_ratings(spark, d)
        assert spark.conf.get(name) == "40"
    finally:
        spark.conf.set(name, before)
    assert RS.latest_ratings(spark, out).count() == 12 * 2 + 3 and RS.latest_cells(spark, out).agg(F.sum("n")).first()[0] == 4 * 216
    for df in (RS.latest_ratings(spark, out), RS.latest_cells(spark, out)):
        assert len(df.inputFiles()) <= RS.CELL_PARTITIONS
