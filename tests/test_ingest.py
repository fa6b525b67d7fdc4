"""File scans on small files written by the test (own content)."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import code_text as CT
from tallyspark.operators import status as STS
from tallyspark.sources import ingest as I


def test_function_files_and_probe_discovery(spark, tmp_path):
    (tmp_path / "fn" / "suiteA").mkdir(parents=True)
    (tmp_path / "fn" / "cpython3").mkdir(parents=True)
    (tmp_path / "fn" / "suiteA" / "foo.c").write_bytes(b"int foo(void) { return '\xff'; }")
    (tmp_path / "fn" / "suiteA" / "notes.txt").write_text("x")
    (tmp_path / "fn" / "cpython3" / "bar.c").write_text("int bar;")
    got = I.read_function_files(spark, str(tmp_path / "fn")).collect()
    assert [(r.suite, r.item) for r in got] == [("suiteA", "foo")]
    assert got[0].source == "int foo(void) { return '�'; }"

    out = tmp_path / "out"
    out.mkdir()
    (out / "fuzz_a").write_bytes(b"\x7fELF\x02\x01rest")
    (out / "fuzz_a_patched").write_bytes(b"\x7fELFxx")
    (out / "llvm-symbolizer").write_bytes(b"\x7fELFxx")
    (out / "script.sh").write_bytes(b"#!/bin/sh")
    probes = sorted(r.probe for r in I.discover_probes(spark, str(out)).collect())
    assert probes == ["fuzz_a"]


def lines(*rows):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows)


def test_headered_jsonl_by_place_in_the_file(spark, tmp_path):
    d = tmp_path / "res"
    d.mkdir()
    (d / "m1.jsonl").write_text(lines({"model": "alpha"}, {"idx": 1, "code": "old"}, "{broken", {"note": "no idx"}, "3",
                                      {"idx": 1, "code": "new"}, {"idx": 2, "code": "ERROR"}, {"idx": 3}))
    (d / "m2.jsonl").write_text(lines({"model": "beta"}, {"idx": 0, "code": "x"}, {"idx": 0, "code": "y"}, {"model": "beta"},
                                      {"idx": 1, "code": "z"}))
    (d / "angr.jsonl").write_text(lines({"idx": 0, "code": "c"}))
    got = sorted((r.system, r.task_id, r.code) for r in I.read_headered_jsonl(spark, str(d), n_tasks=5).collect())
    assert got == [("alpha", 1, "new"), ("alpha", 2, "ERROR"), ("alpha", 3, None), ("angr", 0, "c"), ("beta", 0, "y"),
                   ("beta", 1, "z")]


def test_headered_jsonl_in_splits(spark, tmp_path):
    d = tmp_path / "big"
    d.mkdir()
    rows = [{"idx": k % 500, "code": f"c{k}" + "x" * 50} for k in range(20_000)]
    (d / "m.jsonl").write_text(lines({"model": "alpha"}, *rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = I.read_headered_jsonl(spark, str(d))
        got = {r.task_id: r.code for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: f"c{19_500 + k}" + "x" * 50 for k in range(500)}


def test_headered_jsonl_headers_of_a_file_must_agree(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(lines({"model": "alpha"}, {"idx": 0, "code": "a"}, {"model": "beta"}))
    with pytest.raises(Exception, match="Multiple model names"):
        I.read_headered_jsonl(spark, str(tmp_path)).collect()


def test_headered_jsonl_explicit_order(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(lines({"idx": 0, "code": "late", "seq": 9}, {"idx": 0, "code": "early", "seq": 1}))
    assert [r.code for r in I.read_headered_jsonl(spark, str(tmp_path), order="seq").collect()] == ["late"]
    assert [r.code for r in I.read_headered_jsonl(spark, str(tmp_path)).collect()] == ["early"]


def test_headered_jsonl_out_of_range_fails(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(lines({"idx": 9, "code": "x"}))
    with pytest.raises(Exception, match="out of range"):
        I.read_headered_jsonl(spark, str(tmp_path), n_tasks=3).collect()


def test_result_sink_spreads_one_large_system(spark, tmp_path):
    rows = [(k, "big" if k % 5 else "small", k % 700, f"c{k}") for k in range(5000)]
    df = spark.createDataFrame(rows, "seq long, system string, task_id long, code string")
    I.write_headered_jsonl(df, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("system=big/part=*/*.txt"))
    assert len(files) == 8 and all(json.loads(f.open().readline()) == {"model": "big"} for f in files)
    got = {(r.system, r.task_id): r.code for r in I.read_headered_jsonl(spark, str(tmp_path / "out")).collect()}
    exp = {}
    for _, s, t, c in rows:
        exp[s, t] = c
    assert got == exp


def test_result_sink_has_more_files_for_more_rows(spark, tmp_path):
    df = spark.range(5000).selectExpr("id seq", "'big' system", "id % 700 task_id", "concat('c', id) code")
    I.write_headered_jsonl(df, str(tmp_path / "out"), file_rows=200)
    assert len(list((tmp_path / "out").glob("system=big/part=*/*.txt"))) == 25
    got = {r.task_id: r.code for r in I.read_headered_jsonl(spark, str(tmp_path / "out")).collect()}
    assert got == {k % 700: f"c{k}" for k in range(5000)}


def test_task_queue_results(spark, tmp_path):
    q = [
        {"uuid": "1", "status": "completed", "metadata": {"idx": 0, "decompiler": "angr"}, "decompiler": "angr",
         "result": {"0x10": "int f", "0x20": "int g"}},
        {"uuid": "2", "status": "completed", "metadata": {"idx": 0, "decompiler": "angr"}, "decompiler": "angr",
         "result": {"0x10": "int f2"}},
        {"uuid": "3", "status": "error", "metadata": {"idx": 1, "decompiler": "angr"}, "decompiler": "angr",
         "error": "boom"},
        {"uuid": "4", "status": "completed", "metadata": {"idx": 1, "decompiler": "ghidra"}, "decompiler": "ghidra",
         "result": {}},
    ]
    p = tmp_path / "queue.json"
    p.write_text(json.dumps(q))
    wide = I.queue_results(I.read_task_queue(spark, str(p)), ["angr", "ghidra"]).collect()
    assert [(r.task_id, r.angr, r.ghidra) for r in wide] == [(0, "int f2", None)]


def test_decode_status_cut_option(spark):
    df = spark.createDataFrame([("error: broker down",), ("completed: {}",), ("failed:x",), (None,), ("weird",)],
                               "raw string")
    fixed = [tuple(r[0]) for r in df.select(STS.decode_status("raw")).collect()]
    ref = [tuple(r[0]) for r in df.select(STS.decode_status("raw", reference_cut=True)).collect()]
    assert fixed[0] == ("error", "broker down") and ref[0] == ("error", "ker down")
    assert fixed[1] == ref[1] == ("completed", "{}")
    assert fixed[2] == ("error", "x") and fixed[3] == ("completed", "Task not found") and fixed[4] == (None, None)


def test_splitlines_and_template(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc\n",), ("",), ("x",)], "t string")
    assert [r[0] for r in df.select(CT.py_splitlines("t")).collect()] == [["a", "b", "c"], [], ["x"]]
    one = spark.createDataFrame([("{code}",)], "v string")
    out = one.select(CT.render_template("<{a}> {{literal}} [{a}]", {"a": F.col("v")})).first()[0]
    assert out == "<{code}> {literal} [{code}]"


def test_jsonl_sink_roundtrip(spark, tmp_path):
    rows = [("angr", 0, "a0", 1), ("angr", 0, "a0-new", 5), ("angr", 1, "ERROR", 2), ("ghidra", 3, "g3", 1)]
    df = spark.createDataFrame(rows, "system string, task_id long, code string, seq long")
    path = str(tmp_path / "sink")
    I.write_headered_jsonl(df, path)
    back = sorted((r.system, r.task_id, r.code) for r in I.read_headered_jsonl(spark, path).collect())
    assert back == [("angr", 0, "a0-new"), ("angr", 1, "ERROR"), ("ghidra", 3, "g3")]


def test_range_slice_arguments(spark):
    from tallyspark.operators import grids as G
    df = spark.range(10).withColumnRenamed("id", "task_id")
    assert [r.task_id for r in G.range_slice(df, 2, 4, 10).collect()] == [8, 9]
    for args in [(-1, 4, 10), (0, 0, 10), (3, 4, 10)]:
        with pytest.raises(ValueError):
            G.range_slice(df, *args)


def test_candidates_of_one_large_system_are_written_by_many_tasks(spark, tmp_path):
    from tallyspark.sources import sinks as SK
    df = spark.range(4000).select(F.col("id").alias("task_id"), F.when(F.col("id") % 5 > 0, "big").otherwise("small").alias("system"),
                                  F.md5(F.col("id").cast("string")).alias("code"))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        SK.write_candidates(df, str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(list((tmp_path / "c" / "system=big").glob("*.parquet"))) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert SK.read_candidates(spark, str(tmp_path / "c")).count() == 4000


def test_candidates_with_long_codes_are_written_by_many_tasks(spark, tmp_path):
    from tallyspark.sources import sinks as SK
    name, code = "spark.sql.adaptive.advisoryPartitionSizeInBytes", F.sha2(F.concat(F.col("id").cast("string"), F.lit("-"), F.col("k").cast("string")), 512)
    df = (spark.range(400).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(80)))).repartition(8, "id").groupBy("id").agg(F.concat_ws("", F.collect_list(code)).alias("code"))
          .select(F.lit(None).cast("long").alias("task_id"), F.lit("one").alias("system"), "code"))
    spark.conf.set(name, "256k")
    try:
        SK.write_candidates(df, str(tmp_path / "c"))
    finally:
        spark.conf.unset(name)
    sizes = [f.stat().st_size for f in (tmp_path / "c" / "system=one").glob("*.parquet")]
    assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert SK.read_candidates(spark, str(tmp_path / "c"), ["one"]).count() == 400


def test_null_outcomes_fail(spark):
    from tallyspark.operators import scoring as S
    df = spark.createDataFrame([("s", 1, "p", "O0", True), ("s", 1, "p", "O0", None), ("s", 2, "p", "O0", True)],
                               "suite string, item_id long, system string, variant string, ok boolean")
    assert sorted((r.item_id, r.passed) for r in S.all_pass(df).collect()) == [(1, False), (2, True)]
    grid = S.dims_grid(spark, ["p", "q"], ["O0"])
    assert sorted((r.system, r.passes, r["items"]) for r in S.cer_rate(df, grid).collect()) == [("p", 1, 2), ("q", 0, 2)]
