"""The named-files source: names, headers, partial reads, and writes whose tasks are lost."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.sources import ingest as I
from tallyspark.sources import named_files as N


def under(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def rows(spark, data):
    return spark.createDataFrame(data, "name string, content string")


def test_one_file_per_row_and_partial_reads(spark, tmp_path):
    root = str(tmp_path / "out")
    data = [(f"s{k % 3}/f{k}.c", f"body {k} ünï\n" * k) for k in range(50)] + [("s0/empty.c", ""), ("s0/none.c", None), ("top.txt", "x")]
    N.write_named_files(rows(spark, data).repartition(7), root, F.col("name"), F.col("content"))
    assert under(root) == sorted(n for n, _ in data)
    for n, c in data:
        assert open(f"{root}/{n}", encoding="utf-8").read() == (c or "")
    os.makedirs(f"{root}/_hidden")
    open(f"{root}/_hidden/x.c", "w").write("no")
    back = {r.name: r for r in N.read_named_files(spark, f"file://{root}", suffix=".c", partition_files=4).collect()}
    assert len(back) == 52 and back["f7.c"].content.decode() == data[7][1] and back["f7.c"].folder == "s1"
    head = N.read_named_files(spark, root, head=4, partition_bytes=1 << 20)
    got = {r.name: r for r in head.collect()}
    assert got["f7.c"].content == b"body" and got["f7.c"].size == len(data[7][1].encode()) and got["empty.c"].content == b""
    assert [r.name for r in N.read_named_files(spark, root, recursive=False).collect()] == ["top.txt"]
    assert N.read_named_files(spark, str(tmp_path / "missing")).count() == 0


def test_rows_of_a_name_under_one_header(spark, tmp_path):
    df = spark.createDataFrame([(f"{k % 3}.jsonl", k, f"line {k}\n") for k in range(300)], "name string, k long, line string").repartition(9)
    N.write_named_files(df, str(tmp_path), F.col("name"), F.col("line"), F.when(F.col("name") != "2.jsonl", F.concat("name", F.lit("\n"))),
                        F.col("k"))
    for f in range(3):
        exp = [f"{f}.jsonl"] * (f != 2) + [f"line {k}" for k in range(f, 300, 3)]
        assert (tmp_path / f"{f}.jsonl").read_text().splitlines() == exp


@pytest.mark.parametrize("bad", ["/abs", "../up", "a/../b", "", "a//b", "_x/y", ".hidden", None])
def test_names_stay_in_the_folder(spark, tmp_path, bad):
    with pytest.raises(Exception, match="not a name"):
        N.write_named_files(rows(spark, [("ok.c", "x"), (bad, "y")]), str(tmp_path / "out"), F.col("name"), F.col("content"))
    assert under(tmp_path) == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(0, 200, numPartitions=4).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise(F.lit("text")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        N.write_named_files(df, root, F.col("name"), F.col("content"))
    assert under(root) == [] and not [d for d in os.listdir(root) if d.startswith(N.STAGING)]


def test_names_that_clash(spark, tmp_path):
    root = str(tmp_path)
    twice = spark.range(0, 2, numPartitions=2).select(F.lit("same.c").alias("name"), F.col("id").cast("string").alias("content"))
    with pytest.raises(Exception, match="two tasks wrote"):
        N.write_named_files(twice, root, F.col("name"), F.col("content"))
    assert under(root) == []
    one = rows(spark, [("same.c", "1")])
    N.write_named_files(one, root, F.col("name"), F.col("content"))
    with pytest.raises(Exception, match="FileExistsError"):
        N.write_named_files(rows(spark, [("same.c", "2"), ("b.c", "b")]), root, F.col("name"), F.col("content"))
    assert under(root) == ["same.c"] and (tmp_path / "same.c").read_text() == "1"
    N.write_named_files(rows(spark, [("same.c", "2"), ("b.c", "b")]), root, F.col("name"), F.col("content"), overwrite=True)
    assert under(root) == ["b.c", "same.c"] and (tmp_path / "same.c").read_text() == "2"


def test_only_reported_attempts_are_moved(tmp_path):
    """An attempt that is lost after it wrote, and its repetition."""
    w = N._Writer({"path": str(tmp_path)}, ["name", "content"], False)
    batch = pa.RecordBatch.from_pydict({"name": ["a.c", "s/b.c"], "content": ["1", "2"]})

    def lost():
        yield batch
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        w.write(lost())
    speculative = w.write(iter([batch]))
    done = w.write(iter([batch]))
    assert speculative.attempt != done.attempt and all(n.startswith(N.STAGING) for n in under(tmp_path))
    w.commit([done, None])
    assert under(tmp_path) == ["a.c", "s/b.c"]
    with pytest.raises(ValueError):
        N._Writer({"path": str(tmp_path)}, ["name", "text"], False)


def test_manifests(spark, tmp_path):
    texts = {"a": "language: c\n", "b": "x: 1\nlanguage: \"c++\" # comment\n", "c": "language: 'jvm'\n", "d": "# none\n sub:\n  language: c\n",
             "e": "language: python\nlanguage: c\n", "f": "language: null\n", "g": "", "h": "language: c#\n", "i": "language:\n"}
    for k, t in texts.items():
        (tmp_path / k).mkdir()
        (tmp_path / k / "project.yaml").write_text(t)
        (tmp_path / k / "other.yaml").write_text("language: c\n")
    got = {r.suite: r.language for r in I.read_manifests(spark, str(tmp_path)).collect()}
    assert got == {"a": "c", "b": "c++", "c": "jvm", "d": None, "e": "c", "f": None, "g": None, "h": "c#", "i": None}
    assert sorted(r.suite for r in I.c_suites(I.read_manifests(spark, str(tmp_path))).collect()) == ["a", "b", "e"]


def test_result_files_are_named_by_system(spark, tmp_path):
    df = spark.createDataFrame([("angr" if k % 4 else "b x", k, k % 50, f"c{k}") for k in range(400)],
                               "system string, seq long, task_id long, code string").repartition(5)
    I.write_result_files(df, str(tmp_path), file_rows=100, without_header=["angr"])
    assert len(under(tmp_path)) > 3 and all(f.endswith(("/angr.jsonl", "/b x.jsonl")) for f in under(tmp_path))
    exp = {}
    for k in range(400):
        exp["angr" if k % 4 else "b x", k % 50] = f"c{k}"
    assert {(r.system, r.task_id): r.code for r in I.read_headered_jsonl(spark, str(tmp_path)).collect()} == exp


def test_new_folders_of_one_task_are_moved_whole(tmp_path, monkeypatch):
    """Folders that two tasks wrote, that exist or that hold folders are moved file by file; a name that exists fails before any move."""
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "there").write_text("before")

    def write(*tasks):
        w = N._Writer({"path": str(tmp_path)}, ["name", "content"], False)
        return w, [w.write(iter([pa.record_batch({"name": list(t), "content": [n.encode() for n in t]})])) for t in tasks]

    real, moved = N._open_fs, []

    class Counting:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def move(self, a, b):
            moved.append(b[len(str(tmp_path)) + 1:])
            self.fs.move(a, b)

    monkeypatch.setattr(N, "_open_fs", lambda p: (Counting(real(p)[0]), real(p)[1]))
    w, m = write(["a/x/1", "a/x/2", "b/1", "old/1", "top", "c/1", "c/d/1"], ["a/y/1", "b/2", "e/1"])
    w.commit([*m, None])
    assert sorted(moved) == ["a/x", "a/y", "b/1", "b/2", "c/1", "c/d", "e", "old/1", "top"]
    files = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert files.pop("old/there") == "before" and files == {n: n for n in files}
    assert sorted(files) == ["a/x/1", "a/x/2", "a/y/1", "b/1", "b/2", "c/1", "c/d/1", "e/1", "old/1", "top"]
    del moved[:]
    for tasks in ([["new/1", "old/there"]], [["new/1"], ["new/1"]]):
        w, m = write(*tasks)
        with pytest.raises((FileExistsError, ValueError)):
            w.commit(m)
    assert not moved and not (tmp_path / "new").exists() and not list(tmp_path.glob("_*"))
    got = sorted(p for part in N._Reader({"path": str(tmp_path)}).partitions() for p, _ in part.files)
    assert got == sorted(str(tmp_path / n) for n in [*files, "old/there"])
    assert [p for part in N._Reader({"path": str(tmp_path), "recursive": "false"}).partitions() for p, _ in part.files] == [str(tmp_path / "top")]
