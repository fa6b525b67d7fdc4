"""Random strings: text utilities equal plain Python restatements of the rules."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import code_text as CT
from tallyspark.functions.text import py_strip
from tallyspark.operators import grids as G

ATOMS = [" ", "\t", "\n", "\r", "\u2028", "\u3000", "\xa0", "\x1c", "a", "é", "x1", "extern", "extern ",
         "extern\t", "```refined\n", "\n```", "```", "[-W", "]", "unused", "task-", "_", "-O2", "-Os", ".so",
         ".strip", "/", "suite", "fn", "ß", "\u0663", "²", "x\u0301", "a\u203fb", "Ⅻ", "O²"]
texts = st.lists(st.sampled_from(ATOMS), max_size=25).map("".join)


def py_refined(s):
    m = re.search(r"```refined\n(.*?)\n```", s, re.DOTALL)
    return (m.group(1).strip() if m else s).strip()


def py_extern(s):
    return "\n".join(x.replace("extern", "") if re.match(r"^extern\s+", x) else x for x in s.split("\n"))


def py_path(s):
    m = re.compile(r"task-([^_]+)_(.*)-(O\w).so").match(s.split("/")[-1])
    if not m:
        return (None, None, None, False)
    v = m.group(3) + (".strip" if s.split("/")[-1].endswith(".strip") else "")
    return (m.group(1), m.group(2), v, True)


@settings(max_examples=5, deadline=None)
@given(st.lists(texts, min_size=40, max_size=40))
def test_text_utilities_match_python(spark, xs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, s string")
    rows = df.select("k", "s", py_strip("s").alias("strip"), CT.refined_code("s").alias("refined"),
                     CT.strip_extern("s").alias("extern"), CT.warnings("s").alias("warn"),
                     G.parse_artifact_path("s").alias("path")).collect()
    for r in rows:
        s = r["s"]
        assert r["strip"] == s.strip()
        assert r["refined"] == py_refined(s)
        assert r["extern"] == py_extern(s)
        assert r["warn"] == re.findall(r"\[-W(.*)\]", s)
        assert tuple(r["path"]) == py_path(s), s


def py_decode(raw):
    """The service's status decode, with the prefix-length cut for error: (documented choice)."""
    if not raw:
        return ("completed", "Task not found")
    if raw.startswith("completed:"):
        return ("completed", raw[len("completed:"):].strip())
    if raw.startswith("error:"):
        return ("error", raw[len("error:"):].strip())
    if raw.startswith("processing:"):
        return ("processing", None)
    if raw.startswith("failed:"):
        return ("error", raw[len("failed:"):])
    return (None, None)


STATUS_ATOMS = ["completed:", "error:", "processing:", "failed:", " ", "　", "x", "{}", ":", "é"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(STATUS_ATOMS), max_size=6).map("".join)),
                min_size=40, max_size=40))
def test_status_decode_matches_python(spark, raws):
    from tallyspark.operators.status import decode_status
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string")
    got = {r.k: tuple(r.s) for r in df.select("k", decode_status("raw").alias("s")).collect()}
    assert got == {k: py_decode(r) for k, r in enumerate(raws)}
