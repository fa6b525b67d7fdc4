"""Text utilities: spans, preludes, symbols, warnings, prompts (own cases)."""

import re

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import code_text as CT


def one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("o")).first()["o"]


@pytest.mark.parametrize("sl,sc,el,ec,want", [
    (2, 3, 2, 5, "cde"),                 # one line: columns 3..5
    (1, 1, 3, 2, "xy\nabcdef\nqq\n"),    # several lines: whole lines, each with a newline
    (2, 4, 2, 4, None),                  # zero width
    (4, 2, 4, 3, "é"),                   # bytes 2..3 of 'aé' is the two-byte é
    (4, 2, 4, 2, None),
    (4, 1, 4, 2, None),                  # cuts through é: not decodable -> null
])
def test_span_text(spark, sl, sc, el, ec, want):
    text = "xy\nabcdef\nqq\naé"
    got = one(spark, CT.span_text("t", "a", "b", "c", "d"), "t string, a int, b int, c int, d int",
              (text, sl, sc, el, ec))
    assert got == want


def test_split_prelude_orders_and_undef(spark):
    content = "int f(int);\nint f(int);\n#undef A\nint f(int x) { return x; }\n#undef B\nnext line\nkeep\n"
    df = spark.createDataFrame([(content, ["int f(int);", "missing;"], "int f(int x) { return x; }")],
                               "c string, d array<string>, b string")
    got = df.select(CT.split_prelude("c", "d", "b")).first()[0]
    tail = re.sub(r"#undef\s.*", "", "\n#undef B\nnext line\nkeep\n")
    assert got == "\nint f(int);\n#undef A\n" + tail
    assert tail == "\n\nnext line\nkeep\n"


def test_undef_at_line_end_swallows_next_line(spark):
    df = spark.createDataFrame([("pre BODY#undef\nnext\nkeep", "BODY")], "c string, b string")
    got = df.select(CT.split_prelude("c", F.array().cast("array<string>"), "b")).first()[0]
    assert got == "pre " + re.sub(r"#undef\s.*", "", "#undef\nnext\nkeep")


def test_symbol_address(spark):
    rows = [("00001a0 T foo", "foo", 0x1A0), ("00001A0 T xfoo", "foo", None), ("00001A0 t foo", "foo", 0x1A0), ("zz T foo", "foo", None),
            ("10 T foo_bar", "foo", None)]
    df = spark.createDataFrame(rows, "line string, name string, want long")
    for r in df.select(CT.symbol_address("line", "name").alias("a"), "want").collect():
        assert r.a == r.want


def test_warnings_greedy_per_line(spark):
    s = "x [-Wa] y [-Wb]\nz [-Wc]"
    assert one(spark, CT.warnings("s"), "s string", (s,)) == re.findall(r"\[-W(.*)\]", s)


def test_prompts_by_family(spark):
    df = spark.createDataFrame([("MLM-1", " c "), ("LLM4Decompile-x", " c "), ("other", " c ")], "m string, c string")
    out = [tuple(r[0]) for r in df.select(CT.render_refine_prompt("m", "c", "<{code}>", "SYS", "Tidy:\n{code}")).collect()]
    assert out == [("error", None, None), ("completion", None, "<c>"), ("chat", "SYS", "Tidy:\n c ")]


def test_arguments(spark):
    df = spark.createDataFrame([(["cc", "-O2", "-o", "a.o", "x.c", "-o", "b"],), (["cc", "x.c", "-o"],)], "a array<string>")
    got = [r[0] for r in df.select(CT.clean_arguments("a")).collect()]
    assert got == [["-O2", "x.c", "-o", "b"], ["x.c"]]


from hypothesis import given, settings, strategies as st  # noqa: E402

BREAKS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "a", "b c", "é", ""]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BREAKS), max_size=12).map("".join), min_size=40, max_size=40))
def test_splitlines_matches_python(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.s for r in df.select("k", CT.py_splitlines("t").alias("s")).collect()}
    assert got == {k: t.splitlines() for k, t in enumerate(texts)}


def test_prelude_is_null_where_the_body_does_not_occur(spark):
    from tallyspark.functions.code_text import split_prelude
    df = spark.createDataFrame([("int a;\r\nint f() {}\r\n", "int f() {}\n"), ("int a;\nint f() {}", "int f() {}\n"),
                                ("int a;\nint f() {}\n#undef X\n", "int f() {}\n")], "content string, body string")
    got = [r[0] for r in df.select(split_prelude("content", F.array().cast("array<string>"), "body")).collect()]
    assert got[:2] == [None, None] and got[2].startswith("int a;\n")
