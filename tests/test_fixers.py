"""Hand-written cases for the candidate fixers (own inputs)."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import fixers as FX


def run(spark, fixer, code, item="target_fn"):
    df = spark.createDataFrame([(code, item)], "code string, item string")
    return df.select(fixer(F.col("code"), F.col("item")).alias("o")).first()["o"]


def test_angr_drops_semicolon_and_renames_first_sub_only(spark):
    out = run(spark, FX.fix_angr, "int sub_4a(int out.3){ x = field_-8; sub_4b(); }")
    assert out == "int func0(int out_3){ x = field____8 sub_4b(); }"


def test_replace_first_only_and_none_when_absent(spark):
    assert run(spark, FX.fix_dewolf, "a[12] sub_1 sub_2") == "a func0 sub_2"
    assert run(spark, FX.fix_dewolf, "unsigned int x;") == "int x;"
    assert run(spark, FX.fix_dewolf, "no calls") == "no calls"


def test_unicode_word_characters(spark):
    # \w and \b are Unicode, as in Python
    assert run(spark, FX.fix_hexrays, "int éa@<rax>; sub_ff();") == "int éa; func0();"


def test_binja_prelude_and_literal(spark):
    out = run(spark, FX.fix_binja, "void* fsbase; float x = 2f; truncf(a, b)")
    assert out.startswith("\nuint64_t fsbase_content[0x100];\n")
    assert "uint64_t* fsbase = fsbase_content;" in out
    assert "x = 2;" in out and "truncf(a)" in out


def test_ghidra_prepend_and_no_rename(spark):
    out = run(spark, FX.fix_ghidra, "long in_FS_OFFSET;\nsub_12();")
    assert out == ("int __global_in_FS_OFFSET[0x100];\n"
                   "long in_FS_OFFSET = (long)__global_in_FS_OFFSET;\nsub_12();")


def test_reko_rules(spark):
    assert run(spark, FX.fix_reko, "x = 3F; (* p) = a[] + r.u0; fn0800()") == "x = 3; * p = a + r; func0()"


def test_retdec_label_repair_prefix_collision(spark):
    code = "goto lab_0x12;\ngoto lab_0x12f8;\n// 0x12\n// 0x12f8\nlab_0x99:\ngoto lab_0x99;"
    out = run(spark, FX.fix_retdec, code)
    # ascending order: '12' first also hits the '// 0x12f8' comment, then '12f8'
    assert out == ("goto lab_0x12;\ngoto lab_0x12f8;\nlab_0x12:// 0x12\n"
                   "lab_0x12:lab_0x12f8:// 0x12f8\nlab_0x99:\ngoto lab_0x99;")


def test_retdec_label_without_comment_untouched(spark):
    code = "goto lab_0x5;\nreturn;"
    assert run(spark, FX.fix_retdec, code) == code


def test_llm_fixer_drops_only_leading_declarations_and_renames(spark):
    code = ("#include <stdio.h>\nint helper(int a);\nchar *name(int x);\n"
            "static int wrong_name(int a) {\n  return helper(a);\n}\nint later(int z);\n")
    out = run(spark, FX.fix_llm, code, "right")
    assert out == ("\nchar *name(int x);\nstatic int right(int a) {\n  return helper(a);\n}\n"
                   "int later(int z);\n")
    out_star = run(spark, FX.fix_llm_star, code, "right")
    assert "char *name" not in out_star and "int later(int z);" in out_star


def test_llm_fixer_without_implementation_drops_all_declarations(spark):
    out = run(spark, FX.fix_llm, "int a(void);\nint b(int);\nx = 1;", "f")
    assert out == "x = 1;"


def test_llm_fixer_implementation_with_semicolon_after_brace_is_not_implementation(spark):
    code = "int g(int q) { return q; }"
    assert run(spark, FX.fix_llm, code, "f") == code


def test_identity_and_dispatch(spark):
    df = spark.createDataFrame([("func", "sub_1 x", "f"), ("angr", "sub_1 out.2", "f"),
                                ("nobody", "sub_1", "f"), ("claude", "int a(int);\nint sub_9(void) {", "f")],
                               "system string, code string, item string")
    got = {r["system"]: r["o"] for r in df.select("system", FX.apply_fixers("system", "code", "item").alias("o")).collect()}
    assert got == {"func": "sub_1 x", "angr": "func0 out_2", "nobody": "sub_1", "claude": "int f(void) {"}


def test_register_fixer(spark):
    FX.register_fixer("upper", lambda c, fn: F.upper(c))
    try:
        df = spark.createDataFrame([("upper", "abc", "f")], "system string, code string, item string")
        assert df.select(FX.apply_fixers("system", "code", "item")).first()[0] == "ABC"
    finally:
        del FX.FIXERS["upper"]


@pytest.mark.parametrize("code,ok", [(None, False), ("", False), ("x Failed to decompile the function", False),
                                     ("int f(){}", True)])
def test_compilable(spark, code, ok):
    df = spark.createDataFrame([(code,)], "code string")
    assert df.select(FX.compilable("code")).first()[0] is ok


def test_register_pandas_udf_fixer(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def reverse(code: pd.Series, item: pd.Series) -> pd.Series:
        return code.str[::-1]

    FX.register_fixer("rev", lambda c, fn: reverse(c, fn))
    try:
        df = spark.createDataFrame([("rev", "abc", "f"), ("angr", "sub_1", "f")], "system string, code string, item string")
        got = {r.system: r.o for r in df.select("system", FX.apply_fixers("system", "code", "item").alias("o")).collect()}
        assert got == {"rev": "cba", "angr": "func0"}
    finally:
        del FX.FIXERS["rev"]


def test_retdec_many_labels_in_one_scan(spark):
    """Labels that are prefixes of others, repeated comments, and ten thousand labels in one text."""
    import random
    import re
    import time

    def plain(code):
        todo = set(re.findall(FX.RETDEC_GOTO, code)) - set(re.findall(FX.RETDEC_LABEL, code))
        comments = set(re.findall(FX.RETDEC_COMMENT, code))
        for x in sorted(todo & comments):
            code = code.replace(f"// 0x{x}", f"lab_0x{x}:// 0x{x}")
        return code

    rng = random.Random(9)
    codes = []
    for _ in range(150):
        name = lambda: "".join(rng.choice("01a") for _ in range(rng.randrange(1, 5)))
        codes.append("\n".join(rng.choice(["goto lab_0x{};", "// 0x{}", "/// 0x{}z", "lab_0x{}:", "x // 0x{} // 0x{}", "// 0x", "// 0xZ", "é"])
                               .format(name(), name()) for _ in range(rng.randrange(0, 40))))
    big = "\n".join(f"goto lab_0x{k:x};\n// 0x{k:x}" for k in range(4096, 14096))
    df = spark.createDataFrame([(k, c) for k, c in enumerate([*codes, big])], "k int, code string")
    start = time.time()
    got = {r.k: r.o for r in df.select("k", FX.fix_retdec(F.col("code")).alias("o")).collect()}
    assert time.time() - start < 60
    assert [got[k] for k in range(len(codes))] == [plain(c) for c in codes]
    assert got[len(codes)] == re.sub(r"// 0x([0-9a-f]+)", r"lab_0x\1:// 0x\1", big)
    assert sum(got[k] != c for k, c in enumerate(codes)) > 50
