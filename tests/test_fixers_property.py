"""Random code-like inputs: Spark fixers (Java regex) equal the same rules run with Python's `re`.

The Python side below restates the rules from the fixed values in
`tallyspark.functions.fixers` with Python regex syntax (`\\1`, `count=1`).
Inputs mix Unicode letters, digits, CR, tabs and the tokens each rule targets.
"""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import fixers as FX

TOKENS = ["sub_1a", "sub_FF", "fn0a", "fnZ", "out.7", "out.12x", "field_-ab;", "field_-9", "zx.o(0)", "[12]",
          "[ 0x1f ]", "unsigned int", "unsigned integer", "int128_t", "int512_t", "12f", "3F", "(* p)", "(*q1)",
          "a[]", "r.u0", "nullptr", "cond:x1", "@ zmm0", "@ zmm1", "__pure", "truncf(a, 2)", "x@<rax>",
          "éb@<eax>", "#include <a.h>", "#include<b>", "void* fsbase;", "long in_FS_OFFSET;", "é", "ß", "٣",
          " ", "  ", "\t", "\n", "\r", ";", "{", "}", "(", ")", "*", "int ", "char *", "static ", "f", "g1",
          "goto lab_0x1f;", "lab_0x1f:", "// 0x1f", "// 0x1", "goto lab_0x2;", "// 0x2", "\x1c", "\u3000",
          "#include\x1f<c>", "int\x1dh(int);", "(*\x1eq)", "²", "x\u0301", "a\u203fb", "Ⅻ"]

code_strategy = st.lists(st.sampled_from(TOKENS), max_size=40).map("".join)


def py(rules):
    return rules                 # the rules are stated in Python syntax


def py_angr(c, fn):
    for p, r in py(FX.ANGR_RULES):
        c = re.sub(p, r, c)
    return re.sub(FX.SUB_NAME, FX.FUNC0, c, count=1)


def py_binja(c, fn):
    for p, r in py(FX.BINJA_RULES):
        c = re.sub(p, r, c)
    c = FX.BINJA_PRELUDE + c
    c = c.replace(*FX.BINJA_LITERAL)
    return re.sub(FX.SUB_NAME, FX.FUNC0, c, count=1)


def py_dewolf(c, fn):
    for p, r in py(FX.DEWOLF_RULES):
        c = re.sub(p, r, c)
    return re.sub(FX.SUB_NAME, FX.FUNC0, c, count=1)


def py_hexrays(c, fn):
    c = re.sub(r"\b\w+@<[^>]+>", lambda m: m.group().split("@")[0], c)
    return re.sub(FX.SUB_NAME, FX.FUNC0, c, count=1)


def py_reko(c, fn):
    for p, r in py(FX.REKO_RULES):
        c = re.sub(p, r, c)
    return re.sub(FX.REKO_NAME, FX.FUNC0, c, count=1)


def py_retdec(c, fn):
    need = set(re.findall(FX.RETDEC_GOTO, c)) - set(re.findall(FX.RETDEC_LABEL, c))
    comments = re.findall(FX.RETDEC_COMMENT, c)
    for x in sorted(need):
        if x in comments:
            c = c.replace(f"// 0x{x}", f"lab_0x{x}:// 0x{x}")
    return c


def py_llm(decl_pat):
    decl = re.compile(decl_pat)
    impl = re.compile(FX.LLM_IMPLEMENTATION)

    def f(c, fn):
        c = py_hexrays(c, fn)
        c = re.sub(FX.INCLUDE_RULE[0], "", c)
        out, started = [], False
        for line in c.split("\n"):
            if not started and decl.match(line):
                continue
            m = impl.match(line)
            if m:
                started = True
                if m.group("function_name") != fn:
                    line = line.replace(m.group("function_name"), fn)
            out.append(line)
        return "\n".join(out)
    return f


CASES = [(FX.fix_angr, py_angr), (FX.fix_binja, py_binja), (FX.fix_dewolf, py_dewolf),
         (FX.fix_hexrays, py_hexrays), (FX.fix_reko, py_reko), (FX.fix_retdec, py_retdec),
         (FX.fix_llm, py_llm(FX.LLM_DECLARATION)), (FX.fix_llm_star, py_llm(FX.LLM_DECLARATION_STAR))]


@settings(max_examples=6, deadline=None)
@given(st.lists(code_strategy, min_size=30, max_size=30))
def test_fixers_match_python_regex(spark, codes):
    df = spark.createDataFrame([(k, c, "target") for k, c in enumerate(codes)], "k int, code string, item string")
    cols = [sp(F.col("code"), F.col("item")).alias(f"o{n}") for n, (sp, _) in enumerate(CASES)]
    for row in df.select("k", "code", *cols).collect():
        for n, (_, pyf) in enumerate(CASES):
            assert row[f"o{n}"] == pyf(row["code"], "target"), (n, row["code"])
