"""Candidate-code normalisers ("fixers"), one per system, as Column expressions.

A fixer rewrites one system's output so it can be compiled the same way as the
others. Each is a chain of built-in ``regexp_replace`` / ``replace`` /
higher-order array functions, so it runs inside whole-stage codegen with no
Python UDF. :func:`apply_fixers` dispatches over a long ``(system, code)``
table with one ``CASE`` expression; :func:`register_fixer` adds a system.

Regex dialect: the rules are stated in Python ``re`` syntax and run through
``functions.text.java_regex``, which keeps Python's meaning of ``\\w \\s \\d \\b``
and ``.`` on Java regex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, java_regex, let, lines, py_sub, py_sub_first, unlines

Fixer = Callable[[Column, Column], Column]

# ---------------------------------------------------------------------------
# Fixed values (rewrite rules and literals that must equal the reference's
# normalisation, in Python ``re`` syntax; order matters within each list).

SUB_NAME = r"sub_[0-9a-fA-F]+"          # first one becomes FUNC0
REKO_NAME = r"fn[0-9a-fA-F]+"           # first one becomes FUNC0
FUNC0 = "func0"

ANGR_RULES = [
    (r"\bout\.(\d+)\b", r"out_\1"),
    (r"field_-(\w+);", r"field____\1"),
]

BINJA_RULES = [
    (r"@ zmm0", ""),
    (r"@ zmm1", ""),
    (r"__pure", ""),
    (r"truncf\(([^,]+),\s*[^)]+\)", r"truncf(\1)"),
    (r"\[\s*0x[0-9a-fA-F]+\s*\]", ""),
    (r"(\d+)f", r"\1"),
    (r"nullptr", "NULL"),
    (r"cond:[^ \n]+", "cond"),
    (r"out\.(\d+)", r"out_\1"),
    (r"int128_t", "float"),
    (r"int512_t", "float"),
]
BINJA_PRELUDE = "\nuint64_t fsbase_content[0x100];\n"
BINJA_LITERAL = ("void* fsbase;", "uint64_t* fsbase = fsbase_content;")

DEWOLF_RULES = [
    (r"\[\d+\]", ""),
    (r"zx\.o\(0\)", "0"),
    (r"\bunsigned int\b", "int"),
    (r"\bint128_t\b", "float"),
    (r"\bint512_t\b", "float"),
]

GHIDRA_PRELUDE = "int __global_in_FS_OFFSET[0x100];\n"
GHIDRA_LITERAL = ("long in_FS_OFFSET;", "long in_FS_OFFSET = (long)__global_in_FS_OFFSET;")

# register-annotated names keep the part before '@' (the name is captured)
HEXRAYS_RULES = [
    (r"\b(\w+)@<[^>]+>", r"\1"),
]

REKO_RULES = [
    (r"(\d+)F\b", r"\1"),
    (r"\(\*\s*(\w+)\)", r"* \1"),
    (r"(\w+)\[\]", r"\1"),
    (r"\.u0", ""),
]

RETDEC_GOTO = r"goto lab_0x([0-9a-f]+);"
RETDEC_LABEL = r"lab_0x([0-9a-f]+):"
RETDEC_COMMENT = r"// 0x([0-9a-f]+)"

INCLUDE_RULE = (r"#include\s*<[^>]+>", "")
LLM_DECLARATION = r"^[ \t]*(?:[a-zA-Z_][\w\s\*\(\)]*)\s+[a-zA-Z_]\w*\s*\([^;]*\);\s*$"
LLM_DECLARATION_STAR = r"^[ \t]*(?:[a-zA-Z_][\w\s\*\(\)]*)\s+[\*]*[a-zA-Z_]\w*\s*\([^;]*\);\s*$"
LLM_IMPLEMENTATION = (r"^[ \t]*(?:[a-zA-Z_][\w\s\*\(\)]*)\s+(?P<function_name>[a-zA-Z_]\w*)"
                      r"\s*\([^;]*\)\s*(?!.*;).*{")

# ---------------------------------------------------------------------------


def _chain(c: Column, rules) -> Column:
    for pat, rep in rules:
        c = py_sub(c, pat, rep)
    return c


def fix_angr(code: Column, _fn: Column | None = None) -> Column:
    """``out.N`` -> ``out_N``; ``field_-X;`` -> ``field____X`` (the ``;`` goes); first sub_ -> func0."""
    return py_sub_first(_chain(code, ANGR_RULES), SUB_NAME, FUNC0)


def fix_binja(code: Column, _fn: Column | None = None) -> Column:
    """Ordered rule list, prepend the fsbase array, literal fsbase rewrite, first sub_ -> func0."""
    c = F.concat(F.lit(BINJA_PRELUDE), _chain(code, BINJA_RULES))
    c = F.replace(c, F.lit(BINJA_LITERAL[0]), F.lit(BINJA_LITERAL[1]))
    return py_sub_first(c, SUB_NAME, FUNC0)


def fix_dewolf(code: Column, _fn: Column | None = None) -> Column:
    """Drop ``[N]``, ``zx.o(0)`` -> 0, type rewrites, first sub_ -> func0."""
    return py_sub_first(_chain(code, DEWOLF_RULES), SUB_NAME, FUNC0)


def fix_ghidra(code: Column, _fn: Column | None = None) -> Column:
    """Prepend the global FS array and point ``in_FS_OFFSET`` at it (no rename)."""
    c = F.concat(F.lit(GHIDRA_PRELUDE), code)
    return F.replace(c, F.lit(GHIDRA_LITERAL[0]), F.lit(GHIDRA_LITERAL[1]))


def fix_hexrays(code: Column, _fn: Column | None = None) -> Column:
    """``name@<reg>`` -> ``name``; first sub_ -> func0."""
    return py_sub_first(_chain(code, HEXRAYS_RULES), SUB_NAME, FUNC0)


def fix_reko(code: Column, _fn: Column | None = None) -> Column:
    """Float suffix, ``(*p)``, ``a[]``, ``.u0``; first fnHEX -> func0."""
    return py_sub_first(_chain(code, REKO_RULES), REKO_NAME, FUNC0)


def fix_retdec(code: Column, _fn: Column | None = None) -> Column:
    """Labels used by ``goto`` but never defined get defined at their ``// 0xH`` comment.

    The rewrite is that of a literal replace per label, so ``// 0x12`` also hits ``// 0x12f8``.
    Labels are applied in ascending text order (the reference's order is arbitrary): a comment gets the labels that are
    its prefixes, shortest first. One scan of the text: it is split at the comments, and a comment's prefixes of the lengths that
    labels have are looked up in the sorted labels.
    """
    needed = F.regexp_extract_all(code, F.lit(java_regex(RETDEC_GOTO)), 1)
    defined = F.regexp_extract_all(code, F.lit(java_regex(RETDEC_LABEL)), 1)
    comments = F.regexp_extract_all(code, F.lit(java_regex(RETDEC_COMMENT)), 1)
    todo = F.array_sort(F.array_intersect(F.array_except(needed, defined), comments))
    comment = "// 0x"

    def repaired(labels: Column) -> Column:
        lengths = F.array_sort(F.array_distinct(F.transform(labels, lambda x: F.length(x))))

        def of_comment(ls: Column, part: Column) -> Column:
            digits = F.regexp_extract(part, "^[0-9a-f]+", 0)
            own = F.filter(ls, lambda n: (n <= F.length(digits)) & _contains_sorted(labels, F.left(digits, n)))
            return F.concat(F.array_join(F.transform(own, lambda n: F.concat(F.lit("lab_0x"), F.left(digits, n), F.lit(":"))), ""),
                            F.lit(comment), part)

        return let(lengths, lambda ls: F.array_join(F.transform(
            F.split(code, comment, -1), lambda part, i: F.when(i == 0, part).otherwise(of_comment(ls, part))), ""))

    return let(todo, lambda labels: F.when(F.size(labels) == 0, code).otherwise(repaired(labels)))


def _contains_sorted(values: Column, x: Column) -> Column:
    """Whether a sorted array has ``x``, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))

    def half(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(values, mid) < x
        return F.struct(F.when(s["lo"] >= s["hi"], s["lo"]).when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when((s["lo"] >= s["hi"]) | below, s["hi"]).otherwise(mid).alias("hi"))

    return F.coalesce(F.aggregate(steps, start, half, lambda s: F.get(values, s["lo"]) == x), F.lit(False))


def _where(code: Column, literal: str, fix: Callable[[Column], Column]) -> Column:
    """``fix`` on texts that hold ``literal``, without which its pattern cannot match."""
    return let(code, lambda c: F.when(c.contains(literal), fix(c)).otherwise(c))


def _tagged(code: Column, decl: str, impl: str) -> Column:
    """Every line once: ``l``, whether it is a (d)eclaration, the implemented (n)ame ('' when not an implementation)."""
    return F.transform(lines(code), lambda x: F.struct(
        x.alias("l"), F.when(x.contains(");"), x.rlike(decl)).otherwise(False).alias("d"),
        F.when(x.contains("{") & x.contains("("), F.regexp_extract(x, impl, 1)).otherwise("").alias("n")))


def _fix_llm(code: Column, fn: Column, declaration: str) -> Column:
    # the patterns are only tried where their fixed characters are
    c = _where(code, "@<", lambda x: _chain(x, HEXRAYS_RULES))
    c = _where(c, "sub_", lambda x: py_sub_first(x, SUB_NAME, FUNC0))
    c = _where(c, "#include", lambda x: py_sub(x, *INCLUDE_RULE))
    decl, impl = java_regex(declaration), java_regex(LLM_IMPLEMENTATION)

    def with_tags(tg: Column) -> Column:
        # declarations are dropped only before the first implementation line
        first_impl = F.array_position(F.transform(tg, lambda t: (t["n"] != "") & ~t["d"]), True)
        fi = F.when(first_impl > 0, first_impl - 1).otherwise(F.lit(2147483647))

        def with_first(f: Column) -> Column:
            kept = F.filter(tg, lambda t, i: (i >= f) | ~t["d"])
            renamed = F.transform(kept, lambda t: F.when((t["n"] != "") & (t["n"] != fn),
                                                         F.replace(t["l"], t["n"], fn)).otherwise(t["l"]))
            return unlines(renamed)

        return let(fi, with_first)

    # most texts have neither: they are not split at all
    return let(c, lambda x: F.when(x.contains("(") & (x.contains(");") | x.contains("{")), let(_tagged(x, decl, impl), with_tags)).otherwise(x))


def fix_llm(code: Column, fn: Column) -> Column:
    """Hexrays rules, drop includes, drop declarations before the first
    implementation line, rename the implemented function to ``fn`` on every
    implementation line."""
    return _fix_llm(code, fn, LLM_DECLARATION)


def fix_llm_star(code: Column, fn: Column) -> Column:
    """As N8, the declaration rule also allows ``*`` before the name."""
    return _fix_llm(code, fn, LLM_DECLARATION_STAR)


def fix_identity(code: Column, _fn: Column | None = None) -> Column:
    """Pass-through."""
    return code


# system -> fixer (U1: extend with register_fixer)
FIXERS: dict[str, Fixer] = {
    "angr": fix_angr,
    "binja": fix_binja,
    "dewolf": fix_dewolf,
    "ghidra": fix_ghidra,
    "hexrays": fix_hexrays,
    "reko": fix_reko,
    "retdec": fix_retdec,
    "claude": fix_llm,
    "deepseek": fix_llm,
    "qwen": fix_llm,
    "gpt-4o-mini": fix_llm,
    "gpt-4o": fix_llm_star,
    "func": fix_identity,
    "llm4decompile": fix_identity,
    "mlm": fix_identity,
}


def register_fixer(system: str, fixer: Fixer) -> None:
    """Add or replace the fixer of a system (a ``(code, item) -> Column`` function)."""
    FIXERS[system] = fixer


def apply_fixers(system: Column | str, code: Column | str, item: Column | str,
                 fixers: dict[str, Fixer] | None = None) -> Column:
    """Dispatch by system over a long candidate table; unknown systems pass through."""
    s, c, fn = col_(system), col_(code), col_(item)
    reg = FIXERS if fixers is None else fixers
    out = None
    for name, fx in reg.items():
        out = (F.when(s == name, fx(c, fn)) if out is None else out.when(s == name, fx(c, fn)))
    return c if out is None else out.otherwise(c)


def compilable(code: Column | str) -> Column:
    """B2: null/empty or a failure marker -> not attempted (flag 0)."""
    c = col_(code)
    return ~(F.coalesce(c, F.lit("")) == "") & ~F.coalesce(c, F.lit("")).contains(FAIL_MARKER)


# Fixed value: in-band failure text of a system's output.
FAIL_MARKER = "Failed to decompile the function"
