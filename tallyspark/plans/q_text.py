"""Registered text queries: candidate fixers (N1-N10), eligibility (B2), stability diff."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixers as FX
from ..operators import stability as ST
from . import fixtures as fx
from .registry import register

# ---------------------------------------------------------------- SQL helpers (oracle side)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(p: str) -> str:
    """Python-syntax pattern of this package -> RE2, with Python's classes for letters, digits and white space."""
    members = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": r" \t-\r\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}"}
    out, inside, i = [], False, 0
    while i < len(p):
        c = p[i:i + 2] if p[i] == "\\" else p[i]
        if c[-1] in members and len(c) == 2:
            out.append(members[c[1]] if inside else f"[{members[c[1]]}]")
        else:
            inside = (inside or c == "[") and c != "]"
            out.append(c)
        i += len(c)
    p = "".join(out)
    # the lookahead is not RE2; on one line it equals "no ';' in the rest and a '{'"
    return p.replace(r"(?!.*;).*{", r"[^;]*\{[^;]*$")


def rep(r: str) -> str:
    return r                     # Python and DuckDB both write group 1 as \1


def chain_sql(expr: str, rules) -> str:
    for pat, r in rules:
        expr = f"regexp_replace({expr}, {q(re2(pat))}, {q(rep(r))}, 'g')"
    return expr


def first_sql(expr: str, pat: str, r: str) -> str:
    return f"regexp_replace({expr}, {q(re2(pat))}, {q(r)})"


SQL_FIX = {
    "angr": lambda c: first_sql(chain_sql(c, FX.ANGR_RULES), FX.SUB_NAME, FX.FUNC0),
    "binja": lambda c: first_sql(
        f"replace(concat({q(FX.BINJA_PRELUDE)}, {chain_sql(c, FX.BINJA_RULES)}), "
        f"{q(FX.BINJA_LITERAL[0])}, {q(FX.BINJA_LITERAL[1])})", FX.SUB_NAME, FX.FUNC0),
    "dewolf": lambda c: first_sql(chain_sql(c, FX.DEWOLF_RULES), FX.SUB_NAME, FX.FUNC0),
    "ghidra": lambda c: f"replace(concat({q(FX.GHIDRA_PRELUDE)}, {c}), {q(FX.GHIDRA_LITERAL[0])}, "
                        f"{q(FX.GHIDRA_LITERAL[1])})",
    "hexrays": lambda c: first_sql(chain_sql(c, FX.HEXRAYS_RULES), FX.SUB_NAME, FX.FUNC0),
    "reko": lambda c: first_sql(chain_sql(c, FX.REKO_RULES), FX.REKO_NAME, FX.FUNC0),
    "identity": lambda c: c,
}


def retdec_sql(c: str) -> str:
    needed = f"regexp_extract_all({c}, {q(FX.RETDEC_GOTO)}, 1)"
    defined = f"regexp_extract_all({c}, {q(FX.RETDEC_LABEL)}, 1)"
    comments = f"regexp_extract_all({c}, {q(FX.RETDEC_COMMENT)}, 1)"
    todo = (f"list_sort(list_distinct(list_filter({needed}, lambda x: not list_contains({defined}, x) "
            f"and list_contains({comments}, x))))")
    return (f"list_reduce(list_prepend({c}, {todo}), "
            f"lambda acc, x: replace(acc, '// 0x' || x, 'lab_0x' || x || ':// 0x' || x))")


def llm_sql(src: str, decl: str) -> str:
    d, im = q(re2(decl)), q(re2(FX.LLM_IMPLEMENTATION))
    pre = first_sql(chain_sql("code", FX.HEXRAYS_RULES), FX.SUB_NAME, FX.FUNC0)
    pre = chain_sql(pre, [FX.INCLUDE_RULE])
    return f"""
with c1 as (select task_id, item, string_split({pre}, chr(10)) arr from {src}),
f as (select task_id, item, arr,
             coalesce(list_min(list_filter(list_transform(arr, lambda x, i: case when regexp_matches(x, {im})
                      and not regexp_matches(x, {d}) then i end), lambda v: v is not null)), 2147483647) fi
      from c1)
select task_id, array_to_string(list_transform(
         list_filter(arr, lambda x, i: i >= fi or not regexp_matches(x, {d})),
         lambda x: case when regexp_matches(x, {im}) and regexp_extract(x, {im}, 1) <> item
                        then replace(x, regexp_extract(x, {im}, 1), item) else x end), chr(10)) code
from f"""


# ---------------------------------------------------------------- fixer queries

def _fixer_query(name, spark_fix, sql_expr_fn):
    @register(name, sql=f"with {fx.CANDIDATE_CODE_RICH_SQL} select task_id, {sql_expr_fn('code')} code from rich")
    def build(spark, sf_dir, _f=spark_fix):
        r = fx.candidate_code_rich(spark, sf_dir)
        return r.select("task_id", _f(F.col("code"), F.col("item")).alias("code"))
    build.__doc__ = f"{spark_fix.__doc__.splitlines()[0]} Over every candidate row."
    return build


_fixer_query("n1_fix_angr", FX.fix_angr, SQL_FIX["angr"])
_fixer_query("n2_fix_binja", FX.fix_binja, SQL_FIX["binja"])
_fixer_query("n3_fix_dewolf", FX.fix_dewolf, SQL_FIX["dewolf"])
_fixer_query("n4_fix_ghidra", FX.fix_ghidra, SQL_FIX["ghidra"])
_fixer_query("n5_fix_hexrays", FX.fix_hexrays, SQL_FIX["hexrays"])
_fixer_query("n6_fix_reko", FX.fix_reko, SQL_FIX["reko"])
_fixer_query("n7_fix_retdec", FX.fix_retdec, retdec_sql)


@register("n8_fix_llm", sql=f"with {fx.CANDIDATE_CODE_RICH_SQL} select * from ("
          + llm_sql("rich", FX.LLM_DECLARATION) + ")")
def n8_fix_llm(spark, sf_dir):
    """LLM-family fixer: drop leading declarations, rename the implemented function."""
    r = fx.candidate_code_rich(spark, sf_dir)
    return r.select("task_id", FX.fix_llm(F.col("code"), F.col("item")).alias("code"))


@register("n9_fix_llm_star", sql=f"with {fx.CANDIDATE_CODE_RICH_SQL} select * from ("
          + llm_sql("rich", FX.LLM_DECLARATION_STAR) + ")")
def n9_fix_llm_star(spark, sf_dir):
    """As n8 with pointer-returning declarations also dropped."""
    r = fx.candidate_code_rich(spark, sf_dir)
    return r.select("task_id", FX.fix_llm_star(F.col("code"), F.col("item")).alias("code"))


@register("n1_fix_angr_simple", sql=f"with {fx.CANDIDATE_CODE_SQL} select task_id, "
          f"{SQL_FIX['angr']('code')} code from cand")
def n1_fix_angr_simple(spark, sf_dir):
    """angr fixer over the one-function candidate view."""
    c = fx.candidate_code(spark, sf_dir)
    return c.select("task_id", FX.fix_angr(F.col("code")).alias("code"))


# one system per task, dispatch by a single CASE over the long table
DISPATCH_SYSTEMS = ["angr", "binja", "dewolf", "ghidra", "hexrays", "reko", "retdec", "func",
                    "llm4decompile", "mlm", "claude", "gpt-4o", "unknown"]


def _dispatch_sql():
    n = len(DISPATCH_SYSTEMS)
    sys_case = "case task_id % " + str(n) + " " + " ".join(
        f"when {k} then {q(s)}" for k, s in enumerate(DISPATCH_SYSTEMS)) + " end"
    simple = {"angr": "angr", "binja": "binja", "dewolf": "dewolf", "ghidra": "ghidra",
              "hexrays": "hexrays", "reko": "reko"}
    parts = []
    for s in DISPATCH_SYSTEMS:
        if s in simple:
            parts.append(f"select task_id, {q(s)} system, {SQL_FIX[s]('code')} code from lc where system = {q(s)}")
        elif s == "retdec":
            parts.append(f"select task_id, 'retdec' system, {retdec_sql('code')} code from lc where system = 'retdec'")
        elif s in ("claude", "gpt-4o"):
            decl = FX.LLM_DECLARATION if s == "claude" else FX.LLM_DECLARATION_STAR
            parts.append(f"select task_id, {q(s)} system, code from ("
                         + llm_sql(f"(select * from lc where system = {q(s)})", decl) + ")")
        else:
            parts.append(f"select task_id, system, code from lc where system = {q(s)}")
    return (f"with {fx.CANDIDATE_CODE_RICH_SQL}, lc as (select task_id, item, {sys_case} system, code from rich)\n"
            + "\nunion all\n".join(parts))


@register("u1_apply_fixers", sql=_dispatch_sql())
def u1_apply_fixers(spark, sf_dir):
    """Long candidate table (one system per task), fixer chosen per row by system."""
    r = fx.candidate_code_rich(spark, sf_dir)
    n = len(DISPATCH_SYSTEMS)
    sys_col = F.element_at(F.array(*[F.lit(s) for s in DISPATCH_SYSTEMS]), (F.col("task_id") % n + 1).cast("int"))
    lc = r.withColumn("system", sys_col)
    return lc.select("task_id", "system", FX.apply_fixers("system", "code", "item").alias("code"))


@register("b2_compilable", sql=f"""
with {fx.CANDIDATE_CODE_SQL},
c as (select task_id, case when task_id % 4 = 0 then null when task_id % 4 = 1 then ''
                           when task_id % 4 = 2 then concat(code, 'Failed to decompile the function')
                           else code end code from cand)
select task_id, coalesce(code, '') <> '' and not contains(coalesce(code, ''), 'Failed to decompile the function') eligible
from c""")
def b2_compilable(spark, sf_dir):
    """Eligibility of a candidate: non-empty and no failure marker."""
    c = fx.candidate_code(spark, sf_dir)
    k = F.col("task_id") % 4
    code = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit(""))
            .when(k == 2, F.concat("code", F.lit(FX.FAIL_MARKER))).otherwise(F.col("code")))
    return c.select("task_id", FX.compilable(code).alias("eligible"))


# ---------------------------------------------------------------- stability

_BASELINE_SQL = f"""
with {fx.COVERAGE_TEXTS_SQL},
t as (select item_id, t1, t2, t3, [t1, t2, t3] trials, target from cov
      where t1 is not null and t2 is not null and t3 is not null),
r as (select *, list_position(list_transform(trials, lambda x: length(x) > 0), true) k from t),
v as (select *, case when k > 0 then trials[k] else '' end base from r),
ok as (select * from v
       where len(list_filter(case when k > 0 then trials[k:] else trials end,
                             lambda x: length(x) <> length(base))) = 0),
p as (select item_id, target, base, length(base) base_len,
             len(list_filter(case when k > 0 then trials[k:] else trials end, lambda x: x <> base)) = 0 all_equal,
             length(t1) l1, length(t2) l2, length(t3) l3,
             string_split(t1, '') c1, string_split(t2, '') c2, string_split(t3, '') c3,
             string_split(base, '') cb, string_split(target, '') ct
      from ok)
"""

_STABLE = "((l1 = 0 or c1[i] = cb[i]) and (l2 = 0 or c2[i] = cb[i]) and (l3 = 0 or c3[i] = cb[i]))"


@register("g5_baseline_stability", sql=_BASELINE_SQL + f"""
select item_id, cast(base_len as int) base_len, all_equal,
       cast(len(list_filter(range(1, base_len + 1), lambda i: {_STABLE})) as int) n_stable from p""")
def g5_baseline_stability(spark, sf_dir):
    """Valid baselines with their length, equality of trials and number of stable positions."""
    prof = ST.baseline_profile(fx.coverage_texts(spark, sf_dir), ["item_id"], ["t1", "t2", "t3"])
    n_stable = ST.stable_count(F.col("base_len"), F.col("all_equal"), F.col("unstable"))
    return prof.select("item_id", "base_len", "all_equal", n_stable.cast("int").alias("n_stable"))


@register("g5_unstable_ranges", sql=_BASELINE_SQL + f""",
u as (select item_id, unnest(list_filter(range(1, base_len + 1), lambda i: not ({_STABLE}))) i from p where not all_equal),
g as (select item_id, i, i - row_number() over (partition by item_id order by i) grp from u)
select item_id, cast(min(i) - 1 as int) "start", cast(max(i) as int) "end" from g group by item_id, grp""")
def g5_unstable_ranges(spark, sf_dir):
    """The ranges of positions on which the trials of a baseline disagree."""
    prof = ST.baseline_profile(fx.coverage_texts(spark, sf_dir), ["item_id"], ["t1", "t2", "t3"])
    return prof.select("item_id", F.explode("unstable").alias("r")).select("item_id", "r.*")


@register("g6_target_diff", sql=_BASELINE_SQL + f"""
select item_id,
       case when target is null then false
            when length(target) > base_len then false
            when length(target) = 0 then true
            else len(list_filter(range(1, length(target) + 1), lambda i: {_STABLE} and ct[i] <> cb[i])) = 0 end passed
from p""")
def g6_target_diff(spark, sf_dir):
    """Target passes iff no stable baseline position differs (prefix compare; longer fails)."""
    cov = fx.coverage_texts(spark, sf_dir)
    prof = ST.baseline_profile(cov, ["item_id"], ["t1", "t2", "t3"])
    out = ST.diff_targets(prof, cov.select("item_id", "target"), ["item_id"])
    return out.select("item_id", "passed")
