"""Adapter views: evaluation-shaped data derived from the given test tables.

Each view has a Spark builder (DataFrame API over the parquet tables) and the
same view as DuckDB SQL text, used as a CTE by the oracles. All are row-wise
projections (no shuffle); their size grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

VARIANTS = ["O0", "O1", "O2", "O3", "Os"]

# ---------------------------------------------------------------- F1 runs
# One row per (suite, item, probe, variant, system) test outcome.


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 5).cast("int").alias("suite"),
        F.col("l_partkey").cast("bigint").alias("item_id"),
        (F.col("l_orderkey") % 3).cast("int").alias("probe"),
        (F.col("l_linenumber") % 5).cast("int").alias("variant"),
        (F.col("l_suppkey") % 12).cast("int").alias("system"),
        ((F.col("l_returnflag") != "R") | (F.col("l_discount") < 0.08)).alias("ok"),
    )


RUNS_SQL = """runs as (
  select cast(l_suppkey % 5 as int) suite, cast(l_partkey as bigint) item_id,
         cast(l_orderkey % 3 as int) probe, cast(l_linenumber % 5 as int) variant,
         cast(l_suppkey % 12 as int) system, l_returnflag <> 'R' or l_discount < 0.08 ok
  from lineitem)"""

# run-config dimensions of F1: 12 systems x 5 variants (config-sized, broadcast)
RUN_SYSTEMS = list(range(12))
RUN_VARIANTS = list(range(5))

# ---------------------------------------------------------------- F2e battles
# Ordered battles (battle_id unique), winner in {model_a, model_b, tie}.


def battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    u = (F.col("user_id") % 12).cast("int")
    return ev.select(
        F.col("event_id").alias("battle_id"),
        F.concat(F.lit("s"), u.cast("string")).alias("model_a"),
        F.concat(F.lit("s"), ((u + 1 + F.col("event_id") % 11) % 12).cast("int").cast("string")).alias("model_b"),
        F.concat(F.lit("asp"), (F.floor("value").cast("bigint") % 12).cast("string")).alias("aspect"),
        F.when(F.col("event_type").isin("purchase", "click"), "model_a")
         .when(F.col("event_type") == "error", "tie").otherwise("model_b").alias("winner"),
    )


BATTLES_SQL = """battles as (
  select event_id battle_id, concat('s', cast(user_id % 12 as int)) model_a,
         concat('s', cast((user_id % 12 + 1 + event_id % 11) % 12 as int)) model_b,
         concat('asp', cast(floor(value) as bigint) % 12) aspect,
         case when event_type in ('purchase','click') then 'model_a'
              when event_type = 'error' then 'tie' else 'model_b' end winner
  from events)"""

# ---------------------------------------------------------------- F2 bulk battles
# Many battles over 12 systems; winner code A (a wins), R (b wins), N (tie).


def bulk_battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    a = (F.col("l_suppkey") % 12).cast("int")
    b = (F.col("l_partkey") % 12).cast("int")
    return (li.filter(a != b).select(
        F.concat(F.lit("s"), a.cast("string")).alias("model_a"),
        F.concat(F.lit("s"), b.cast("string")).alias("model_b"),
        F.concat(F.lit("asp"), (F.col("l_orderkey") % 12).cast("string")).alias("aspect"),
        F.when(F.col("l_returnflag") == "A", "model_a")
         .when(F.col("l_returnflag") == "R", "model_b").otherwise("tie").alias("winner")))


BULK_BATTLES_SQL = """battles as (
  select concat('s', cast(l_suppkey % 12 as int)) model_a,
         concat('s', cast(l_partkey % 12 as int)) model_b,
         concat('asp', l_orderkey % 12) aspect,
         case l_returnflag when 'A' then 'model_a' when 'R' then 'model_b' else 'tie' end winner
  from lineitem where l_suppkey % 12 <> l_partkey % 12)"""

# ---------------------------------------------------------------- F3 task grid


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.col("source").alias("suite"),
                    F.concat(F.lit("fn_"), F.col("doc_id").cast("string")).alias("item"))


ITEMS_SQL = """items as (
  select doc_id item_id, source suite, concat('fn_', doc_id) item from documents)"""

# ---------------------------------------------------------------- F4 candidate code


def candidate_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    nl = F.lit("\n")
    return d.select(
        i.alias("task_id"),
        F.concat(F.lit("int sub_"), F.lower(F.hex(i + 4096)), F.lit("(int a1@<eax>, int out."),
                 (i % 7).cast("string"), F.lit(")"), nl, F.lit("{"), nl,
                 F.lit("  v["), (i % 9).cast("string"), F.lit("] = field_-"), (i % 5).cast("string"),
                 F.lit(";"), nl, F.lit("  sub_"), F.lower(F.hex(i + 8192)), F.lit("();"), nl,
                 F.lit("}"), nl, F.col("text")).alias("code"))


CANDIDATE_CODE_SQL = """cand as (
  select doc_id task_id,
         concat('int sub_', lower(hex(doc_id + 4096)), '(int a1@<eax>, int out.', doc_id % 7, ')', chr(10),
                '{', chr(10), '  v[', doc_id % 9, '] = field_-', doc_id % 5, ';', chr(10),
                '  sub_', lower(hex(doc_id + 8192)), '();', chr(10), '}', chr(10), text) code
  from documents)"""

# ---------------------------------------------------------------- F5 coverage texts
# Whole documents as coverage texts: three baseline trials (the third one
# unstable at position 11 for every 5th item, at many places more for every 10th, one character too long for every
# 11th) and a target that is changed at a stable or later position, one
# character short, one character long, empty, or equal.


def coverage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    i, t = F.col("doc_id"), F.col("text")
    n = F.length(t)

    def put(pos: int, ch: str) -> Column:
        return F.concat(F.substring(t, 1, pos - 1), F.lit(ch), F.substring(t, pos + 1, 1 << 30))

    return d.select(
        i.alias("item_id"), t.alias("t1"), t.alias("t2"),
        F.when(i % 10 == 0, F.replace(put(11, "#"), F.lit("an"), F.lit("##")))
         .when(i % 5 == 0, put(11, "#")).when(i % 11 == 0, F.concat(t, F.lit("x"))).otherwise(t).alias("t3"),
        F.when(i % 7 == 0, put(11, "@"))
         .when(i % 7 == 1, F.substring(t, 1, n - 1))
         .when(i % 7 == 2, F.concat(t, F.lit("z")))
         .when(i % 7 == 3, put(61, "@"))
         .when(i % 7 == 4, F.lit("")).otherwise(t).alias("target"))


COVERAGE_TEXTS_SQL = """cov as (
  select doc_id item_id, text t1, text t2,
         case when doc_id % 10 = 0 then replace(concat(substring(text, 1, 10), '#', substring(text, 12)), 'an', '##')
              when doc_id % 5 = 0 then concat(substring(text, 1, 10), '#', substring(text, 12))
              when doc_id % 11 = 0 then concat(text, 'x') else text end t3,
         case when doc_id % 7 = 0 then concat(substring(text, 1, 10), '@', substring(text, 12))
              when doc_id % 7 = 1 then substring(text, 1, length(text) - 1)
              when doc_id % 7 = 2 then concat(text, 'z')
              when doc_id % 7 = 3 then concat(substring(text, 1, 60), '@', substring(text, 62))
              when doc_id % 7 = 4 then '' else text end target
  from documents)"""

# ---------------------------------------------------------------- F6 judge replies


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    e = F.col("event_id")
    nl = F.lit("\n")
    w = (F.when(F.col("event_type") == "purchase", "A").when(F.col("event_type") == "click", "a")
         .when(F.col("event_type") == "view", "B").when(F.col("event_type") == "error", "Tie")
         .otherwise(""))
    return ev.select(
        e.alias("battle_id"),
        F.concat(F.lit("Reasoning."), nl, F.lit("```json"), nl,
                 F.lit('{"Readability": {"asp'), (e % 12).cast("string"), F.lit('": {"A_score": '),
                 (e % 3 - 1).cast("string"), F.lit(', "B_score": 0, "winner": "'), w,
                 F.lit('"}}}'), nl, F.lit("```")).alias("raw"))


JUDGE_REPLIES_SQL = """replies as (
  select event_id battle_id,
         concat('Reasoning.', chr(10), '```json', chr(10),
                '{"Readability": {"asp', event_id % 12, '": {"A_score": ', event_id % 3 - 1,
                ', "B_score": 0, "winner": "',
                case event_type when 'purchase' then 'A' when 'click' then 'a'
                     when 'view' then 'B' when 'error' then 'Tie' else '' end,
                '"}}}', chr(10), '```') raw
  from events)"""

# ---------------------------------------------------------------- F7 coverage export (flat)


def coverage_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.when(s % 9 == 0, "ns::").otherwise(""),
                    F.when(k % 50 == 0, "LLVMFuzzerTestOneInput")
                     .otherwise(F.concat(F.lit("fn_"), (k % 700).cast("string"))))
    f0 = F.concat(F.lit("/src/suite"), (k % 4).cast("string"), F.lit("/"),
                  F.when(s % 7 == 0, "probe").otherwise("lib"), (k % 3).cast("string"),
                  F.when(s % 5 == 0, ".h").otherwise(".c"))
    f1 = F.concat(F.lit("/src/suite"), (k % 3).cast("string"), F.lit("/x.c"))
    return p.select(k.alias("id"), name.alias("name"), f0.alias("f0"), f1.alias("f1"),
                    s.alias("cnt"), F.concat(F.lit("suite"), (k % 4).cast("string")).alias("suite"),
                    F.concat(F.lit("probe"), (k % 3).cast("string")).alias("probe"))


COVERAGE_EXPORT_SQL = """cx as (
  select p_partkey id,
         concat(case when p_size % 9 = 0 then 'ns::' else '' end,
                case when p_partkey % 50 = 0 then 'LLVMFuzzerTestOneInput'
                     else concat('fn_', p_partkey % 700) end) name,
         concat('/src/suite', p_partkey % 4, '/', case when p_size % 7 = 0 then 'probe' else 'lib' end,
                p_partkey % 3, case when p_size % 5 = 0 then '.h' else '.c' end) f0,
         concat('/src/suite', p_partkey % 3, '/x.c') f1,
         p_size cnt, concat('suite', p_partkey % 4) suite, concat('probe', p_partkey % 3) probe
  from part)"""

# ---------------------------------------------------------------- F8 status log


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    raw = (F.when(et == "purchase", 'completed:{"0x1": "int f"}')
           .when(et == "click", "completed:not json").when(et == "view", "processing: q")
           .when(et == "error", "failed:boom").otherwise("error: broker"))
    return ev.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), raw.alias("raw"))


STATUS_LOG_SQL = """slog as (
  select user_id task_id, event_id seq,
         case event_type when 'purchase' then 'completed:{"0x1": "int f"}'
              when 'click' then 'completed:not json' when 'view' then 'processing: q'
              when 'error' then 'failed:boom' else 'error: broker' end raw
  from events)"""

# ---------------------------------------------------------------- judgements
# F6 replies with the seating of F2e: the shape of one judge call.


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    # seating and reply are projections of the same events row: one select, no join
    ev = read_table(spark, sf_dir, "events")
    u = (F.col("user_id") % 12).cast("int")
    e = F.col("event_id")
    nl = F.lit("\n")
    w = (F.when(F.col("event_type") == "purchase", "A").when(F.col("event_type") == "click", "a")
         .when(F.col("event_type") == "view", "B").when(F.col("event_type") == "error", "Tie")
         .otherwise(""))
    return ev.select(
        e.alias("battle_id"),
        F.concat(F.lit("s"), u.cast("string")).alias("model_a"),
        F.concat(F.lit("s"), ((u + 1 + e % 11) % 12).cast("int").cast("string")).alias("model_b"),
        F.concat(F.lit("Reasoning."), nl, F.lit("```json"), nl,
                 F.lit('{"Readability": {"asp'), (e % 12).cast("string"), F.lit('": {"A_score": '),
                 (e % 3 - 1).cast("string"), F.lit(', "B_score": 0, "winner": "'), w,
                 F.lit('"}}}'), nl, F.lit("```")).alias("raw"))


JUDGEMENTS_SQL = f"""{BATTLES_SQL},
{JUDGE_REPLIES_SQL},
judgements as (select b.battle_id, b.model_a, b.model_b, r.raw
               from battles b join replies r using (battle_id))"""

# ---------------------------------------------------------------- F4r candidate code, rich
# Several lines per row that exercise every fixer rule (ASCII identifiers so
# Java regex and the RE2 oracle agree). Built from one template for both engines.


def _piece_spark(p):
    i = F.col("doc_id")
    if isinstance(p, str):
        return F.lit(p)
    kind, k = p
    if kind == "mod":
        return (i % k).cast("string")
    if kind == "hex":
        return F.lower(F.hex(i + k))
    if kind == "hexmod":
        return F.lower(F.hex(i % k))
    raise ValueError(kind)


def _piece_sql(p):
    if isinstance(p, str):
        return "'" + p.replace("'", "''") + "'"
    kind, k = p
    if kind == "mod":
        return f"cast(doc_id % {k} as varchar)"
    if kind == "hex":
        return f"lower(hex(doc_id + {k}))"
    if kind == "hexmod":
        return f"lower(hex(doc_id % {k}))"
    raise ValueError(kind)


_COMMON_HEAD = [
    ["#include <stdio.h>"],
    ["int helper_", ("mod", 3), "(int a);"],
    ["char *name_", ("mod", 4), "(int x, int y);"],
    ["  extern int g_", ("mod", 5), ";"],
]
_IMPL = [
    ["int sub_", ("hex", 4096), "(int a1@<eax>, unsigned int v2) {"],
    ["  v3 = truncf(x", ("mod", 4), ", 2.0f) + out.", ("mod", 7), " + field_-", ("mod", 5), "; // 0x",
     ("hexmod", 16), "0"],
    ["  if (cond:", ("mod", 3), ") goto lab_0x", ("hexmod", 16), "0;"],
    ["  if (v3) goto lab_0x", ("hexmod", 16), ";"],
    ["  arr[0x1f] = zx.o(0) + 12f + ", ("mod", 9), "F + nullptr @ zmm0 + vals[", ("mod", 8), "];"],
    ["  (*ptr", ("mod", 2), ") = buf[] + r.u0 + (int128_t)0 + (int512_t)1 + __pure + fn", ("hex", 160), "();"],
    ["  void* fsbase; long in_FS_OFFSET; sub_", ("hex", 8192), "(v3);"],
    ["lab_0x", ("hexmod", 4), "1:"],
    ["  // 0x", ("hexmod", 16)],
    ["}"],
    ["int later_", ("mod", 3), "(int z);"],
    ["static int sub_", ("hex", 99), "(int q) { return q; }"],
]
_NO_IMPL = [
    ["  return sub_", ("hex", 12), "(0); // 0x", ("mod", 10)],
    ["long in_FS_OFFSET;"],
]


def _template(rows):
    out = []
    for k, r in enumerate(rows):
        if k:
            out.append("\n")
        out.extend(r)
    return out


_RICH_A = _template(_COMMON_HEAD + _IMPL)
_RICH_B = _template(_COMMON_HEAD + _NO_IMPL)


def candidate_code_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    a = F.concat(*[_piece_spark(p) for p in _RICH_A])
    b = F.concat(*[_piece_spark(p) for p in _RICH_B])
    return d.select(F.col("doc_id").alias("task_id"),
                    F.concat(F.lit("fn_"), F.col("doc_id").cast("string")).alias("item"),
                    F.concat(F.when(F.col("doc_id") % 6 == 0, b).otherwise(a), F.lit("\n"), F.col("text")).alias("code"),
                    "text")


CANDIDATE_CODE_RICH_SQL = ("rich as (select doc_id task_id, concat('fn_', doc_id) item, "
                           "case when doc_id % 6 = 0 then concat("
                           + ", ".join(_piece_sql(p) if p != "\n" else "chr(10)" for p in _RICH_B)
                           + ") else concat("
                           + ", ".join(_piece_sql(p) if p != "\n" else "chr(10)" for p in _RICH_A)
                           + ") end || chr(10) || text code, text from documents)")

# ---------------------------------------------------------------- F6m multi-entry judge replies
# Two categories, four aspect entries; every 4th reply has an entry without a
# winner in the middle (skipped by the batch explode, cuts the online list).


def _w(code: int):
    return ["A", "a", "B", "Tie", "", "b", "tie"][code % 7]


def judgements_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = battles(spark, sf_dir).select("battle_id", "model_a", "model_b")
    e = F.col("battle_id")
    wn = F.array(*[F.lit(_w(k)) for k in range(7)])

    def asp(k):
        return F.concat(F.lit('"asp'), ((e + k) % 12).cast("string"), F.lit('"'))

    def win(k):
        return F.concat(F.lit('{"winner": "'), F.element_at(wn, ((e + k) % 7 + 1).cast("int")), F.lit('"}'))

    mid = F.when(e % 4 == 0, F.lit('{"A_score": 1}')).otherwise(win(1))
    raw = F.concat(F.lit("```json\n{\"Readability\": {"), asp(0), F.lit(": "), win(0), F.lit(", "),
                   asp(1), F.lit(": "), mid, F.lit(", "), asp(2), F.lit(": "), win(2),
                   F.lit("}, \"Helpfulness\": {"), asp(3), F.lit(": "), win(3), F.lit("}}\n```"))
    return b.select("battle_id", "model_a", "model_b", raw.alias("raw"))


def _wsql(k):
    arr = "[" + ", ".join(f"'{_w(j)}'" for j in range(7)) + "]"
    return f"""concat('{{"winner": "', {arr}[(battle_id + {k}) % 7 + 1], '"}}')"""


def _asql(k):
    return f"""concat('"asp', (battle_id + {k}) % 12, '"')"""


JUDGEMENTS_MULTI_SQL = f"""{BATTLES_SQL},
jm as (select battle_id, model_a, model_b,
  concat('```json', chr(10), '{{"Readability": {{', {_asql(0)}, ': ', {_wsql(0)}, ', ',
         {_asql(1)}, ': ', case when battle_id % 4 = 0 then '{{"A_score": 1}}' else {_wsql(1)} end, ', ',
         {_asql(2)}, ': ', {_wsql(2)}, '}}, "Helpfulness": {{', {_asql(3)}, ': ', {_wsql(3)}, '}}}}',
         chr(10), '```') raw
  from battles)"""

# ---------------------------------------------------------------- F6o odd judge replies
# Shapes of replies that judges really give; ``{a}`` is an aspect. For each: the parse state, the batch battles
# (category, offset of the aspect or its name, winner) and the online ones.
ODD_REPLIES = [
    ('{"R": {"{a}": {"winner": "A"}}, "H": {"x": {"winner": "b"}}}', "parsed",
     [("R", "{a}", "A"), ("H", "x", "b")], [("R", "{a}", "A"), ("H", "x", "b")]),
    ('{"R": {"{a}": {"winner": "A"}}, "summary": "A is better", "H": {"x": {"winner": "B"}}}', "parsed",
     [("R", "{a}", "A"), ("H", "x", "B")], [("R", "{a}", "A")]),
    ('{"R": {"{a}": {"winner": "A"}, "t": "oops", "u": {"winner": "B"}}, "H": {"x": {"winner": "Tie"}}}', "parsed",
     [("R", "{a}", "A"), ("H", "x", "Tie")], [("R", "{a}", "A")]),
    ('{"overall": {"winner": "A"}, "H": {"{a}": {"winner": "a"}}}', "parsed", [("H", "{a}", "a")], []),
    ('{"R": {"{a}": {"winner": 3}, "t": {"winner": "B"}}, "H": {"x": {"winner": "B"}}}', "parsed",
     [("H", "x", "B")], [("R", "{a}", "3"), ("R", "t", "B"), ("H", "x", "B")]),
    ('{"R": {"{a}": {"winner": null}, "t": {"score": 1}, "u": {"winner": "A"}}}', "parsed",
     [("R", "{a}", None), ("R", "u", "A")], [("R", "{a}", None)]),
    ('text first ```json\n{"R": {"{a}": {"A_score": +1, "winner": "A",},},} // note\n``` text after', "parsed",
     [("R", "{a}", "A")], [("R", "{a}", "A")]),
    ("```\n{R: {'{a}': {winner: 'B'}}}\n```", "parsed", [("R", "{a}", "B")], [("R", "{a}", "B")]),
    ('```json\n{"R": {"{a}": {"winner": "A"}', "rejected", [], []),
    ('[{"R": {"{a}": {"winner": "A"}}}]', "no_object", [], []),
    ("I cannot judge {a}.", "rejected", [], []),
    ('{"R": {"{a}": {"winner": true}}, "H": {}, "Z": {"y": {"winner": ""}}}', "parsed",
     [("Z", "y", "")], [("R", "{a}", "true"), ("Z", "y", "")]),
]


def judgements_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = battles(spark, sf_dir).select("battle_id", "model_a", "model_b")
    k = F.col("battle_id") % len(ODD_REPLIES)
    raw = F.element_at(F.array(*[F.lit(r[0]) for r in ODD_REPLIES]), (k + 1).cast("int"))
    aspect = F.concat(F.lit("asp"), (F.col("battle_id") % 7).cast("string"))
    return b.withColumn("raw", F.replace(raw, F.lit("{a}"), aspect))


def _odd_rows(which: int) -> str:
    quote = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    rows = [(k, p, *e) for k, r in enumerate(ODD_REPLIES) for p, e in enumerate(r[which])]
    return "(values " + ", ".join(f"({k}, {p}, {quote(c)}, {quote(a)}, {quote(w)})" for k, p, c, a, w in rows) + ")"


ODD_STATES_SQL = "(values " + ", ".join(f"({k}, '{r[1]}')" for k, r in enumerate(ODD_REPLIES)) + ") s(k, parse_state)"
ODD_BATTLES_SQL = (f"""odd as (select battle_id, model_a, model_b, e.p entry_pos, e.c category,
  replace(e.a, '{{a}}', 'asp' || (battle_id % 7)) aspect, e.w winner_raw
  from battles join ROWS e(k, p, c, a, w) on e.k = battle_id % {len(ODD_REPLIES)})""")
ODD_BATCH_SQL = f"{BATTLES_SQL}, {ODD_BATTLES_SQL.replace('ROWS', _odd_rows(2))}"
ODD_ONLINE_SQL = f"{BATTLES_SQL}, {ODD_BATTLES_SQL.replace('ROWS', _odd_rows(3))}"

# ---------------------------------------------------------------- F6c judge replies that are cut off
# Three entries in two categories; every reply is cut at a place of its own (some not at all). Half of them lack the commas, a third
# has hexadecimal scores, a fifth stands in a fence. The text below is valid in both engines.


def _cut_word(k: int) -> str:
    return f"case (event_id + {k}) % 5 when 0 then 'A' when 1 then 'b' when 2 then 'Tie' when 3 then '' else 'B' end"


def _cut_aspect(k: int) -> str:
    return f"concat('asp', cast((event_id + {k}) % 12 as string))"


_CUT_SEP = "case when event_id % 2 = 0 then ' ' else ', ' end"
_CUT_OPEN = "'{\"Readability\": {'"


def _cut_head(k: int) -> str:
    return (f"concat('\"', {_cut_aspect(k)}, '\": {{\"A_score\": ', case when event_id % 3 = 0 then '0x1F' else '2' end, "
            f"{_CUT_SEP}, '\"winner\": \"')")


_CUT_BEFORE = [f"concat({_CUT_OPEN}, {_cut_head(0)})",
               f"concat({_cut_word(0)}, '\"}}', {_CUT_SEP}, {_cut_head(1)})",
               f"concat({_cut_word(1)}, '\"}}}}', {_CUT_SEP}, '\"Helpfulness\": {{', {_cut_head(2)})"]
_CUT_WHOLE = f"concat({', '.join(_CUT_BEFORE)}, {_cut_word(2)}, '\"}}}}}}')"
CUT_COLUMNS = ["event_id", "user_id", f"{_CUT_WHOLE} as whole",
               f"(event_id * 31 + user_id) % (length({_CUT_WHOLE}) + 1) as cut"]
CUT_RAW = ("case when event_id % 5 = 0 then concat('Reasons.', chr(10), '```json', chr(10), substring(whole, 1, cast(cut as int)), "
           "chr(10), '```') else substring(whole, 1, cast(cut as int)) end")


def judgements_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").selectExpr(*CUT_COLUMNS)
    u = (F.col("user_id") % 12).cast("int")
    return ev.select(F.col("event_id").alias("battle_id"), F.concat(F.lit("s"), u.cast("string")).alias("model_a"),
                     F.concat(F.lit("s"), ((u + 1 + F.col("event_id") % 11) % 12).cast("int").cast("string")).alias("model_b"),
                     F.expr(CUT_RAW).alias("raw"))


# what a cut leaves: the state, and the entries whose winner's text has begun, with as much of it as there is
CUT_SQL = f"""{BATTLES_SQL},
cuts as (select {', '.join(CUT_COLUMNS)} from events),
cut_states as (select event_id battle_id, case when cut = 0 then 'rejected' when cut < length({_CUT_OPEN}) then 'no_object'
                      else 'parsed' end parse_state from cuts),
cut_entries as (
  {" union all ".join(f"""select event_id battle_id, {k} entry_pos, '{c}' category, {_cut_aspect(k)} aspect, {_cut_word(k)} word,
    cut - ({" + ".join(f"length({b})" for b in _CUT_BEFORE[:k + 1])}) left_ from cuts""" for k, c in
    enumerate(["Readability", "Readability", "Helpfulness"]))}),
cut_battles as (select battle_id, model_a, model_b, entry_pos, category, cut_entries.aspect, substring(word, 1, cast(left_ as int)) winner_raw
                from cut_entries join battles using (battle_id) where left_ >= 0)"""
