"""Registered grid / candidate queries: J1, J3-J5, J8-J11, B4-B7, A9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import done_sets as DS
from ..operators import grids as G
from ..session import scratch_path
from ..sources.tables import read_table
from . import fixtures as fx
from .registry import register

VARIANTS = fx.VARIANTS
# fixed values: the configured systems
SYSTEMS = ["angr", "binja", "dewolf", "ghidra", "hexrays", "mlm", "retdec", "llm4decompile",
           "qwen", "deepseek", "gpt-4o-mini", "gpt-4o", "claude", "func"]

_GRID_SQL = f"""{fx.ITEMS_SQL},
grid as (
  select i.item_id, i.suite, i.item, v.variant, v.ord, i.item_id * 5 + v.ord task_id,
         concat('task-', i.suite, '_', i.item, '-', v.variant, '.so') path
  from items i cross join (values ('O0',0),('O1',1),('O2',2),('O3',3),('Os',4)) as v(variant, ord))"""


def _grid(spark, sf_dir):
    return G.task_grid(fx.items(spark, sf_dir), VARIANTS)


@register("j3_task_grid", sql=f"with {_GRID_SQL} select * from grid")
def j3_task_grid(spark, sf_dir):
    """Item x variant task grid with dense task ids and artifact paths."""
    return _grid(spark, sf_dir)


@register("b7_parse_path", sql=f"""
with {_GRID_SQL},
p as (select task_id, case when task_id % 4 = 0 then concat('/out/x/', path, '.strip') else path end p from grid)
select task_id,
       case when regexp_matches(p, '^task-([^_]+)_(.*)-(O\\w).so') then regexp_extract(p, '^task-([^_]+)_(.*)-(O\\w).so', 1) end suite,
       case when regexp_matches(p, '^task-([^_]+)_(.*)-(O\\w).so') then regexp_extract(p, '^task-([^_]+)_(.*)-(O\\w).so', 2) end item,
       case when regexp_matches(p, '^task-([^_]+)_(.*)-(O\\w).so') then
            regexp_extract(p, '^task-([^_]+)_(.*)-(O\\w).so', 3) || case when ends_with(p, '.strip') then '.strip' else '' end end variant,
       regexp_matches(p, '^task-([^_]+)_(.*)-(O\\w).so') matched
from (select task_id, regexp_extract(p, '([^/]*)$', 1) p from p)
""")
def b7_parse_path(spark, sf_dir):
    """Parse suite, item and variant back out of artifact paths (some with a .strip suffix)."""
    g = _grid(spark, sf_dir)
    p = F.when(F.col("task_id") % 4 == 0, F.concat(F.lit("/out/x/"), "path", F.lit(".strip"))).otherwise(F.col("path"))
    return g.select("task_id", G.parse_artifact_path(p).alias("p")).select("task_id", "p.*")


@register("j4_prefix_retention", sql=f"""
with {_GRID_SQL},
o as (select g.*, (length(d.text) + g.ord) % 6 <> 0 ok from grid g join documents d on d.doc_id = g.item_id),
f as (select item_id, min(case when not ok then ord end) ff from o group by item_id)
select o.task_id, o.item_id, o.variant, o.ok from o join f using (item_id) where ff is null or ord < ff
""")
def j4_prefix_retention(spark, sf_dir):
    """A compile failure drops the item's later variants and keeps the earlier ones."""
    d = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("suite"),
        F.concat(F.lit("fn_"), F.col("doc_id").cast("string")).alias("item"), F.length("text").alias("size"))
    g = G.task_grid(d, VARIANTS).withColumn("ok", (F.col("size") + F.col("ord")) % 6 != 0)
    return G.keep_before_first_failure(g, ["item_id"]).select("task_id", "item_id", "variant", "ok")


_SYS_VALUES = ", ".join(f"('{s}')" for s in SYSTEMS)


@register("j5_request_grid", sql=f"""
with {_GRID_SQL}
select g.task_id, s.system, g.path from grid g cross join (values {_SYS_VALUES}) as s(system)
""")
def j5_request_grid(spark, sf_dir):
    """One decompile request per (system, task)."""
    return G.request_grid(_grid(spark, sf_dir), SYSTEMS).select("task_id", "system", "path")


# results log: events as (task, system, seq, result); later entries overwrite earlier ones
_RES_SYSTEMS = ["angr", "ghidra", "hexrays", "retdec", "claude"]
_RESULTS_SQL = """results as (
  select user_id task_id, ['angr','ghidra','hexrays','retdec','claude'][event_id % 5 + 1] system,
         event_id seq, concat(event_type, ':', props) result
  from events)"""


def _results(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    sysc = F.element_at(F.array(*[F.lit(s) for s in _RES_SYSTEMS]), (F.col("event_id") % 5 + 1).cast("int"))
    return ev.select(F.col("user_id").alias("task_id"), sysc.alias("system"), F.col("event_id").alias("seq"),
                     F.concat("event_type", F.lit(":"), "props").alias("result"))


@register("j10_pivot_results", sql=f"""
with {_RESULTS_SQL}
select task_id, {", ".join(f"arg_max(result, seq) filter (where system = '{s}') \"{s}\"" for s in _RES_SYSTEMS)}
from results group by task_id
""")
def j10_pivot_results(spark, sf_dir):
    """Results pivoted to one column per configured system; the later entry wins."""
    return G.pivot_results(_results(spark, sf_dir), _RES_SYSTEMS)


@register("j11_unpivot", sql=f"""
with {_RESULTS_SQL},
w as (select task_id, {", ".join(f"arg_max(result, seq) filter (where system = '{s}') \"{s}\"" for s in _RES_SYSTEMS)}
      from results group by task_id)
select task_id, system, code from w unpivot include nulls (code for system in ({", ".join(f'"{s}"' for s in _RES_SYSTEMS if s != "claude")}))
""")
def j11_unpivot(spark, sf_dir):
    """Wide candidates back to long; only configured systems that exist are visited."""
    wide = G.pivot_results(_results(spark, sf_dir), _RES_SYSTEMS)
    configured = ["angr", "binja", "ghidra", "hexrays", "retdec", "mlm"]  # binja, mlm absent
    return G.unpivot_candidates(wide, ["task_id"], configured)


@register("b4_refine_candidates", sql=f"""
with {_RESULTS_SQL},
w as (select task_id, arg_max(result, seq) filter (where system = 'hexrays') hexrays,
             arg_max(result, seq) filter (where system = 'ghidra') ghidra
      from results group by task_id)
select task_id, ghidra code from w where ghidra is not null and ghidra <> ''
""")
def b4_refine_candidates(spark, sf_dir):
    """Inputs of a refining model: ghidra output for llm4decompile-family models."""
    wide = G.pivot_results(_results(spark, sf_dir), _RES_SYSTEMS)
    return G.refine_candidates(wide, "LLM4Decompile-Ref")


_CANDS_SQL = """cands as (
  select doc_id * 5 + doc_id % 5 task_id, 'hexrays' system, concat('h0:', doc_id) code, 0 source_rank from documents
  union all
  select doc_id * 5 + doc_id % 3, 'hexrays', concat('h1:', doc_id), 1 from documents
  union all
  select doc_id * 5 + doc_id % 3, 'ghidra', concat('g1:', doc_id), 1 from documents)"""


def _cands(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return (d.select((i * 5 + i % 5).alias("task_id"), F.lit("hexrays").alias("system"),
                     F.concat(F.lit("h0:"), i.cast("string")).alias("code"), F.lit(0).alias("source_rank"))
            .unionByName(d.select((i * 5 + i % 3).alias("task_id"), F.lit("hexrays").alias("system"),
                                  F.concat(F.lit("h1:"), i.cast("string")).alias("code"),
                                  F.lit(1).alias("source_rank")))
            .unionByName(d.select((i * 5 + i % 3).alias("task_id"), F.lit("ghidra").alias("system"),
                                  F.concat(F.lit("g1:"), i.cast("string")).alias("code"),
                                  F.lit(1).alias("source_rank"))))


@register("j1_merge_candidates", sql=f"""
with {_GRID_SQL}, {_CANDS_SQL},
c as (select task_id, system, arg_min(code, source_rank) code from cands group by all)
select g.task_id, g.variant, c.system, c.code from grid g left join c using (task_id)
""")
def j1_merge_candidates(spark, sf_dir):
    """Long candidates joined to the task grid by key; the first source wins per system."""
    m = G.merge_candidates(_grid(spark, sf_dir), _cands(spark, sf_dir))
    return m.select("task_id", "variant", "system", "code")


_DONE_SQL = """done as (
  select event_id % (select count(*) * 5 from documents) task_id, case when event_type = 'error' then null else props end code from events
  where event_type in ('click', 'error', 'view'))"""


def _done(spark, sf_dir):
    n_tasks = max(1, read_table(spark, sf_dir, "documents").count() * len(fx.VARIANTS))  # the size of the grid
    ev = read_table(spark, sf_dir, "events")
    ev = ev.filter(F.col("event_type").isin("click", "error", "view"))
    return ev.select((F.col("event_id") % n_tasks).alias("task_id"),
                     F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("props")).alias("code"))


@register("j8_pending", sql=f"""
with {_GRID_SQL}, {_DONE_SQL}
select task_id from grid where task_id not in (select task_id from done)
""")
def j8_pending(spark, sf_dir):
    """Tasks not in the output yet; ERROR rows count as done (never retried)."""
    return G.pending(_grid(spark, sf_dir), _done(spark, sf_dir)).select("task_id")


@register("j8_pending_retry_errors", sql=f"""
with {_GRID_SQL}, {_DONE_SQL},
stored as (select task_id, coalesce(nullif(code, ''), 'ERROR') code from done)
select task_id from grid where task_id not in (select task_id from stored where code <> 'ERROR')
""")
def j8_pending_retry_errors(spark, sf_dir):
    """Resume with the retry option: stored ERROR rows are pending again."""
    stored = _done(spark, sf_dir).withColumn("code", G.error_or_code("code"))
    return G.pending(_grid(spark, sf_dir), stored, retry_errors=True).select("task_id")


def _done_batches(spark, sf_dir, key, results, ok=None):
    """A done set filled by four result batches, one of them twice, and compacted in between."""
    path = scratch_path(spark, "done-set")
    part = F.pmod(F.xxhash64(key), F.lit(4))
    for batch in (0, 1, 1, 2, 3):
        DS.add_results(spark, path, results.filter(part == batch), batch, key, ok)
        if batch == 2:
            DS.done_set(spark, path).compact()
    return DS.done_set(spark, path).current()


@register("j8_pending_from_bitmaps", sql=f"""
with {_GRID_SQL}, {_DONE_SQL},
stored as (select task_id, coalesce(nullif(code, ''), 'ERROR') code from done)
select task_id, task_id not in (select task_id from done) first_run from grid
where task_id not in (select task_id from stored where code <> 'ERROR')
""")
def j8_pending_from_bitmaps(spark, sf_dir):
    """Resume from bitmaps of done ids, appended with each result batch: tasks without an ok result, and whether they ever ran."""
    stored = _done(spark, sf_dir).withColumn("code", G.error_or_code("code"))
    done = _done_batches(spark, sf_dir, "task_id", stored, F.col("code") != "ERROR")
    grid = _grid(spark, sf_dir).select("task_id")
    again = DS.pending(grid, done, retry_errors=True)
    ran = DS.pending(again, done).withColumn("first_run", F.lit(True))
    return again.join(ran, "task_id", "left").select("task_id", F.coalesce("first_run", F.lit(False)).alias("first_run"))


@register("j9_pending_chunks_from_bitmaps", sql=f"""
with {_GRID_SQL},
chunks as (select distinct task_id // 100 chunk_id from grid),
res as (select user_id * 3 chunk_id from events)
select chunk_id from chunks where chunk_id not in (select chunk_id from res)
""")
def j9_pending_chunks_from_bitmaps(spark, sf_dir):
    """Chunks to run, from bitmaps of the chunks that have stored rows."""
    chunks = _grid(spark, sf_dir).select(F.floor(F.col("task_id") / 100).cast("bigint").alias("chunk_id")).distinct()
    res = read_table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("chunk_id"))
    return DS.pending(chunks, _done_batches(spark, sf_dir, "chunk_id", res), "chunk_id")


@register("a9_stored_results", sql=f"""
with {_DONE_SQL}
select task_id, coalesce(nullif(code, ''), 'ERROR') code from done
""")
def a9_stored_results(spark, sf_dir):
    """Result rows as stored by the append sink: a failed result is ERROR."""
    return _done(spark, sf_dir).select("task_id", G.error_or_code("code").alias("code"))


@register("j9_pending_chunks", sql=f"""
with {_GRID_SQL},
chunks as (select distinct task_id // 100 chunk_id from grid),
res as (select user_id * 3 chunk_id from events)
select chunk_id from chunks where chunk_id not in (select chunk_id from res)
""")
def j9_pending_chunks(spark, sf_dir):
    """Chunks with no stored result rows are run (again)."""
    chunks = _grid(spark, sf_dir).select(F.floor(F.col("task_id") / 100).cast("bigint").alias("chunk_id")).distinct()
    res = read_table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("chunk_id"))
    return G.pending_chunks(chunks, res)


@register("b5_range_slice", sql=f"""
with {_GRID_SQL}
select task_id, path from grid where task_id >= 1 * 700 and task_id < least(1 * 700 + 700, (select count(*) from grid))
""")
def b5_range_slice(spark, sf_dir):
    """Slice 1 of size 700 of the dense task ids (the slice is the feature)."""
    g = _grid(spark, sf_dir)
    n = g.count()
    return G.range_slice(g, 1, 700, n).select("task_id", "path")
