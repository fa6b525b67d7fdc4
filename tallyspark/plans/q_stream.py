"""Registered status and streaming queries: B17, S1 (batch + stream), A8, S2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rating as R
from ..operators import status as ST
from ..session import scratch_path
from ..sources.tables import read_table
from ..streaming import ratings_stream as RS
from ..streaming import status_stream as SS
from ..streaming import task_limits as TL
from . import fixtures as fx
from .registry import register

FILE_ROWS = 250_000  # rows of a file that a stream reads at once

_DECODE_SQL = """
dec as (
  select task_id, seq, raw,
    case when raw is null or raw = '' then 'completed'
         when starts_with(raw, 'completed:') then 'completed'
         when starts_with(raw, 'error:') then 'error'
         when starts_with(raw, 'processing:') then 'processing'
         when starts_with(raw, 'failed:') then 'error' end status,
    case when raw is null or raw = '' then 'Task not found'
         when starts_with(raw, 'completed:') then trim(substring(raw, 11))
         when starts_with(raw, 'error:') then trim(substring(raw, 7))
         when starts_with(raw, 'failed:') then substring(raw, 8) end result
  from src)"""


@register("b17_decode_status", sql=f"""
with {fx.STATUS_LOG_SQL}, src as (select * from slog), {_DECODE_SQL}
select task_id, seq, status, result from dec
""")
def b17_decode_status(spark, sf_dir):
    """Decode every stored status value into (status, result)."""
    log = fx.status_log(spark, sf_dir)
    return log.select("task_id", "seq", ST.decode_status("raw").alias("s")).select("task_id", "seq", "s.*")


_LATEST_SQL = f"""
with {fx.STATUS_LOG_SQL},
src as (select task_id, max(seq) seq, arg_max(raw, seq) raw from slog group by task_id),
{_DECODE_SQL},
v as (select task_id, status s0, result text,
             case when status = 'completed' and json_valid(result) and json_type(result::JSON) = 'OBJECT'
                  then true else false end ok
      from dec)
"""

_VIEW_SELECT = """
select task_id,
       case when s0 = 'completed' and not ok then 'error' else s0 end status,
       case when s0 = 'completed' and ok then (text::JSON ->> json_keys(text::JSON)[1]) end code,
       case when (case when s0 = 'completed' and not ok then 'error' else s0 end) = 'error' then text end error
from v"""


@register("s1_latest_status", sql=_LATEST_SQL + _VIEW_SELECT)
def s1_latest_status(spark, sf_dir):
    """Client view after the latest poll of every task (completed with bad JSON -> error)."""
    v = ST.latest_status(fx.status_log(spark, sf_dir))
    return v.select("task_id", "status", "code", "error")


@register("s1_latest_status_stream", sql=_LATEST_SQL + _VIEW_SELECT)
def s1_latest_status_stream(spark, sf_dir):
    """Same view maintained by a streaming aggregation over the log arriving in files."""
    log_dir = scratch_path(spark, "status-log")
    fx.status_log(spark, sf_dir).repartitionByRange("seq").write.option("maxRecordsPerFile", FILE_ROWS).parquet(log_dir)
    upd = SS.run_latest_status_stream(spark, log_dir)
    return SS.current_view(spark, upd).select("task_id", "status", "code", "error")


# four entries a task, as events follow each other; a task that is still processing six hours later has run out
_LIMIT, _DELAY = 6 * 3600, 600
_LIMITS_SQL = f"""
with {fx.STATUS_LOG_SQL},
l as (select event_id // 4 task_id, event_id seq, s.raw, epoch_ms(ts) at_ms from events join slog s on s.seq = event_id),
t as (select task_id, max(seq) seq, arg_max(raw, seq) raw, arg_max(at_ms, seq) at_ms from l group by task_id),
src as (select task_id, seq, case when starts_with(raw, 'processing') and at_ms + {_LIMIT * 1000} <= (select max(at_ms) from l) - {_DELAY * 1000}
                                  then 'error:Exceeded time limit' else raw end raw from t),
{_DECODE_SQL},
v as (select task_id, status s0, result text,
             case when status = 'completed' and json_valid(result) and json_type(result::JSON) = 'OBJECT'
                  then true else false end ok
      from dec)
"""


def _timed_log(spark, sf_dir):
    log = fx.status_log(spark, sf_dir)
    at = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return log.join(at, "seq").select(F.floor(F.col("seq") / 4).cast("bigint").alias("task_id"), "seq", "raw", F.col("at").cast("timestamp").alias("at"))


@register("s1_status_with_limits", sql=_LIMITS_SQL + _VIEW_SELECT)
def s1_status_with_limits(spark, sf_dir):
    """Client view in which tasks that never ended are errors (batch)."""
    return TL.latest_with_limit(_timed_log(spark, sf_dir), _LIMIT, _DELAY).select("task_id", "status", "code", "error")


@register("s1_status_with_limits_stream", sql=_LIMITS_SQL + _VIEW_SELECT)
def s1_status_with_limits_stream(spark, sf_dir):
    """The same view from a stream whose state holds open tasks only, with timers and a compacted update table."""
    log_dir = scratch_path(spark, "timed-log")
    _timed_log(spark, sf_dir).repartitionByRange("seq").write.option("maxRecordsPerFile", FILE_ROWS).parquet(log_dir)
    out, _ = TL.run_task_stream(spark, log_dir, limit_seconds=_LIMIT, delay=f"{_DELAY} seconds", files_per_trigger=4, compact_every=2)
    return TL.current_view(spark, out).select("task_id", "status", "code", "error")


@register("a8_completed_results", sql=_LATEST_SQL + """
select task_id, text::JSON ->> json_keys(text::JSON)[1] code from v
where s0 = 'completed' and ok and len(json_keys(text::JSON)) > 0""")
def a8_completed_results(spark, sf_dir):
    """Completed tasks with a non-empty result map and the first value of that map."""
    v = ST.latest_status(fx.status_log(spark, sf_dir))
    return ST.completed_results(v).select("task_id", "code")


@register("s2_incremental_ratings", sql=f"""
with {fx.JUDGEMENTS_SQL},
p as (select battle_id, model_a, model_b,
             trim(regexp_extract(raw, '(?s)```json(.*)```', 1), ' ' || chr(10) || chr(13) || chr(9) || '`')::JSON js
      from judgements),
b as (select model_a, model_b, a.key aspect,
             case when coalesce(a.value ->> 'winner', '') = '' then 'tie'
                  when lower(a.value ->> 'winner') = 'a' then 'model_a'
                  when lower(a.value ->> 'winner') = 'b' then 'model_b' else 'tie' end winner
      from p, json_each(p.js) c, json_each(c.value) a
      where list_contains(json_keys(a.value), 'winner') and model_a <> model_b),
s as (select aspect arena, model_a i, case winner when 'model_a' then 2 when 'model_b' then 0 else 1 end w from b
      union all
      select aspect, model_b, case winner when 'model_b' then 2 when 'model_a' then 0 else 1 end from b),
t as (select coalesce(arena, '(all)') arena, i, sum(w) w from s group by grouping sets ((arena, i), (i)))
select arena, i system, round(cast(w as double), 3) wins from t
""")
def s2_incremental_ratings(spark, sf_dir):
    """Ratings refitted per arriving judgement file; after the last file the fit's expected
    wins equal the observed wins of all battles."""
    jdir = scratch_path(spark, "judgements")
    fx.judgements(spark, sf_dir).repartitionByRange("battle_id").write.option("maxRecordsPerFile", FILE_ROWS).parquet(jdir)
    out = RS.run_incremental_ratings(spark, jdir, aspects=[f"asp{k}" for k in range(12)])
    return R.expected_wins(RS.latest_cells(spark, out), RS.latest_ratings(spark, out))
