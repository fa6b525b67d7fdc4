"""Registered scoring queries over the run-outcome view (F1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from . import fixtures as fx
from .registry import register


@register("g4_cer_rate", sql=f"""
with {fx.RUNS_SQL},
per_item as (
  select suite, item_id, system, variant, bool_and(ok) passed
  from runs where suite is not null and item_id is not null
  group by all),
passes as (select system, variant, sum(cast(passed as bigint)) passes from per_item group by all),
n as (select count(*) items from (select distinct suite, item_id from per_item)),
grid as (select s.system, v.variant from range(12) s(system), range(5) v(variant))
select cast(g.system as int) system, cast(g.variant as int) variant,
       cast(coalesce(p.passes, 0) as bigint) passes, cast(n.items as bigint) items,
       cast(coalesce(p.passes, 0) as double) / n.items rate
from grid g left join passes p on p.system = g.system and p.variant = g.variant cross join n
""")
def g4_cer_rate(spark, sf_dir):
    """Coverage-equivalence rate per (system, variant), zero-filled grid (flagship)."""
    runs = fx.runs(spark, sf_dir)
    grid = scoring.dims_grid(spark, fx.RUN_SYSTEMS, fx.RUN_VARIANTS).select(
        F.col("system").cast("int"), F.col("variant").cast("int"))
    return scoring.cer_rate(runs, grid)


@register("g3_all_pass", sql=f"""
with {fx.RUNS_SQL}
select suite, item_id, system, variant, bool_and(ok) passed from runs group by all
""")
def g3_all_pass(spark, sf_dir):
    """Item passes a (system, variant) iff all probes that reported passed."""
    return scoring.all_pass(fx.runs(spark, sf_dir))


@register("g1_recompile_rate", sql=f"""
with {fx.RUNS_SQL}
select system, variant, avg(coalesce(cast(cast(ok as int) as double), 0.0)) rate, count(*) n
from runs group by all
""")
def g1_recompile_rate(spark, sf_dir):
    """Mean 0/1 compile flag per (system, variant)."""
    flags = fx.runs(spark, sf_dir).withColumn("flag", F.col("ok").cast("int"))
    return scoring.recompile_rate(flags)


@register("g15_distinct_suites", sql="""
select distinct source suite from documents where source is not null
""")
def g15_distinct_suites(spark, sf_dir):
    """Distinct suites of the item table."""
    return scoring.distinct_suites(fx.items(spark, sf_dir))


@register("j12_missing_outcome", sql=f"""
with {fx.RUNS_SQL},
outc as (select system, variant, suite, item_id, bool_and(ok) ok from runs group by all),
grid as (select i.suite, i.item_id, s.system, v.variant
         from (select distinct suite, item_id from runs) i, range(12) s(system), range(5) v(variant))
select g.suite, g.item_id, cast(g.system as int) system, cast(g.variant as int) variant,
       coalesce(o.ok, false) ok
from grid g left join outc o
  on o.suite = g.suite and o.item_id = g.item_id and o.system = g.system and o.variant = g.variant
""")
def j12_missing_outcome(spark, sf_dir):
    """Item x system x variant grid: a cell without any outcome is a failure; tested cells keep theirs."""
    return scoring.complete_outcomes(fx.runs(spark, sf_dir), ["suite", "item_id"], fx.RUN_SYSTEMS, fx.RUN_VARIANTS)
