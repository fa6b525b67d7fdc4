"""Registered sampling and online-rating queries: Q1-Q5 (and G7 on multi-entry replies)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.uniform import hash_uniform_sql
from ..operators import grids as G
from ..operators import judgements as J
from ..operators import sampling as S
from . import fixtures as fx
from .registry import register

SYSTEMS12 = [f"s{k}" for k in range(12)]
ANCHOR = "s3"

_RATINGS_SQL = f"""{fx.BATTLES_SQL},
pts as (select model_a system, case winner when 'model_a' then 1.0 when 'model_b' then 0.0 else 0.5 end p from battles
        union all
        select model_b, case winner when 'model_b' then 1.0 when 'model_a' then 0.0 else 0.5 end from battles),
rt as (select cast(substr(system, 2) as int) idx, 1000.0 + 400.0 * avg(p) rating from pts group by system),
rl as (select list(rating order by idx) rat from rt)"""


def _ratings(spark, sf_dir):
    """Per-system ratings from win shares, one row per configured system."""
    b = fx.battles(spark, sf_dir)
    pa = F.when(F.col("winner") == "model_a", 1.0).when(F.col("winner") == "model_b", 0.0).otherwise(0.5)
    pts = b.select(F.col("model_a").alias("system"), pa.alias("p")).unionByName(
        b.select(F.col("model_b").alias("system"), (F.lit(1.0) - pa).alias("p")))
    rated = pts.groupBy("system").agg((F.lit(1000.0) + F.lit(400.0) * F.avg("p")).alias("r"))
    systems = spark.createDataFrame(list(enumerate(SYSTEMS12)), "idx int, system string")
    return systems.join(rated, "system", "left").select("idx", "system", F.coalesce("r", F.lit(1000.0)).alias("rating"))


def _out_sql(idx):
    return (f"case when (item_id + {idx}) % 7 = 0 then '' when (item_id + {idx}) % 11 = 0 then 'none' "
            f"else 'code' end")


@register("q1_matchups", sql=f"""
with {fx.ITEMS_SQL}, {_RATINGS_SQL},
u as (select item_id, {hash_uniform_sql('arena:a', 'item_id')} u1, {hash_uniform_sql('arena:b', 'item_id')} u2,
             {hash_uniform_sql('arena:s', 'item_id')} u3 from items),
a as (select item_id, cast(floor(u1 * 12) as int) a, u2, u3, rat from u, rl),
o as (select *, list_filter(range(0, 12), lambda j: j <> a) others from a),
g as (select *, list_transform(others, lambda j: abs(rat[a + 1] - rat[j + 1])) gaps from o),
w as (select *, list_transform(gaps, lambda d: 1.0 / (1.0 + d / (list_min(gaps) + 1e-6))) w from g),
c as (select *, list_transform(range(1, 12), lambda i: list_reduce(w[1:i], lambda acc, y: acc + y)) cum,
             list_reduce(w, lambda acc, y: acc + y) total from w),
p as (select *, others[least(len(list_filter(cum, lambda x: x <= u2 * total)), 10) + 1] b from c),
s as (select item_id, case when u3 < 0.5 then b else a end ia, case when u3 < 0.5 then a else b end ib from p)
select item_id, concat('s', ia) model_a, concat('s', ib) model_b,
       ({_out_sql('ia')}) not in ('', 'none') and ({_out_sql('ib')}) not in ('', 'none') eligible
from s
""")
def q1_matchups(spark, sf_dir):
    """Per item: A uniform, B weighted towards close ratings, seats swapped half the time; B3 eligibility."""
    m = S.draw_matchups(fx.items(spark, sf_dir), _ratings(spark, sf_dir))
    ia = F.substring("model_a", 2, 3).cast("int")
    ib = F.substring("model_b", 2, 3).cast("int")

    def out(idx):
        k = F.col("item_id") + idx
        return F.when(k % 7 == 0, F.lit("")).when(k % 11 == 0, F.lit("none")).otherwise(F.lit("code"))

    return m.select("item_id", "model_a", "model_b", S.eligible_pair(out(ia), out(ib)).alias("eligible"))


_GRID_SQL = f"""{fx.ITEMS_SQL},
grid as (select i.item_id * 5 + v.ord task_id from items i cross join range(5) v(ord))"""


@register("q2_chunk_order", sql=f"""
with {_GRID_SQL},
ch as (select distinct task_id // 100 chunk_id from grid)
select chunk_id, row_number() over (order by md5(concat('chunks|', chunk_id)), chunk_id) - 1 chunk_seq from ch
""")
def q2_chunk_order(spark, sf_dir):
    """100-task chunks in a seeded shuffled run order (distributed dense numbering)."""
    g = G.task_grid(fx.items(spark, sf_dir), fx.VARIANTS)
    return S.chunk_order(g.select("task_id")).select("chunk_id", F.col("chunk_seq").cast("bigint"))


@register("q5_online_battles", sql=f"""
with {fx.JUDGEMENTS_MULTI_SQL},
p as (select battle_id, model_a, model_b,
             trim(regexp_extract(raw, '(?s)```json(.*)```', 1), ' ' || chr(10) || chr(13) || chr(9) || '`')::JSON js
      from jm),
e as (select battle_id, model_a, model_b,
             flatten(list_transform(json_keys(js), lambda c: list_transform(json_keys(js -> c),
                     lambda a: struct_pack(category := c, aspect := a, entry := (js -> c) -> a)))) ents
      from p),
k as (select *, list_position(list_transform(ents, lambda x: list_contains(json_keys(x.entry), 'winner')), false) cut
      from e),
kept as (select battle_id, model_a, model_b,
                case when cut > 0 then ents[1:cut - 1] else ents end ents from k)
select battle_id, model_a, model_b, cast(u.pos - 1 as int) entry_pos, u.x.category category, u.x.aspect aspect,
       u.x.entry ->> 'winner' winner_raw
from kept, unnest(list_transform(ents, lambda x, i: struct_pack(pos := i, x := x))) t(u)
""")
def q5_online_battles(spark, sf_dir):
    """Online battle list: entries in reply order; a missing winner drops the rest of that reply."""
    parsed = J.parse_judgements(fx.judgements_multi(spark, sf_dir))
    return J.online_battles(parsed)


@register("g7_multi_entry_battles", sql=f"""
with {fx.JUDGEMENTS_MULTI_SQL},
p as (select battle_id, model_a, model_b,
             trim(regexp_extract(raw, '(?s)```json(.*)```', 1), ' ' || chr(10) || chr(13) || chr(9) || '`')::JSON js
      from jm)
select battle_id, model_a, model_b, c.key category, a.key aspect, a.value ->> 'winner' winner_raw,
       case when coalesce(a.value ->> 'winner', '') = '' then 'tie'
            when lower(a.value ->> 'winner') = 'a' then 'model_a'
            when lower(a.value ->> 'winner') = 'b' then 'model_b' else 'tie' end winner
from p, json_each(p.js) c, json_each(c.value) a
where list_contains(json_keys(a.value), 'winner')
""")
def g7_multi_entry_battles(spark, sf_dir):
    """Batch explode of multi-entry replies: only the entry without a winner is skipped."""
    return J.explode_battles(J.parse_judgements(fx.judgements_multi(spark, sf_dir)))
