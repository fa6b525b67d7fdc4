"""Registered arena queries: judgement parsing, pairwise tables, ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judgements as J
from ..operators import rating as R
from . import fixtures as fx
from .registry import register

ASPECTS = [f"asp{k}" for k in range(12)]
ANCHOR = "s3"


@register("g7_judgement_battles", sql=f"""
with {fx.JUDGEMENTS_SQL},
p as (select battle_id, model_a, model_b,
             trim(regexp_extract(raw, '(?s)```json(.*)```', 1), ' ' || chr(10) || chr(13) || chr(9) || '`')::JSON js
      from judgements)
select battle_id, model_a, model_b, c.key category, a.key aspect,
       a.value ->> 'winner' winner_raw,
       case when coalesce(a.value ->> 'winner', '') = '' then 'tie'
            when lower(a.value ->> 'winner') = 'a' then 'model_a'
            when lower(a.value ->> 'winner') = 'b' then 'model_b' else 'tie' end winner
from p, json_each(p.js) c, json_each(c.value) a
where list_contains(json_keys(a.value), 'winner')
""")
def g7_judgement_battles(spark, sf_dir):
    """Parse judge replies (fenced JSON) and explode category -> aspect -> winner."""
    parsed = J.parse_judgements(fx.judgements(spark, sf_dir))
    return J.explode_battles(parsed)


@register("p1_rejected_replies", sql=f"""
with {fx.JUDGEMENTS_SQL}
select count(*) rejected from judgements where raw not like '%```json%```%'
""")
def p1_rejected_replies(spark, sf_dir):
    """Count of replies that do not parse (all fixture replies parse: 0)."""
    parsed = J.parse_judgements(fx.judgements(spark, sf_dir))
    return J.rejected(parsed).agg(F.count(F.lit(1)).alias("rejected"))


@register("p1_parse_states", sql=f"""
with {fx.BATTLES_SQL}
select battle_id, s.parse_state from battles join {fx.ODD_STATES_SQL} on s.k = battle_id % {len(fx.ODD_REPLIES)}""")
def p1_parse_states(spark, sf_dir):
    """Parse state of every reply: bare, fenced, commented, truncated, not an object, no JSON at all."""
    return J.parse_state(J.parse_judgements(fx.judgements_odd(spark, sf_dir))).select("battle_id", "parse_state")


@register("g7_odd_replies", sql=f"""
with {fx.ODD_BATCH_SQL}
select battle_id, model_a, model_b, category, aspect, winner_raw,
       case lower(winner_raw) when 'a' then 'model_a' when 'b' then 'model_b' else 'tie' end winner from odd""")
def g7_odd_replies(spark, sf_dir):
    """Battles of odd replies: one odd entry ends its category, no more."""
    return J.explode_battles(J.parse_judgements(fx.judgements_odd(spark, sf_dir)))


@register("q5_odd_replies", sql=f"with {fx.ODD_ONLINE_SQL} select * from odd")
def q5_odd_replies(spark, sf_dir):
    """Online battles of odd replies: the first odd category or entry ends the reply."""
    return J.online_battles(J.parse_judgements(fx.judgements_odd(spark, sf_dir)))


@register("p1_cut_replies", sql=f"with {fx.CUT_SQL} select * from cut_states")
def p1_cut_replies(spark, sf_dir):
    """Parse state of replies that are cut off anywhere, lack commas or hold hexadecimal numbers."""
    return J.parse_state(J.parse_judgements(fx.judgements_cut(spark, sf_dir))).select("battle_id", "parse_state")


@register("g7_cut_replies", sql=f"""
with {fx.CUT_SQL}
select battle_id, model_a, model_b, category, aspect, winner_raw,
       case lower(winner_raw) when 'a' then 'model_a' when 'b' then 'model_b' else 'tie' end winner from cut_battles""")
def g7_cut_replies(spark, sf_dir):
    """Battles of such replies: all entries whose winner has begun."""
    return J.explode_battles(J.parse_judgements(fx.judgements_cut(spark, sf_dir)))


@register("q5_cut_replies", sql=f"with {fx.CUT_SQL} select * from cut_battles")
def q5_cut_replies(spark, sf_dir):
    """Online battles of such replies."""
    return J.online_battles(J.parse_judgements(fx.judgements_cut(spark, sf_dir)))


_PAIRWISE_SQL = f"""
with {fx.BULK_BATTLES_SQL},
both_sides as (
  select aspect arena, model_a i, model_b j,
         case winner when 'model_a' then 2 when 'model_b' then 0 else 1 end w from battles
  union all
  select aspect, model_b, model_a,
         case winner when 'model_b' then 2 when 'model_a' then 0 else 1 end from battles),
pw as (
  select coalesce(arena, '(all)') arena, i, j, cast(sum(w) as bigint) w, cast(count(*) as bigint) n
  from both_sides group by grouping sets ((arena, i, j), (i, j)))
"""


@register("g9_pairwise_table", sql=_PAIRWISE_SQL + "select * from pw")
def g9_pairwise_table(spark, sf_dir):
    """W[i,j] = 2*wins + ties over both seatings, per aspect and overall."""
    return J.pairwise_table(fx.bulk_battles(spark, sf_dir), aspects=ASPECTS)


@register("g10_bt_expected_wins", sql=_PAIRWISE_SQL + """
select arena, i system, round(cast(sum(w) as double), 3) wins from pw group by arena, i
""")
def g10_bt_expected_wins(spark, sf_dir):
    """Bradley-Terry MLE per arena; expected wins from the fit equal observed wins."""
    pw = J.pairwise_table(fx.bulk_battles(spark, sf_dir), aspects=ASPECTS)
    fit = R.fit_ratings(pw)
    return R.expected_wins(pw, fit)


@register("g11_calibrated_ratings")
def g11_calibrated_ratings(spark, sf_dir):
    """Bradley-Terry ratings per arena, shifted so the anchor system has the anchor value."""
    pw = J.pairwise_table(fx.bulk_battles(spark, sf_dir), aspects=ASPECTS)
    fit = R.calibrate(R.fit_ratings(pw), ANCHOR)
    return fit.select("arena", "system", F.round("rating", 6).alias("rating"), "status")


@register("g12_bootstrap_ratings")
def g12_bootstrap_ratings(spark, sf_dir):
    """100 multinomial bootstrap rounds per arena (overall + aspects), calibrated."""
    boot = R.bootstrap_ratings(fx.bulk_battles(spark, sf_dir), rounds=R.BOOTSTRAP_ROUNDS, seed=7, aspects=ASPECTS)
    return R.calibrate(boot, ANCHOR).select("arena", "round", "system", "rating", "status")


@register("g12_bootstrap_draws", sql=f"""
with {fx.BULK_BATTLES_SQL},
n as (select coalesce(aspect, '(all)') arena, count(*) battles from battles group by grouping sets ((aspect), ())),
s as (select aspect, model_a system from battles union all select aspect, model_b from battles),
m as (select coalesce(aspect, '(all)') arena, count(distinct system) systems from s group by grouping sets ((aspect), ()))
select n.arena, r.round::INT round, n.battles, m.systems, 2 * n.battles points, true fits, 1141.86::DOUBLE anchor
from n join m using (arena), range({R.BOOTSTRAP_ROUNDS}) r(round)
""")
def g12_bootstrap_draws(spark, sf_dir):
    """Per arena and round: as many battles drawn as there are, two points a battle, expected points of the fit equal
    those drawn for every system, and the anchor at its value."""
    boot = R.calibrate(R.bootstrap_ratings(fx.bulk_battles(spark, sf_dir), rounds=R.BOOTSTRAP_ROUNDS, seed=7,
                                           aspects=ASPECTS), ANCHOR)
    return boot.groupBy("arena", "round").agg(
        F.max("battles").alias("battles"), F.count("*").alias("systems"), F.round(F.sum("points")).cast("bigint").alias("points"),
        F.bool_and(F.abs(F.col("points") - F.col("expected")) < 0.001 * F.col("points") + 0.001).alias("fits"),
        F.round(F.max(F.when(F.col("system") == ANCHOR, F.col("rating"))), 6).alias("anchor"))


@register("g14_bootstrap_leaderboard")
def g14_bootstrap_leaderboard(spark, sf_dir):
    """System x aspect matrix of bootstrap-median ratings."""
    boot = R.calibrate(R.bootstrap_ratings(fx.bulk_battles(spark, sf_dir), rounds=R.BOOTSTRAP_ROUNDS,
                                           seed=7, aspects=ASPECTS), ANCHOR)
    med = R.median_scores(boot)
    return R.leaderboard(med, ASPECTS)


_ROUND_SCORES_SQL = f"""
with {fx.BATTLES_SQL},
sides as (
  select aspect, battle_id % 10 rnd, model_a system,
         case winner when 'model_a' then 1.0 when 'model_b' then 0.0 else 0.5 end pts from battles
  union all
  select aspect, battle_id % 10, model_b,
         case winner when 'model_b' then 1.0 when 'model_a' then 0.0 else 0.5 end from battles),
scores as (select aspect arena, rnd, system, avg(pts) score from sides group by all),
med as (select arena, system, quantile_cont(score, 0.5) median from scores group by all)
"""


def _round_scores(spark, sf_dir):
    b = fx.battles(spark, sf_dir)
    pts_a = F.when(F.col("winner") == "model_a", 1.0).when(F.col("winner") == "model_b", 0.0).otherwise(0.5)
    seats = F.array(F.struct(F.col("model_a").alias("system"), pts_a.alias("pts")),
                    F.struct(F.col("model_b").alias("system"), (F.lit(1.0) - pts_a).alias("pts")))
    sides = b.select(F.col("aspect").alias("arena"), (F.col("battle_id") % 10).alias("rnd"), F.explode(seats).alias("s")) \
        .select("arena", "rnd", "s.*")
    return sides.groupBy("arena", "rnd", "system").agg(F.avg("pts").alias("score"))


@register("g13_median_scores", sql=_ROUND_SCORES_SQL + "select * from med")
def g13_median_scores(spark, sf_dir):
    """Median over rounds per (arena, system) of a per-round score table."""
    return R.median_scores(_round_scores(spark, sf_dir), value="score")


@register("g14_leaderboard", sql=_ROUND_SCORES_SQL + "select system, " + ", ".join(
    f"max(case when arena = '{a}' then median end) \"{a}\"" for a in ASPECTS) + " from med group by system")
def g14_leaderboard(spark, sf_dir):
    """System x aspect pivot of the per-aspect medians (explicit aspect list)."""
    med = R.median_scores(_round_scores(spark, sf_dir), value="score")
    return R.leaderboard(med, ASPECTS)


@register("g11_calibrate_scores", sql=_ROUND_SCORES_SQL + f"""
select arena, system, median + coalesce(1141.86 - max(case when system = '{ANCHOR}' then median end)
                                         over (partition by arena), 0.0) rating
from med""")
def g11_calibrate_scores(spark, sf_dir):
    """Calibration shift on a per-arena score table: the anchor system gets the anchor value."""
    med = R.median_scores(_round_scores(spark, sf_dir), value="score").withColumnRenamed("median", "rating")
    return R.calibrate(med, ANCHOR, keys=("arena",)).select("arena", "system", "rating")
