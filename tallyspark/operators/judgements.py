"""Judgement handling: parse replies (P1), explode to battles (G7, G8), pairwise table.

Input ``judgements``: one row per judge call with ``battle_id``, ``model_a``,
``model_b`` and the reply text ``raw``. All steps are row-wise or
partial-aggregable; the pairwise table has at most arenas x M x M rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.judge_text import normalise_winner, parse_judgement
from ..functions.text import let

OVERALL = "(all)"


def parse_judgements(judgements: DataFrame, raw_col: str = "raw", lenient: bool = True, open_fence: bool = False) -> DataFrame:
    """Add ``parsed``; rows whose reply does not parse have ``parsed`` null (see :func:`rejected`).

    Replies that are cut off count as far as they go; see :func:`~tallyspark.functions.judge_text.parse_judgement`.
    """
    return judgements.withColumn("parsed", parse_judgement(F.col(raw_col), lenient, open_fence))


def rejected(parsed: DataFrame) -> DataFrame:
    """Replies that could not be parsed: counted and kept, never silently lost."""
    return parsed.filter(F.col("parsed").isNull())


def parse_state(parsed: DataFrame) -> DataFrame:
    """P1 per reply: ``parsed`` (an object), ``no_object`` (other JSON or an empty object) or ``rejected``."""
    state = F.when(F.col("parsed").isNull(), "rejected").when(F.size("parsed") == 0, "no_object").otherwise("parsed")
    return parsed.withColumn("parse_state", state)


def _until(entries: Column, stop) -> Column:
    """Entries before the first one that ``stop`` holds for."""
    at = F.array_position(F.transform(entries, stop), True)
    return let(at, lambda k: F.when(k > 0, F.slice(entries, 1, (k - 1).cast("int"))).otherwise(entries))


def explode_battles(parsed: DataFrame, keep: tuple[str, ...] = ("battle_id", "model_a", "model_b")) -> DataFrame:
    """G7 + G8: category -> aspect -> entry.

    A category that is no object is skipped; an entry without a ``winner`` is
    skipped; an entry that is no object, or whose winner is neither text nor
    empty, ends its category. Other categories are not affected.
    Output: ``*keep, category, aspect, winner_raw, winner``.
    """
    battles = F.flatten(F.transform(
        F.filter("parsed", lambda c: c["is_object"]),
        lambda c: F.transform(F.filter(_until(c["entries"], lambda e: e["state"] == "end"), lambda e: e["state"] == "ok"),
                              lambda e: F.struct(c["category"].alias("category"), e["aspect"].alias("aspect"),
                                                 e["winner"].alias("winner_raw")))))
    # explode_outer + a filter on its output: a plain explode makes the optimizer
    # infer a not-null/size filter on ``parsed`` and push it below the
    # projection, which would parse every reply twice
    x = parsed.select(*keep, F.explode_outer(battles).alias("b")).filter(F.col("b").isNotNull())
    return x.select(*keep, "b.category", "b.aspect", "b.winner_raw", normalise_winner(F.col("b.winner_raw")).alias("winner"))


def online_battles(parsed: DataFrame, keep: Sequence[str] = ("battle_id", "model_a", "model_b")) -> DataFrame:
    """Q5: every aspect entry of a judgement is one battle, in the reply's key order.

    A category or an entry that is no object, and an entry without ``winner``,
    ends that judgement: entries read before it are kept, the rest are dropped.
    Row-local (higher-order functions), no shuffle.
    """
    broken = F.array(F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("aspect"),
                              F.lit(None).cast("string").alias("winner_raw"), F.lit(True).alias("stop")))
    entries = F.flatten(F.transform("parsed", lambda c: F.when(~c["is_object"], broken).otherwise(F.transform(
        c["entries"], lambda e: F.struct(c["category"].alias("category"), e["aspect"].alias("aspect"),
                                         e["winner"].alias("winner_raw"),
                                         (~e["is_object"] | (e["state"] == "skip")).alias("stop"))))))
    kept = let(entries, lambda es: _until(es, lambda e: e["stop"]))
    x = (parsed.select(*keep, F.posexplode_outer(kept).alias("entry_pos", "e")).filter(F.col("entry_pos").isNotNull()))
    return x.select(*keep, "entry_pos", "e.category", "e.aspect", "e.winner_raw")


def pairwise_table(battles: DataFrame, arena_col: str = "aspect", with_overall: bool = True,
                   aspects: list[str] | None = None) -> DataFrame:
    """``W[i, j] = 2 * wins(i over j) + ties(i, j)`` summed over both seatings.

    One row per (arena, i, j) with i != j; ``arena`` is the aspect, and
    :data:`OVERALL` for all battles (grouping sets). ``n`` is the number of
    battles between i and j in either seating. When ``aspects`` is given, only
    those aspect names form per-aspect arenas (others count only overall), so
    the table is bounded by the configuration, whatever aspects judges write.
    """
    b = _listed(battles.filter(F.col("model_a") != F.col("model_b")), arena_col, aspects)
    pts_a = F.when(F.col("winner") == "model_a", 2).when(F.col("winner") == "model_b", 0).otherwise(1)
    # both seatings from one scan: each battle becomes two (i, j, w) rows
    seats = F.array(F.struct(F.col("model_a").alias("i"), F.col("model_b").alias("j"), pts_a.alias("w")),
                    F.struct(F.col("model_b").alias("i"), F.col("model_a").alias("j"), (F.lit(2) - pts_a).alias("w")))
    both = b.select(F.col(arena_col).alias("arena"), F.explode(seats).alias("s")).select("arena", "s.*")
    aggs = [F.sum("w").cast("bigint").alias("w"), F.count(F.lit(1)).cast("bigint").alias("n")]
    if not with_overall:
        return (both if aspects is None else both.filter(F.col("arena").isNotNull())).groupBy("arena", "i", "j").agg(*aggs)
    # per aspect and overall in one aggregation (grouping sets: each row feeds two
    # groups before the map-side partial aggregate, so the shuffle stays small)
    g = (both.groupingSets([["arena", "i", "j"], ["i", "j"]], "arena", "i", "j")
         .agg(*aggs, F.grouping_id().alias("_g")))
    out = g.select(F.when(F.col("_g") == 0, F.col("arena")).otherwise(F.lit(OVERALL)).alias("arena"),
                   "i", "j", "w", "n")
    return out if aspects is None else out.filter(F.col("arena").isNotNull())


def _listed(battles: DataFrame, arena_col: str, aspects: Sequence[str] | None) -> DataFrame:
    """Aspects outside the list become null before anything is grouped by them."""
    if aspects is None:
        return battles
    return battles.withColumn(arena_col, F.when(F.col(arena_col).isin(*aspects), F.col(arena_col)))


def cells(battles: DataFrame, arena_col: str = "aspect", with_overall: bool = True,
          aspects: Sequence[str] | None = None) -> DataFrame:
    """Battle cell counts ``(arena, model_a, model_b, winner, cnt)``.

    The rating fit depends on battles only through these counts, so they are
    the only thing any Python step ever sees (<= 3 * M * (M - 1) rows per arena).
    """
    b = _listed(battles.filter(F.col("model_a") != F.col("model_b")), arena_col, aspects).select(
        F.col(arena_col).alias("arena"), "model_a", "model_b", "winner")
    cnt = F.count(F.lit(1)).cast("bigint").alias("cnt")
    if not with_overall:
        return (b if aspects is None else b.filter(F.col("arena").isNotNull())).groupBy(
            "arena", "model_a", "model_b", "winner").agg(cnt)
    g = (b.groupingSets([["arena", "model_a", "model_b", "winner"], ["model_a", "model_b", "winner"]],
                        "arena", "model_a", "model_b", "winner")
         .agg(cnt, F.grouping_id().alias("_g")))
    out = g.select(F.when(F.col("_g") == 0, F.col("arena")).otherwise(F.lit(OVERALL)).alias("arena"),
                   "model_a", "model_b", "winner", "cnt")
    return out if aspects is None else out.filter(F.col("arena").isNotNull())
