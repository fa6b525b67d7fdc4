"""Stability-aware text comparison: baseline profile (G5) and target diff.

A probe is run several times on the original artifact ("trials"). A character
position is *stable* when every trial agrees on it. A candidate's output
("target") passes when no stable position differs from the baseline.

Rules kept from the reference:
  * a null trial (run error) or missing baseline -> the probe yields no rows;
  * leading empty trials are ignored; after the first non-empty trial every
    trial must have its length, else the probe yields no rows;
  * a shorter target is compared on its prefix only (an empty target passes);
    a longer target fails; a null target fails.

Cost: the baseline checks are plain column expressions over the (few) trial
columns. Positions that are not stable are found once per baseline and kept as ranges, so
neither the join nor a target ever sees the trials. Texts are compared in blocks of
``BLOCK`` characters; only blocks that differ are split into characters (``split(t, '')`` is code-point safe). A target
that is a prefix of its baseline passes by ``startswith``; only one that differs from an
unstable baseline is compared block by block, and a place where it differs is looked up in the ranges. Whole texts are processed; each row is
independent, so the work partitions with the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


def baseline_profile(df: DataFrame, keys: Sequence[str], trial_cols: Sequence[str]) -> DataFrame:
    """One row per valid baseline: ``keys, base, base_len, all_equal, unstable``.

    The trial columns are few (3 runs), so the checks are unrolled over them
    as plain column expressions (codegen, no arrays). ``unstable`` holds the ranges of positions
    (from 0, ``end`` exclusive, in order) on which the trials from the first non-empty one on
    disagree; null when ``all_equal``. Invalid baselines (error in a trial, length change) are dropped.
    """
    ts = [F.col(c) for c in trial_cols]
    lens = [F.length(t) for t in ts]
    first = F.lit(0)
    base = F.lit("")
    for k in reversed(range(len(ts))):          # first non-empty trial (1-based), 0 if none
        first = F.when(lens[k] > 0, F.lit(k + 1)).otherwise(first)
        base = F.when(lens[k] > 0, ts[k]).otherwise(base)
    t = df.select(*keys, *[t.alias(f"_t{k}") for k, t in enumerate(ts)], first.alias("_first"),
                  base.alias("base"))
    t = t.withColumn("base_len", F.length("base").cast("int"))
    tc = [F.col(f"_t{k}") for k in range(len(ts))]
    considered = [F.col("_first") <= k + 1 for k in range(len(ts))]   # trials from the first non-empty on
    no_error = reduce(lambda a, b: a & b, [c.isNotNull() for c in tc])
    same_len = reduce(lambda a, b: a & b, [~c | (F.length(x) == F.col("base_len")) for c, x in zip(considered, tc)])
    t = t.filter(no_error & same_len)
    equal = reduce(lambda a, b: a & b, [~c | (x == F.col("base")) for c, x in zip(considered, tc)])
    t = t.withColumn("all_equal", equal)
    rest = F.filter(F.array(*tc), lambda x, i: i + 1 >= F.greatest(F.col("_first"), F.lit(1)))
    ranges = let(_unstable_positions(F.col("base"), rest), _ranges)
    return t.select(*keys, "base", "base_len", "all_equal", F.when(~F.col("all_equal"), ranges).alias("unstable"))


BLOCK = 1024  # characters compared at once


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _unstable_positions(base: Column, trials: Column) -> Column:
    """Positions at which some trial (all as long as ``base``) differs from ``base``, in order."""
    def inside(block, j, ts):
        chars = F.transform(F.filter(F.transform(ts, lambda t: F.get(t, j)), lambda t: t != block), lambda t: F.split(t, ""))
        return let(chars, lambda cs: F.filter(
            F.transform(F.split(block, ""), lambda c, i: F.when(F.exists(cs, lambda a: F.get(a, i) != c), j * BLOCK + i)),
            lambda p: p.isNotNull()))

    return let(F.transform(trials, _blocks), lambda ts: F.flatten(F.transform(_blocks(base), lambda block, j: F.when(
        F.forall(ts, lambda t: F.get(t, j) == block), F.array().cast("array<int>")).otherwise(inside(block, j, ts)))))


def _ranges(positions: Column) -> Column:
    """Ordered positions as ranges: a position without the one before it begins one, one without the next ends it."""
    def kept(flag, value):
        return F.filter(F.transform(positions, lambda p, i: F.when(flag(p, i), value(p))), lambda p: p.isNotNull())

    starts = kept(lambda p, i: (i == 0) | (F.get(positions, i - 1) != p - 1), lambda p: p)
    ends = kept(lambda p, i: F.coalesce(F.get(positions, i + 1) != p + 1, F.lit(True)), lambda p: p + 1)
    return F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("start"), z.alias("end")))


def stable_count(base_len: Column, all_equal: Column, unstable: Column) -> Column:
    """Number of stable positions (all trials agree) of a baseline profile."""
    lost = F.aggregate(unstable, F.lit(0), lambda n, r: n + r["end"] - r["start"])
    return F.when(all_equal | (base_len == 0), base_len).otherwise(base_len - lost)


def target_passes(target: Column, base: Column, base_len: Column, all_equal: Column,
                  unstable: Column) -> Column:
    """G6 predicate for one target against a baseline profile.

    Cheap tests first: null, too long, empty, and ``startswith`` (a target that
    is a prefix of the baseline differs nowhere). Only a target that differs
    from an unstable baseline is compared block by block, and only blocks that
    differ are looked at by character: a place where they differ must lie in an unstable range.
    """
    tlen = F.length(target)

    def fails(block, against, j):
        own = F.filter(unstable, lambda r: (r["start"] < (j + 1) * BLOCK) & (r["end"] > j * BLOCK))
        return let(own, lambda rs: let(F.split(against, ""), lambda b: F.exists(
            F.transform(F.split(block, ""), lambda c, i: (c != F.get(b, i)) & ~F.exists(
                rs, lambda r: (r["start"] <= j * BLOCK + i) & (r["end"] > j * BLOCK + i))), lambda x: x)))

    slow = let(_blocks(base), lambda bs: ~F.exists(
        F.transform(_blocks(target), lambda x, j: F.when(x == F.get(bs, j), False).otherwise(fails(x, F.get(bs, j), j))), lambda x: x))
    return (F.when(target.isNull(), F.lit(False))
            .when(tlen > base_len, F.lit(False))
            .when(tlen == 0, F.lit(True))
            .when(F.startswith(base, target), F.lit(True))
            .when(all_equal, F.lit(False))
            .otherwise(slow))


def diff_targets(profile: DataFrame, targets: DataFrame, keys: Sequence[str],
                 target_col: str = "target") -> DataFrame:
    """Join each target to its baseline profile on ``keys`` and add ``passed``.

    Targets whose baseline is invalid or missing produce no rows (inner join).
    The profile is one row per key; the join shuffles both sides on the keys
    (or broadcasts the profile when AQE measures it small).
    """
    j = targets.join(profile, list(keys), "inner")
    return j.withColumn("passed", target_passes(F.col(target_col), F.col("base"), F.col("base_len"),
                                                F.col("all_equal"), F.col("unstable")))
