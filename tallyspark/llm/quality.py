"""Operator 10: quality rules and robust multivariate outliers.

Base rules look at a text alone: too few words, or too many words in repeated
windows. The verdict on the rest compares a vector of transformed statistics
with what is usual for its language and source: a minimum-covariance-
determinant estimate (the mean and covariance of the half to three quarters of
the rows that lie closest together) and a cut on the Mahalanobis distance.

The estimate is found by concentration steps, each a distance per row, an
approximate quantile per group and sums per group, so a group of any size is
aggregated where its rows are and is never gathered. Only one row per group
passes between the steps. Groups of fewer than ``min_rows`` rows take the
estimate of their language, and languages of fewer that of all rows.

Every statistic has a floor under its standard deviation, so that rows are not
rejected for differences that do not matter, however alike the others are.
A short text's statistics scatter more; their deviations are damped by
sqrt(n / (n + 100)) for n words.

Null texts have no words and fail the base rules; a null language or source is
a value of its own; ties and repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, lean, materialize, schema_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_as_last", "n_capitals"]
_CAPITALS = bytes(range(65, 91))


#: sizes of the halves, up to a window of 8 words, and an odd multiplier for each
_MIX = [(1, np.uint64(0x9E3779B97F4A7C15)), (2, np.uint64(0xBF58476D1CE4E5B9)), (4, np.uint64(0x94D049BB133111EB))]


def repeated_words(words: list) -> int:
    """Words in windows that occur at least twice in the text, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for size, mult in _MIX:  # a window's hash from those of its halves; wrapping arithmetic on 64 bits
        h = (h[:-size] * mult) ^ (h[size:] + (h[size:] >> np.uint64(29)))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    mark = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + WINDOW, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), lines, dup,
            repeated_words(words), sum(map(eq, words, words[1:])), len(raw) - len(raw.translate(None, _CAPITALS)))


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) plus COUNTS as longs."""
    kept = docs.columns if keep is None else keep
    names = [fresh(c, docs.columns) for c in COUNTS]

    def count(batches):
        import pyarrow as pa
        for b in batches:
            columns = list(zip(*map(text_counts, b.column(text).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(c, pa.int64()) for c in columns],
                                             names=[*kept, *names])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(lean(count), ", ".join([*schema_of(docs, kept), *(f"{n} long" for n in names)]))


def base_failed(names: dict[str, str]) -> Column:
    n, r = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    return (n < 20) | (100 * r > 30 * n)


def features(names: dict[str, str]) -> dict[str, tuple[Column, float]]:
    """The transformed statistics and the floors under their standard deviations."""
    n, chars, sym, lines, dup, rep, same, caps = (F.col(names[c]).cast("double") for c in COUNTS)
    one = F.lit(1.0)
    share = lambda a, b: F.asin(F.sqrt(F.least(a / F.greatest(b, one), one)))  # noqa: E731  variance-stabilised
    return {
        "word_length": (F.log(F.greatest(chars, one) / F.greatest(n, one)), 0.06),
        "symbols": (F.log1p(100 * sym / F.greatest(chars, one)), 0.15),
        "dup_lines": (share(dup, lines), 0.2),
        "repeats": (share(rep, n), 0.2),
        "same_as_last": (share(same, n), 0.1),
        "capitals": (share(caps, chars), 0.1),
    }


# -- minimum covariance determinant per group ---------------------------------------------------------------------

def chi2_cdf(x: float, dof: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return hi


def _distance(xs: list[str], mean: str = "mean", inv: str = "inv") -> Column:
    """Squared Mahalanobis distance from a group's ``mean`` and inverse covariance (row by row)."""
    d = [F.col(x) - F.col(mean)[i] for i, x in enumerate(xs)]
    p = len(xs)
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + (1 if i == j else 2) * d[i] * d[j] * F.col(inv)[i * p + j]
    return total


def _inverse(sums: DataFrame, keys: list[str], p: int, floors: list[float], factor: float) -> DataFrame:
    """Mean and inverse of the floored covariance for every group, from sums over its rows."""

    def invert(batches):
        import pyarrow as pa
        for b in batches:
            n = np.maximum(np.asarray(b.column("n"), dtype=float), 1)
            first = np.array(b.column("first").to_pylist(), float).reshape(-1, p)
            second = np.array(b.column("second").to_pylist(), float).reshape(-1, p, p)
            mean = first / n[:, None]
            cov = factor * (second / n[:, None, None] - mean[:, :, None] * mean[:, None, :]) + np.diag(np.square(floors))
            inv = np.linalg.inv(cov)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [
                b.column("n"), pa.array(list(mean), pa.list_(pa.float64())),
                pa.array(list(inv.reshape(-1, p * p)), pa.list_(pa.float64()))], names=[*keys, "n", "mean", "inv"])

    return sums.mapInArrow(lean(invert), ", ".join([*schema_of(sums, keys), "n long, mean array<double>, inv array<double>"]))


def _attach(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its group's parameters; without keys, those of the one group as constants."""
    if keys:
        return rows.join(params, keys)
    one = params.first()
    return rows.withColumns({c: F.lit(one[c]) for c in params.columns})


def _sums(rows: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    p = len(xs)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array(*[F.sum(x) for x in xs]).alias("first"),
        F.array(*[F.sum(F.col(xs[min(i, j)]) * F.col(xs[max(i, j)])) for i in range(p) for j in range(p)]).alias("second"))


def mcd(rows: DataFrame, keys: list[str], xs: list[str], floors: list[float], part: float = 0.75,
        steps: int = 3) -> DataFrame:
    """Per group of ``keys``: ``n``, ``mean``, ``inv`` of the minimum-covariance-determinant estimate.

    Concentration steps from the median and the median deviations: the rows
    within the ``part`` quantile of the distance give the next mean and
    covariance. The final covariance is scaled to be consistent for a normal
    distribution.
    """
    p = len(xs)
    centre = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile_approx(x, 0.5, 2000).alias(x) for x in xs])
    centre = materialize(centre.select(*keys, F.array(*xs).alias("mean")), "mcd-centre")
    dev = _attach(rows, centre, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("mean").alias("mean"),
        *[F.percentile_approx(F.abs(F.col(x) - F.col("mean")[i]), 0.5, 2000).alias(f"_d{i}") for i, x in enumerate(xs)])
    diag = [1 / (F.pow(1.4826 * F.col(f"_d{i}"), 2) + floors[i] ** 2) if i == j else F.lit(0.0)
            for i in range(p) for j in range(p)]
    now = materialize(dev.select(*keys, "n", "mean", F.array(*diag).alias("inv")), "mcd-start")
    q = chi2_quantile(part, p)
    factor = part / chi2_cdf(q, p + 2)
    for k in range(steps):
        near = _attach(rows, now.drop("n"), keys).withColumn("_d", _distance(xs))
        cut = materialize(near.groupBy(*keys).agg(F.percentile_approx("_d", part, 2000).alias("_cut")), "mcd-cut")
        inner = _attach(near, cut, keys).filter("_d <= _cut")
        now = materialize(_inverse(_sums(inner, keys, xs), keys, p, floors, factor), "mcd-step")
    return now


def robust_outliers(rows: DataFrame, group: list[str], xs: dict[str, float], damp: str | None = None,
                    min_rows: int = 200, tail: float = 1e-6, part: float = 0.75) -> DataFrame:
    """``rows`` (not empty) plus ``distance2`` (squared, from the group's estimate) and ``outlier``.

    ``group``: columns from the finest to the coarsest grouping's prefix, as
    ``[language, source]``; ``xs``: columns and the floors of their standard
    deviations; ``damp``: a column of factors on deviations; ``tail``: the
    share of a normal distribution beyond the cut. All rows must have non-null
    ``xs``.
    """
    names, floors = list(xs), list(xs.values())
    p = len(names)
    levels = [group[:k] for k in range(len(group), -1, -1)]  # finest first, then all rows
    out = rows
    for k, keys in enumerate(levels):
        e = mcd(rows, keys, names, floors, part).select(*keys, F.col("n").alias(f"_n{k}"), F.col("mean").alias(f"_m{k}"),
                                                        F.col("inv").alias(f"_i{k}"))
        out = out.join(e.filter(F.col(f"_n{k}") >= part * min_rows), keys, "left") if keys else _attach(out, e, keys)
    out = (out.withColumn("_mean", F.coalesce(*[f"_m{k}" for k in range(len(levels))]))
           .withColumn("_inv", F.coalesce(*[f"_i{k}" for k in range(len(levels))])))
    d2 = _distance(names, "_mean", "_inv") * (F.pow(F.col(damp), 2) if damp else 1)
    cut = chi2_quantile(1 - tail, p)
    return out.select(*rows.columns, d2.alias("distance2"), (d2 > cut).alias("outlier"))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
            keep: list[str] | None = None, tail: float = 1e-6) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus COUNTS, ``base_failed``, ``distance2`` (null where the base rules fail) and
    ``kept``."""
    kept = docs.columns if keep is None else keep
    counted = with_counts(docs, text, list(dict.fromkeys([*kept, lang, source])))
    names = dict(zip(COUNTS, counted.columns[-len(COUNTS):]))
    taken = [*counted.columns]
    fails, d2, verdict, key, l, s, damp = (fresh(n, taken) for n in (
        "base_failed", "distance2", "kept", "row_key", "group_lang", "group_source", "damp"))
    fs = features(names)
    xs = {fresh(f"x_{k}", taken): v for k, v in fs.items()}
    n = F.col(names["n_words"])
    rows = materialize(counted.withColumn(fails, base_failed(names)).withColumns({
        l: F.coalesce(F.col(lang).cast("string"), F.lit("\0")), s: F.coalesce(F.col(source).cast("string"), F.lit("\0")),
        damp: F.sqrt(n / (n + 100.0)), **{k: c for k, (c, _) in xs.items()}}), "quality-counts")
    failed = rows.filter(fails).select(*kept, *names.values(), F.lit(True).alias(fails),
                                       F.lit(None).cast("double").alias(d2), F.lit(False).alias(verdict))
    good = rows.filter(~F.col(fails))
    if good.isEmpty():
        return failed
    judged = robust_outliers(good, [l, s], {k: f for k, (_, f) in xs.items()}, damp, tail=tail)
    passed = judged.select(*kept, *names.values(), F.lit(False).alias(fails), F.col("distance2").alias(d2),
                           (~F.col("outlier")).alias(verdict))
    return passed.unionByName(failed)
