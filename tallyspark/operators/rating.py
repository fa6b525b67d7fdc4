"""Pairwise ratings: Bradley-Terry MLE (G10), calibration (G11), bootstrap (G12),
medians (G13) and the system x aspect leaderboard (G14).

Scale: the likelihood depends on the battles only through the pairwise table
(G9), at most M * (M - 1) rows per arena, M = number of systems (a run-config
dimension, not a data size). Spark aggregates N battles to those cells with
partial aggregation; only the cells reach ``applyInPandas``, one bounded group
per (arena, round). Bootstrap resampling of N battles with replacement equals a
multinomial draw over the cell counts, so cost after the aggregate does not
depend on N and all rounds run in parallel.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .judgements import cells as battle_cells

# Fixed values of the rating model (must equal the reference's):
# logistic scale 800 with base 10 around an initial rating of 1000, solver
# tolerance 1e-6; the calibrated anchor value is 1141.86; 100 bootstrap rounds.
SCALE = 800.0
BASE = 10.0
INIT_RATING = 1000.0
TOL = 1e-6
ANCHOR_VALUE = 1141.86
BOOTSTRAP_ROUNDS = 100

FIT_SCHEMA = "arena string, round int, system string, rating double, status string"


def _strongly_connected(m: int, win: np.ndarray) -> bool:
    """True iff the directed graph i -> j (win[i, j] > 0) is strongly connected."""
    if m <= 1:
        return True
    adj = win > 0

    def reach(a: np.ndarray) -> int:
        seen = np.zeros(m, bool)
        seen[0] = True
        stack = [0]
        while stack:
            k = stack.pop()
            nxt = np.nonzero(a[k] & ~seen)[0]
            seen[nxt] = True
            stack.extend(nxt.tolist())
        return int(seen.sum())

    return reach(adj) == m and reach(adj.T) == m


def fit_bradley_terry(systems: Sequence[str], win: np.ndarray, scale: float = SCALE,
                      base: float = BASE, init: float = INIT_RATING, tol: float = TOL, max_steps: int = 200):
    """MLE of ``P(i > j) = 1 / (1 + base ** -(c_i - c_j))`` for a weight matrix.

    ``win[i, j]`` is the weight of i beating j (2 per win, 1 per tie). Returns
    (ratings = scale * c + init with mean(c) = 0, status). The mean-zero
    normalisation is where an unpenalised logistic fit without intercept
    started at zero converges. Non-identifiable data (win graph not strongly
    connected) gives all-null ratings and ``status='not_identifiable'``; a fit
    that has not settled after ``max_steps`` steps gives null ratings and
    ``status='not_converged'``.
    """
    m = len(systems)
    if m == 0:
        return np.zeros(0), "empty"
    if m == 1:
        return np.array([init]), "ok"
    if not _strongly_connected(m, win):
        return np.full(m, np.nan), "not_identifiable"
    n = win + win.T
    lb = math.log(base)
    theta = np.zeros(m)  # theta = ln(base) * c
    for _ in range(max_steps):
        d = theta[:, None] - theta[None, :]
        p = 1.0 / (1.0 + np.exp(-d))
        grad = (win - n * p).sum(axis=1)
        wgt = n * p * (1.0 - p)
        hess = -np.diag(wgt.sum(axis=1)) + wgt
        # fix theta_0 = 0 (the likelihood is shift-invariant), solve the rest
        step = np.zeros(m)
        step[1:] = np.linalg.solve(hess[1:, 1:], -grad[1:])
        # damped Newton: halve until the log-likelihood does not drop
        ll0 = float((win * np.log(p + 1e-300)).sum())
        t = 1.0
        while True:
            cand = theta + t * step
            dc = cand[:, None] - cand[None, :]
            pc = 1.0 / (1.0 + np.exp(-dc))
            if float((win * np.log(pc + 1e-300)).sum()) >= ll0 - 1e-12 or t * np.max(np.abs(step)) < tol * 1e-4:
                break
            t /= 2
        theta = theta + t * step
        if np.max(np.abs(t * step)) < tol * 1e-4:
            break
    else:
        return np.full(m, np.nan), "not_converged"
    c = theta / lb
    c = c - c.mean()
    return scale * c + init, "ok"


def _win_matrix(pdf: pd.DataFrame, systems: list[str]) -> np.ndarray:
    idx = {s: k for k, s in enumerate(systems)}
    win = np.zeros((len(systems), len(systems)))
    if len(pdf):
        win[pdf["i"].map(idx).to_numpy(), pdf["j"].map(idx).to_numpy()] = pdf["w"].to_numpy(float)
    return win


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas body: one (arena, round) pairwise table -> one row per system."""
    arena, rnd = pdf["arena"].iloc[0], int(pdf["round"].iloc[0])
    systems = sorted(set(pdf["i"]).union(pdf["j"]))
    win = _win_matrix(pdf, systems)
    ratings, status = fit_bradley_terry(systems, win)
    return pd.DataFrame({"arena": arena, "round": rnd, "system": systems,
                         "rating": ratings, "status": status})


def fit_ratings(pairwise: DataFrame) -> DataFrame:
    """One Bradley-Terry fit per arena (and per ``round`` when present).

    ``pairwise``: ``arena, [round,] i, j, w`` (from G9). Output ``FIT_SCHEMA``.
    """
    if "round" not in pairwise.columns:
        pairwise = pairwise.withColumn("round", F.lit(-1))
    return (pairwise.select("arena", F.col("round").cast("int"), "i", "j", "w")
            .groupBy("arena", "round").applyInPandas(_fit_group, FIT_SCHEMA))


def expected_wins(pairwise: DataFrame, ratings: DataFrame, scale: float = SCALE,
                  base: float = BASE) -> DataFrame:
    """G10' check: ``sum_j N_ij * P_ij`` from fitted ratings (equals observed ``sum_j W_ij`` at the MLE).

    Every battle puts 2 points on the pair, so ``N_ij = W_ij + W_ji = 2 * n_ij``
    and no self-join of the pairwise table is needed. The ratings have a row
    per arena and system; whether to broadcast them is left to their size.
    """
    r = ratings.select("arena", "system", "rating")
    ri = r.select("arena", F.col("system").alias("i"), F.col("rating").alias("ri"))
    rj = r.select("arena", F.col("system").alias("j"), F.col("rating").alias("rj"))
    t = pairwise.select("arena", "i", "j", "n").join(ri, ["arena", "i"]).join(rj, ["arena", "j"])
    p = 1.0 / (1.0 + F.pow(F.lit(base), -(F.col("ri") - F.col("rj")) / F.lit(scale)))
    return (t.groupBy("arena", F.col("i").alias("system"))
            .agg(F.round(F.sum(F.lit(2.0) * F.col("n") * p), 3).alias("wins")))


def calibrate(ratings: DataFrame, anchor: str, value: float = ANCHOR_VALUE,
              keys: Sequence[str] = ("arena", "round")) -> DataFrame:
    """Shift each fit so ``anchor`` has ``value``; unchanged when the anchor is absent."""
    w = Window.partitionBy(*keys)
    a = F.max(F.when(F.col("system") == anchor, F.col("rating"))).over(w)
    return ratings.withColumn("rating", F.col("rating") + F.coalesce(F.lit(float(value)) - a, F.lit(0.0)))


def _seed_for(seed: int, arena: str, rnd: int) -> int:
    h = hashlib.sha256(f"{seed}|{arena}|{rnd}".encode()).digest()
    return int.from_bytes(h[:8], "little")


def _boot_group(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    arena, rnd = pdf["arena"].iloc[0], int(pdf["round"].iloc[0])
    # a fixed cell order: the draw must not depend on how rows reached the group
    pdf = pdf.sort_values(["model_a", "model_b", "winner"], kind="mergesort").reset_index(drop=True)
    systems = sorted(set(pdf["model_a"]).union(pdf["model_b"]))
    cnt = pdf["cnt"].to_numpy(np.int64)
    total = int(cnt.sum())
    rng = np.random.default_rng(_seed_for(seed, arena, rnd))
    draw = rng.multinomial(total, cnt / total) if total else cnt
    idx = {s: k for k, s in enumerate(systems)}
    m = len(systems)
    win = np.zeros((m, m))
    a = pdf["model_a"].map(idx).to_numpy()
    b = pdf["model_b"].map(idx).to_numpy()
    wnr = pdf["winner"].to_numpy()
    d = draw.astype(float)
    wa, wb = wnr == "model_a", wnr == "model_b"
    tie = ~(wa | wb)
    # 2 points to the winner, 1 to each side of a tie (vectorised scatter-add)
    np.add.at(win, (a[wa], b[wa]), 2 * d[wa])
    np.add.at(win, (b[wb], a[wb]), 2 * d[wb])
    np.add.at(win, (a[tie], b[tie]), d[tie])
    np.add.at(win, (b[tie], a[tie]), d[tie])
    present = (win.sum(axis=0) + win.sum(axis=1)) > 0
    keep = [s for s, p in zip(systems, present) if p]
    kidx = np.nonzero(present)[0]
    ratings, status = fit_bradley_terry(keep, win[np.ix_(kidx, kidx)])
    points = win[kidx].sum(axis=1)
    return pd.DataFrame({"arena": arena, "round": rnd, "system": keep, "rating": ratings, "status": status,
                         "points": points, "expected": _expected_points(ratings, win[np.ix_(kidx, kidx)]),
                         "battles": int(draw.sum())})


def _expected_points(ratings: np.ndarray, win: np.ndarray) -> np.ndarray:
    d = (ratings[:, None] - ratings[None, :]) / SCALE
    return ((win + win.T) / (1.0 + BASE ** -d)).sum(axis=1)


def bootstrap_ratings(battles: DataFrame, rounds: int = BOOTSTRAP_ROUNDS, seed: int = 0,
                      arena_col: str = "aspect", with_overall: bool = True,
                      aspects: list[str] | None = None) -> DataFrame:
    """``rounds`` resamples (with replacement, same size) of each arena's battles.

    Output: the fit, the ``points`` (2 per win, 1 per tie) that the system drew,
    those that the fit expects, and the number of ``battles`` drawn.

    Exact in distribution: resampling N battles = Multinomial(N, cell / N) over
    (model_a, model_b, winner) cells. Rounds are fanned out by ``explode``
    (no join) and fitted in parallel, one bounded group per (arena, round).
    """
    c = battle_cells(battles, arena_col, with_overall, aspects)
    fan = c.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return fan.groupBy("arena", "round").applyInPandas(
        lambda p: _boot_group(p, seed), FIT_SCHEMA + ", points double, expected double, battles long")


def median_scores(ratings: DataFrame, keys: Sequence[str] = ("arena", "system"),
                  value: str = "rating") -> DataFrame:
    """Median over rounds (interpolated, nulls skipped). Order it where it is shown."""
    return ratings.groupBy(*keys).agg(F.median(value).alias("median"))


def leaderboard(medians: DataFrame, aspects: Sequence[str], arena_col: str = "arena",
                value: str = "median") -> DataFrame:
    """System x aspect matrix of medians; the aspect list is explicit (no extra pass)."""
    return (medians.filter(F.col(arena_col).isin(*aspects))
            .groupBy("system").pivot(arena_col, list(aspects)).agg(F.max(value)))
