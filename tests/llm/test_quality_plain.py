"""Operator 10: distances and verdicts against a plain minimum-covariance-determinant estimate."""

import math
import random

import numpy as np
import pytest

from tallyspark.llm import quality as Q

FLOORS = {"word_length": 0.06, "symbols": 0.15, "dup_lines": 0.2, "repeats": 0.2, "same_as_last": 0.1, "capitals": 0.1}


def quantile(values, p):
    """The least value with at least a share p of the values up to it."""
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]


def plain_mcd(x, part, floors, steps=3):
    """Mean and inverse covariance: concentration steps from medians and median deviations."""
    p = x.shape[1]
    mean = np.array([quantile(c, 0.5) for c in x.T])
    dev = np.array([quantile(np.abs(c - m), 0.5) for c, m in zip(x.T, mean)])
    inv = np.diag(1 / ((1.4826 * dev) ** 2 + floors ** 2))
    q = Q.chi2_quantile(part, p)
    factor = part / Q.chi2_cdf(q, p + 2)
    for _ in range(steps):
        d = np.einsum("ni,ij,nj->n", x - mean, inv, x - mean)
        inner = x[d <= quantile(d, part)]
        mean = inner.mean(0)
        inv = np.linalg.inv(factor * ((inner - mean).T @ (inner - mean) / len(inner)) + np.diag(floors ** 2))
    return mean, inv


def stats(text):
    n, chars, sym, n_lines, dup, rep, same, caps = map(float, Q.text_counts(text))

    def share(a, b):
        return math.asin(math.sqrt(min(a / max(b, 1), 1)))

    return [math.log(max(chars, 1) / max(n, 1)), math.log1p(100 * sym / max(chars, 1)), share(dup, n_lines), share(rep, n), share(same, n),
            share(caps, chars)]


def test_verdicts_equal_a_plain_estimate(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(900):
        lang, source = ("en", "a") if i < 400 else ("en", "b") if i < 700 else ("de", "c") if i < 860 else (None, "d")
        w = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        kind = i % 40
        if kind == 3:
            w = [x + "#$%" for x in w]
        elif kind == 5:
            w = [x.upper() for x in w]
        elif kind == 7:
            w = [x * 4 for x in w]
        elif kind == 9:
            w = w[:10]
        rows.append((i, rng.choice([" ", "\n"]).join(w), lang, source))
    out = {r.doc_id: r for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    good = [r for r in rows if Q.text_counts(r[1])[0] >= 20 and 100 * Q.text_counts(r[1])[5] <= 30 * Q.text_counts(r[1])[0]]
    x = {r[0]: np.array(stats(r[1])) for r in good}
    floors = np.array(list(FLOORS.values()))
    cut = Q.chi2_quantile(1 - 1e-6, 6)
    estimates = {}

    def estimate(match):
        ids = tuple(r[0] for r in good if match(r))
        if len(ids) < 0.75 * 200:
            return None
        if ids not in estimates:
            e = plain_mcd(np.array([x[i] for i in ids]), 0.75, floors)
            inside = sum(1 for _ in ids)
            estimates[ids] = e if inside else None
        return estimates[ids]

    rejected = 0
    for i, text, lang, source in good:
        own = sum(r[2:] == (lang, source) for r in good)
        same_lang = sum(r[2] == lang for r in good)
        # a group counts by the rows of its last step, three quarters of it
        if own * 0.75 >= 150:
            mean, inv = estimate(lambda r: r[2:] == (lang, source))
        elif same_lang * 0.75 >= 150:
            mean, inv = estimate(lambda r: r[2] == lang)
        else:
            mean, inv = estimate(lambda r: True)
        n = Q.text_counts(text)[0]
        d2 = float((x[i] - mean) @ inv @ (x[i] - mean)) * n / (n + 100)
        assert out[i].distance2 == pytest.approx(d2, rel=1e-6, abs=1e-9)
        assert out[i].kept == (d2 <= cut)
        rejected += d2 > cut
    assert rejected > 20
    assert all(not out[r[0]].kept and out[r[0]].distance2 is None for r in rows if r[0] not in x)
