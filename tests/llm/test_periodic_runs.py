"""Operator 11 against brute force."""

import hashlib
import random
import zlib

import numpy as np

from tallyspark.llm import common, periodic_runs as P, queries

from .conftest import ODD


def brute_runs(w, min_length):
    """(start, length, period) of all runs, by trying every period."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, 2 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_collapsed(w, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def split(text):
    return [x for x in (text or "").translate({k: " " for k in range(9, 14)}).split(" ") if x]


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        while len(words) < rng.randrange(1, 90):
            unit = [rng.choice("ab") if rng.random() < 0.8 else rng.choice("abcde") for _ in range(rng.randrange(1, 9))]
            words += (unit * rng.randrange(1, 7))[:rng.randrange(1, 40)]
        yield " ".join(words)


def test_equals_brute_force(docs):
    rows = list(enumerate(texts(1, 300)))
    for min_length, batch in ((12, 1 << 17), (5, 100), (2, 1000)):
        out = {r.doc_id: r for r in P.find_runs(docs(rows), min_length=min_length, batch_words=batch).collect()}
        for i, t in rows:
            exp = brute_runs(split(t), min_length)
            assert [(r.start, r.length, r.period) for r in out[i].runs] == exp
            assert out[i].collapsed == brute_collapsed(split(t), exp)
            assert out[i].n_words == len(split(t))


def test_odd_rows_and_clashing_columns(docs):
    d = docs(ODD, extra=["body", "runs", "collapsed", "n_words"])
    out = P.find_runs(d)
    assert out.columns == [*d.columns, "_n_words", "_runs", "_collapsed"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert len(got) == len(set(ODD)) and out.count() == len(ODD)
    r = got[5, ODD[8][1]]
    assert [tuple(x) for x in r._runs] == [(0, 30_000, 1)] and r._collapsed == "long"
    assert got[1, None]._collapsed == "" and got[1, None]._runs == [] and got[1, None].text is None
    assert P.find_runs(docs([])).count() == 0


def test_classes_that_meet_in_merges_and_insertions():
    """Many equal lines far apart: large classes, few runs."""
    rng = np.random.default_rng(3)
    line = list(range(7))
    w = []
    for k in range(700):
        w += line + [100 + k] * int(rng.integers(1, 3))
    w += [5, 6] * 30
    found = P.find_in(np.array(w), 12)
    assert [(s, e - s, q) for s, e, q in found.tolist()] == brute_runs(w, 12)


def test_suffix_order():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 300):
        ids = rng.integers(0, 2, n)
        sa, lcp = P.suffix_order(ids)
        tail = [ids[k:].tolist() for k in range(n)]
        assert sa.tolist() == sorted(range(n), key=tail.__getitem__)
        for a, b, c in zip(sa, sa[1:], lcp[1:]):
            k = 0
            while k < min(len(tail[a]), len(tail[b])) and tail[a][k] == tail[b][k]:
                k += 1
            assert c == k


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    changed = 0
    for r in common.documents(spark, sf).collect():
        w = split(r.text)
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            changed += 1
        if n > 1500:  # too long for the plain search
            continue
        runs = brute_runs(w, 12)
        got = out[r.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *best)
        assert got.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert got.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
    assert changed > 5
