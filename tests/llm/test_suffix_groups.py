"""Operator 12 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tallyspark.llm import queries, suffix_groups as S

from .conftest import ODD

SPLIT = " \t\n\x0b\x0c\r"


def brute(rows, n):
    """Per row, in corpus order (null ids last, equal ids as given): number of words, removed ones, kept text."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), {}
    for k in order:
        words = (rows[k][1] or "").translate({ord(c): " " for c in SPLIT}).split(" ")
        words = [w for w in words if w]
        gone = [False] * len(words)
        for a in range(len(words) - n + 1):
            window = tuple(words[a:a + n])
            if window in seen:
                gone[a:a + n] = [True] * n
            seen.add(window)
        out[k] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return [out[k] for k in range(len(rows))]


def corpus(seed, texts=60):
    rng = random.Random(seed)
    passages = [[f"p{k}x{j}" for j in range(rng.randrange(18, 45))] for k in range(4)]
    rows = []
    for i in range(texts):
        words = []
        while len(words) < rng.randrange(1, 120):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randrange(1, 25))]
        rows.append((rng.randrange(10**6) * 100 + i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows + [(10**9 + k, rows[k][1]) for k in range(0, 20, 3)]


@pytest.mark.parametrize("setting", [{}, {"group_suffixes": 3, "block_words": 50, "range_keys": 64},
                                     {"group_suffixes": 1, "block_words": 10}, {"group_suffixes": 40, "block_words": 300}])
@pytest.mark.parametrize("n", [20, 7])
def test_equals_brute_force(docs, setting, n):
    rows = corpus(n)
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in S.remove_repeated_windows(docs(rows), n=n, **setting).collect()}
    assert out == {i: e for (i, _), e in zip(rows, brute(rows, n))}
    assert sum(e[1] for e in out.values()) > 0


def test_odd_rows_and_clashing_columns(docs):
    rows = [*ODD, (8, "a " * 50), (8, "a " * 50), (None, "a " * 60)]
    d = docs(rows, extra=["key", "block", "kept", "_text", "n_words"])
    out = S.remove_repeated_windows(d, block_words=20)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept"]
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=repr)
    assert found == sorted(((i, *e) for (i, _), e in zip(rows, brute(rows, 20))), key=repr)
    assert S.remove_repeated_windows(docs([])).count() == 0
    assert S.remove_repeated_windows(docs([(1, None)])).collect()[0].kept == ""
    with pytest.raises(TypeError):
        S.remove_repeated_windows(d.withColumn("doc_id", d.doc_id.cast("string")))
    with pytest.raises(ValueError):
        S.remove_repeated_windows(d, n=3)


def test_deep_nodes_are_runs_of_equal_suffixes():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 3, (200, 4)).astype("<u4")
    keys = rng.integers(0, 50, 200)
    sa, node = S.deep_nodes(symbols, (np.arange(200), keys))
    rows = [tuple(x) for x in symbols.tolist()]
    assert [rows[k] for k in sa] == sorted(rows)
    for k, at in zip(sa, node):
        alike = [j for j in range(200) if rows[j] == rows[k]]
        assert (at >= 0) == (len(alike) > 1)
        if at >= 0:
            assert sa[at] == min(alike, key=lambda j: (keys[j], j))


def test_query_equals_brute_force(spark):
    from tallyspark.llm import common
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.documents(spark, sf).collect()]
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op12_suffix_groups"](spark, sf).collect()}
    assert out == {i: (a, b, hashlib.sha256(c.encode()).hexdigest()) for (i, _), (a, b, c) in zip(rows, brute(rows, 20))}
