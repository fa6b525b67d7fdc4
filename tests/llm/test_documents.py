"""Operators 1, 3, 4, 5 and 7 against brute force, on odd rows and on random texts with planted repeats."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate as D
from tallyspark.llm.jaccard_join import one_of_each, similar_groups
from tallyspark.llm import jaccard_join, repeats, suffix_lm
from tallyspark.llm.repeats import remove_repeats, repeated_spans
from tallyspark.llm.run_index import RunIndex
from tallyspark.llm.suffix_lm import DISCOUNT, GAIN, PRIOR, score
from tallyspark.llm.token_counts import count_tokens

from .conftest import ODD


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "ße"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(90)
    rows = []
    for i in range(n):
        t = text(rng.randint(1, 120))
        if i % 7 == 0:
            t += " " + passage + " " + text(5)
        if i % 11 == 0 and rows:
            t = rng.choice(rows)[1]
        if i % 5 == 0 and rows:
            w = rng.choice(rows)[1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 13 == 0:
            t = (text(20) + "\n") * 8
        rows.append((i, t))
    return rows


ROWS = corpus() + [(500 + k, t) for k, t in ODD if k is not None] + [(None, "no id here"), (None, None)]


def words(t):
    return t.encode().lower().split() if t else []


# -- operator 4 ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_token_counts_equal_the_library(spark, docs, tmp_path, monkeypatch, broadcast):
    from tallyspark.llm import token_counts
    monkeypatch.setattr(token_counts, "BROADCAST_BYTES", broadcast)
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = ROWS + [(900, "<s> special </s> strings <unk>")]
    cache = str(tmp_path / "cache")
    got = count_tokens(docs(rows, ["digest", "tokenizer"]), "piece_bpe_32k.model", cache=cache)
    assert got.columns[-3:] == ["digest", "tokenizer", "n_tokens"]
    exp = collections.Counter((i, t, len(sp.encode(t or ""))) for i, t in rows)
    assert collections.Counter((r.doc_id, r.text, r.n_tokens) for r in got.collect()) == exp
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in rows})  # distinct texts once
    more = rows + [(901, "something new")]
    again = count_tokens(docs(more), "piece_bpe_32k.model", cache=cache)
    assert again.count() == len(more)
    assert spark.read.parquet(cache).count() == stored + 1  # only the miss was appended
    flags = {(r.doc_id, r.text): r.hit for r in count_tokens(docs(more + [(902, "newer still")]), "piece_bpe_32k.model", cache=cache,
                                                             known="hit").collect()}
    assert not flags[902, "newer still"] and flags[901, "something new"] and all(flags[i, t] for i, t in rows)
    stored += 1
    # the model's normaliser writes spaces as U+2581, so these two are one content
    twins = count_tokens(docs([(1, "two words of it"), (2, "two\u2581words of\u2581it")]), "piece_bpe_32k.model", cache=cache).collect()
    assert sp.normalize(twins[0].text) == sp.normalize(twins[1].text) and spark.read.parquet(cache).count() == stored + 2
    assert all(r.n_tokens == len(sp.encode(r.text)) for r in twins)
    other = count_tokens(docs(rows[:3]), "byte_bpe_50k.json", cache=cache)  # another tokenizer has counts of its own
    assert other.count() == 3 and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert count_tokens(docs([]), "piece_bpe_32k.model").count() == 0


# -- operator 7 ---------------------------------------------------------------------------------------------------

def brute_hits(text, items, n):
    w = D.normal_words(text)
    hit, met = set(), set()
    for item, t in items:
        v = D.normal_words(t)
        for k in range(max(1, len(v) - n + 1)) if v else ():
            win = v[k:k + n]
            for a in range(len(w) - len(win) + 1):
                if w[a:a + len(win)] == win:
                    hit.update(range(a, a + len(win)))
                    met.add(item)
    return len(w), hit, sorted(met)


ITEMS = [("q1", "Alpha, beta! gamma delta epsilon zeta eta theta iota kappa lambda mu"), ("q2", "short One"), ("q2", "short One"),
         ("q3", ""), ("q4", None), (None, "nameless item words"), ("q5", "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
         ("q6", "Élan vital")]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_contamination_equals_brute_force(spark, docs, shard_bytes):
    texts = ["x alpha beta, gamma delta epsilon -- zeta eta theta iota kappa lambda mu y", "a short one, two shorts one",
             "short\none", "beta gamma delta epsilon zeta eta theta iota kappa", "nameless item words short one élan vital",
             "ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda", *[t for _, t in ODD]]
    rows = list(enumerate(texts))
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = D.find_contamination(docs(rows, ["items", "row"]), bench, shard_bytes=shard_bytes)
    names = got.columns[-3:]
    assert names == ["n_words", "spans", "_items"]
    out = {r.doc_id: r for r in got.collect()}
    assert len(out) == len(rows)
    items = [(i or "", t) for i, t in ITEMS]
    for i, t in rows:
        n, hit, met = brute_hits(t, items, 10)
        r = out[i]
        spans = [(s.word_start, s.word_end) for s in r.spans]
        assert (r.n_words, r._items) == (n, met), t
        assert {k for a, z in spans for k in range(a, z)} == hit
        assert all(b[0] > a[1] for a, b in zip(spans, spans[1:]))
        for s in r.spans:  # offsets in the original hold exactly those words
            assert D.normal_words(t[s.char_start:s.char_end]) == D.normal_words(t)[s.word_start:s.word_end]


def test_contamination_without_items(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [len(r.spans) for r in D.find_contamination(docs([(1, "a b")]), none).collect()] == [0]
    assert D.find_contamination(docs([]), none).count() == 0


# -- operator 3 ---------------------------------------------------------------------------------------------------

def brute_spans(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[k:k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for r in raw:
        hit = [False] * len(r)
        for k in range(len(r) - length + 1):
            if seen[r[k:k + length]] > 1:
                hit[k:k + length] = [True] * length
        spans, k = [], 0
        while k < len(r):
            if hit[k]:
                a = k
                while k < len(r) and hit[k]:
                    k += 1
                spans.append((a, k))
            k += 1
        out.append((spans, bytes(b for b, h in zip(r, hit) if not h)))
    return out


@pytest.mark.parametrize("length,anchor_bytes", [(40, 1 << 21), (40, 300), (400, 1 << 21)])
def test_repeats_equal_brute_force(docs, length, anchor_bytes):
    rows = [(k, t if t is None else t[:9000]) for k, (_, t) in enumerate(ROWS)]
    rows += [(900 + k, "period " * 40 + str(k)) for k in range(3)]
    got = repeated_spans(docs(rows, ["spans", "digest", "anchor", "row"]), length=length, anchor_bytes=anchor_bytes,
                         shard_bytes=5000)
    out = {r.doc_id: r for r in got.collect()}
    assert len(out) == len(rows)
    for (i, t), (spans, left) in zip(rows, brute_spans([t for _, t in rows], length)):
        r = out[i]
        assert [(s.start, s.end) for s in r._spans] == spans, i
        assert r.n_bytes == len((t or "").encode()) and r.kept_sha256 == hashlib.sha256(left).hexdigest()


def test_passage_between_many_neighbours_gathers_no_group(docs, monkeypatch):
    """Its windows keep few anchors under every salt, each text with neighbour bytes of its own."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"

    def some(n):
        return "".join(rng.choices(letters, k=n))

    passage, sides = some(1000), [(some(500), some(500)) for _ in range(2000)]
    rows = [(k, a + passage + z) for k, (a, z) in enumerate(sides)]
    gathered, plain = [], repeats._index_marks

    def spy(parts, *args):
        by = parts.groupBy("anchor").agg(F.sum(F.octet_length("bytes")).alias("b"), F.count("*").alias("n")).filter("n > 1")
        gathered.append(by.agg(F.max("b")).first()[0] or 0)
        return plain(parts, *args)

    monkeypatch.setattr(repeats, "_index_marks", spy)
    out = {r.doc_id: r.spans for r in repeated_spans(docs(rows), anchor_bytes=50_000).collect()}

    def shared(texts):  # how far each goes with another one from its begin
        order = sorted(range(len(texts)), key=texts.__getitem__)
        far = [0] * len(texts)
        for x, y in zip(order, order[1:]):
            n = len(os.path.commonprefix([texts[x], texts[y]]))
            far[x], far[y] = max(far[x], n), max(far[y], n)
        return far

    before, after = shared([a[::-1] for a, _ in sides]), shared([z for _, z in sides])
    for k in range(len(rows)):
        assert [(s.start, s.end) for s in out[k]] == [(500 - before[k], 1500 + after[k])], k
    assert max(gathered) <= 50_000


def test_remove_repeats_cuts_whole_characters(docs):
    rows = [(1, "ß" * 10 + "x" * 50), (2, "é" + "ß" * 5 + "x" * 50 + "tail"), (3, None), (4, "free")]
    out = {r.doc_id: r.text for r in remove_repeats(docs(rows), length=32).collect()}
    exp = {i: None if t is None else left.decode(errors="ignore")
           for (i, t), (_, left) in zip(rows, brute_spans([t for _, t in rows], 32))}
    assert out == exp
    assert remove_repeats(docs([]), length=32).count() == 0


def test_run_index_statistics():
    rng = random.Random(3)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.choice([0, 2, 9, 30]))) for _ in range(rng.randint(1, 5))]
        suffixes = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        exp = [max([0] + [common(strings[k][i:], strings[l][j:]) for l, j in suffixes if (l, j) != (k, i)]) for k, i in suffixes]
        assert RunIndex(strings).statistics().tolist() == exp


# -- operator 5 ---------------------------------------------------------------------------------------------------

def shingle_set(t, n):
    w = words(t)
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, [find(k) for k in range(len(rows))]


@pytest.mark.parametrize("n,num,den,block", [(3, 90, 100, 4096), (5, 80, 100, 3)])
def test_jaccard_groups_equal_brute_force(docs, n, num, den, block):
    base = " ".join(f"w{k}" for k in range(60))
    rows = ROWS[:70] + [(1000 + k, base.replace(f"w{k} ", f"v{k} ")) for k in range(1, 50)]
    rows += [(2000 + k, base.replace(f"w{k} ", "").replace(f"w{2 * k} ", "z ")) for k in range(1, 20)] + [(None, base)]
    got = similar_groups(docs(rows, ["row", "n_shingles", "cluster"]), n=n, num=num, den=den, block=block).collect()
    sets, comp = brute_components(rows, n, num, den)
    low = {}
    for (i, _), s, c in zip(rows, sets, comp):
        if s and i is not None:
            low[c] = min(low.get(c, i), i)
    exp = collections.Counter((i, t, len(s), low.get(c, i) if s else i) for (i, t), s, c in zip(rows, sets, comp))
    assert collections.Counter((r.doc_id, r.text, r._n_shingles, r.component_id) for r in got) == exp


def test_jaccard_blocks_of_a_large_group_stay_whole(spark, docs, monkeypatch):
    """Also where a join before them is planned as a shuffle: Spark then drops a shuffle by the same columns, and reads the join's rows by
    where they come from if it broadcasts the other side after all."""
    rng = random.Random(8)
    texts = [[f"w{k}" for k in range(90)]]
    for _ in range(160):  # of one word that is another the similarity is 0.93, of two 0.87
        w = list(rng.choice(texts))
        for _ in range(1 if rng.random() < 0.8 else 2):
            w[rng.randrange(90)] = f"v{rng.randrange(900)}"
        texts.append(w)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    plans, write = [], jaccard_join.materialize

    def look(df, name, **kw):
        if name == "pairs":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, **kw)

    monkeypatch.setattr(jaccard_join, "materialize", look)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = similar_groups(docs(rows), block=20).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    _, comp = brute_components(rows, 3, 90, 100)
    assert 5 < len(set(comp)) < 100 and max(collections.Counter(comp).values()) > 24
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(comp))
    assert len(plans) > 1 and all("REPARTITION_BY_COL" in p for p in plans)


def test_one_of_each_keeps_one_row_of_a_component(docs):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(7, base), (3, base + " end"), (3, base + " end"), (None, base), (4, "else"), (5, ""), (6, None), (5, ""), (None, "lone")]
    kept = one_of_each(docs(rows), n=3, num=80, den=100).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(3, base + " end"), (4, "else"), (5, ""), (5, ""), (6, None), (None, "lone")], key=str)
    assert one_of_each(docs([])).count() == 0


# -- operator 1 ---------------------------------------------------------------------------------------------------

def test_suffix_lm_base_score_and_gain(docs):
    rows = [(i, t) for i, t in ROWS if i is not None]
    train = {i for i, _ in rows if i % 10}
    got = score(docs(rows), F.col("doc_id") % 10 != 0, least=(4, 4), block_tokens=500, bucket_tokens=700).collect()
    counts = collections.Counter(w for i, t in rows if i in train for w in [*words(t), b""])
    total, distinct = sum(counts.values()), len(counts)
    exp = collections.Counter()
    for i, t in rows:
        w = [*words(t), b""]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        exp[i, i in train, len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == exp
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_suffix_lm_does_not_depend_on_blocks(docs):
    rows = [(i, t) for i, t in ROWS if i is not None][:60]
    runs = [sorted((r.doc_id, r.n_tokens, round(r.score, 8)) for r in
                   score(docs(rows), F.lit(True), least=(3, 3), block_tokens=b, bucket_tokens=k).collect())
            for b, k in ((100, 100), (10 ** 6, 10 ** 6))]
    assert runs[0] == runs[1]


def test_suffix_lm_passes_shuffle_only_what_is_new(docs, spark, monkeypatch):
    plans = {}
    write, read_back = suffix_lm._Tables.write, suffix_lm.materialize
    look = lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(suffix_lm._Tables, "write", lambda self, df, name: (look(df, name), write(self, df, name))[1])
    monkeypatch.setattr(suffix_lm, "materialize", lambda df, name, **kw: (look(df, name), read_back(df, name, **kw))[1])
    tables = spark.catalog.listTables()
    rows = [(i, t) for i, t in ROWS if i is not None][:60]
    assert score(docs(rows), F.lit(True), block_tokens=500, bucket_tokens=500).count() == 60
    # before, the blocks and all that came back to them were shuffled in every pass
    assert [p.count("Exchange hashpartitioning") for p in plans["lm-scores"]] == [0]
    assert [p.count("Exchange hashpartitioning") for p in plans["lm-pair-counts"]] == [2] * suffix_lm.DEPTH  # sent, returned
    assert spark.catalog.listTables() == tables


def test_suffix_lm_words_of_many_texts():
    import pyarrow as pa
    rng = random.Random(4)
    letters = [chr(c) for c in range(33)] + list("aAzZÄäßİ\u0130\u212a\u00a0\u0085\u2003\u3000\U0001f600\x7f")
    texts = [None, "", " ", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(3000)), None]
    for table in (pa.array(texts), pa.array(texts).slice(7, 50), pa.array([], pa.string()), pa.array([None], pa.string())):
        n, found = suffix_lm._words(table)
        wanted = [words(t) for t in table.to_pylist()]
        assert n.tolist() == [len(w) for w in wanted]
        assert [w.encode() for w in found.to_pylist()] == [x for w in wanted for x in w]


def test_suffix_lm_sends_counts_and_gains_in_few_bytes():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, np.uint64) * np.uint64(2))
    counts = np.where(rng.random(len(keys)) < 0.9, 1, rng.integers(2, 70_000, len(keys))).astype("<i4")
    gains = -np.log1p(rng.integers(1, 30, len(keys)) / PRIOR)
    sent = list(suffix_lm._send(2, 0, 3, keys, counts, gains))
    # before, 12 bytes a key besides the key
    assert sum(len(r[4]) + len(r[5]) for r in sent) < 3 * len(keys)
    assert np.array_equal(np.concatenate([suffix_lm._unpack_gains(r[5]) for r in sent]), gains)
    sizes = [len(suffix_lm._unpack_keys(r[3])) for r in sent]
    assert np.array_equal(np.concatenate([suffix_lm._unpack_counts(r[4], n) for r, n in zip(sent, sizes)]), counts)


def test_suffix_lm_distinct_keys_that_differ_in_low_bits_only():
    rng = np.random.default_rng(2)
    for keys in (np.zeros(0, np.uint64), rng.integers(0, 1 << 40, 5000, np.uint64) << np.uint64(24),
                 (rng.integers(0, 3, 5000, np.uint64) << np.uint64(60)) + rng.integers(0, 50, 5000, np.uint64)):
        distinct, first, number = suffix_lm._distinct(keys)
        assert np.array_equal(distinct, np.unique(keys))
        assert np.array_equal(distinct[number], keys) and np.array_equal(keys[first], distinct)


def test_suffix_lm_distributions_sum_to_at_most_one(docs):
    """The probabilities of all next words after a context, scored as texts that differ in the last word, and the share
    of unknown words add up to one."""
    rng = random.Random(5)
    learn = [(i, " ".join(rng.choice(["a b", "a c", "d a b", "c"]) for _ in range(30))) for i in range(1, 40)]
    vocabulary = sorted({w for _, t in learn for w in t.split()})
    texts = [(100 + k, f"d a {w}") for k, w in enumerate([*vocabulary, "unknown"])] + [(200, "d a")]
    got = {r.doc_id: r.score for r in score(docs(learn + texts), F.col("doc_id") < 100, least=(4, 4)).collect()}
    empty = {r.doc_id: r.score for r in score(docs(learn + [(300, f"{w}") for w in ["a"]]), F.col("doc_id") < 100, least=(4, 4)).collect()}
    assert all(v < 0 for v in [*got.values(), *empty.values()])
    # P(d a w end) over w, and P(d a end), over P(d a): every word is followed by an end in turn
    total = sum(10 ** got[100 + k] for k in range(len(vocabulary) + 1))
    assert total < 1


def brute_suffix_scores(texts, depth):
    """Every count and test in the open: contexts that occur at all are tested."""
    toks = [[*words(t), b""] for t in texts]
    one = collections.Counter(w for t in toks for w in t)
    total, once, twice = sum(one.values()), *(sum(v == k for v in one.values()) for k in (1, 2))
    d = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
    after = [collections.defaultdict(collections.Counter) for _ in range(depth + 1)]
    for t in toks:
        for i, w in enumerate(t):
            for k in range(1, min(depth, i) + 1):
                after[k][tuple(t[i - k:i])][w] += 1

    def root(w):
        return (one[w] - d) / total

    def size(c):  # as often as its last words are followed by its end; a lone word by its own count
        return one[c[0]] if len(c) == 1 else after[len(c) - 1][c[:-1]][c[-1]]

    def tested(c, w):
        return root(w) if not c else (after[len(c)][c][w] + PRIOR * tested(c[1:], w)) / (size(c) + PRIOR)

    def gain(c):
        return sum(n * math.log((n - 1 + PRIOR * tested(c[1:], w)) / (size(c) - 1 + PRIOR) / tested(c[1:], w))
                   for w, n in after[len(c)][c].items())

    def smooth(c, w):
        if not c:
            return root(w)
        follow = after[len(c)][c]
        return (max(follow[w] - DISCOUNT, 0) + DISCOUNT * len(follow) * smooth(c[1:], w)) / size(c)

    scores = []
    for t in toks:
        s = 0.0
        for i, w in enumerate(t):
            kept = [()] + [c for k in range(1, min(depth, i) + 1) if gain(c := tuple(t[i - k:i])) > GAIN]
            s += math.log10(smooth(kept[-1], w))
        scores.append(s)
    return scores


def test_suffix_lm_defaults_test_every_context(docs):
    """Contexts that occur twice, and of up to four words, are tested by the defaults."""
    rng = random.Random(9)
    names = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(names) for _ in range(40)) for _ in range(30)]
    # a text and its copy with other words around: most of their contexts occur twice; x y z then tells apart by the word before
    texts += [f"{rng.choice(names)} {t}" for t in texts[:5]]
    texts += [f"{a} x y z {b}" for a, b in [("p", "first"), ("q", "second"), ("r", "third")] * 30]
    got = {r.doc_id: r.score for r in score(docs(list(enumerate(texts))), F.lit(True)).collect()}
    for i, s in enumerate(brute_suffix_scores(texts, 4)):
        assert abs(got[i] - s) < 1e-6, (i, got[i], s)
    assert got[len(texts) - 1] > brute_suffix_scores(texts, 2)[-1] + 0.1


def test_suffix_lm_without_training_rows(docs):
    got = score(docs([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(math.isfinite(r.score) for r in got)
    assert score(docs([]), F.lit(True)).count() == 0


def test_hash_fold_is_that_of_the_contract(spark):
    rows = spark.range(200).select(F.crc32(F.col("id").cast("string")).alias("c"), "id").collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in rows)
