"""The pipeline, stage by stage, against brute force on a small table."""

import os
import re

import corpus_pipeline
from tallyspark.llm import common
from tallyspark.llm import packing as P
from tallyspark.llm import quality as Q
from tallyspark.sources.tables import read_table

from .test_documents import brute_components, brute_hits, brute_spans

SF = os.environ.get("TALLY_TEST_SF", "/root/testdata/sf0.001")


def brute_passages(texts, n):
    """Texts without the runs of n words (A-Z lower-cased, any white space between) that two of them share."""
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    words = [(t or "").encode().lower().split() for t in texts]
    rows = {}
    for k, w in enumerate(words):
        for a in range(len(w) - n + 1):
            rows.setdefault(tuple(w[a:a + n]), set()).add(k)
    out = []
    for k, (t, w) in enumerate(zip(texts, words)):
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            if len(rows[tuple(w[a:a + n])]) > 1:
                gone[a:a + n] = [True] * n
        raw, left, end = (t or "").encode(), b"", 0
        for a, z in runs_of_true(gone):
            left, end = left + raw[end:at[k][a][0]], at[k][z - 1][1]
        out.append(t and (left + raw[end:]).decode())
    return out


def runs_of_true(flags):
    a = None
    for k, f in enumerate([*flags, False]):
        if f and a is None:
            a = k
        elif not f and a is not None:
            yield a, k
            a = None


def test_every_stage_equals_brute_force(spark):
    docs = common.documents(spark, SF)
    rows = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF), f"test-{name}", keep=True)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns

    # quality: what the base rules pass and no symbol noise marks stays as it was
    good = {r.doc_id for r in kept["quality_rules"]}
    assert all(tuple(r) == tuple(rows[r.doc_id]) for r in kept["quality_rules"])
    for i, r in rows.items():
        n, chars, symbols, _, _, repeats, *_ = Q.text_counts(r.text)
        if n < 20 or 100 * repeats > 30 * n:
            assert i not in good
        elif 20 * symbols > chars:
            assert i not in good
    labels = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    passing = [i for i in labels if labels[i] and Q.text_counts(rows[i].text)[0] >= 20]
    assert sum(i in good for i in passing) >= 0.98 * len(passing)

    # near-duplicates: one row of each component, the least id
    items = [(r.doc_id, r.text) for r in kept["quality_rules"]]
    sets, comp = brute_components(items, 5, 80, 100)
    first = {}
    for (i, _), s, c in zip(items, sets, comp):
        if s:
            first[c] = min(first.get(c, i), i)
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(first.values())

    # repeats: runs of 51 shared words, then 400 bytes of what is left
    texts = brute_passages([r.text for r in kept["near_duplicates"]], 51)
    exp = {r.doc_id: left.decode(errors="ignore") for r, (_, left) in zip(kept["near_duplicates"], brute_spans(texts, 400))}
    assert {r.doc_id: r.text for r in kept["repeated_passages"]} == exp
    assert all(r.n_chars == len(r.text) for r in kept["repeated_passages"])

    # benchmark windows
    bench = [(str(r.item_id), r.text) for r in read_table(spark, SF, "benchmark").collect()]
    clean = {r.doc_id for r in kept["repeated_passages"] if not brute_hits(r.text, bench, 10)[1]}
    assert {r.doc_id for r in kept["benchmark_passages"]} == clean

    # packing: every token of every document once, in sequences without gaps
    e = P.ByteLevelEncoder(P.tokenizer_path("byte_bpe_50k.json"))
    sizes = {r.doc_id: len(e(r.text)) // 4 + 1 for r in kept["benchmark_passages"]}
    got, ends = {}, {}
    for r in kept["packing"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == sizes
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_passages_of_over_50_words_go(spark, docs):
    """51 to 60 short words that two documents share, in other case and white space, are under 400 bytes; 50 words stay."""
    def some(k, n):
        return " ".join(f"{k}x{j}" for j in range(n))

    rows, exp = [], {}
    for n in range(50, 61):
        passage = [f"w{n}{j}" for j in range(n)]
        for side, p in enumerate((" ".join(passage), "\n".join(passage).upper())):
            i = 2 * n + side
            before, after = some(f"{i}a", 30) + " ", f" é{i} " + some(f"{i}b", 30)
            rows.append((i, before + p + after))
            exp[i] = before + (p if n == 50 else "") + after
    rows += [(1, "again " * 60), (2, None), (3, ""), (4, " ".join(f"own{j}" for j in range(90)))]  # no other document has them
    exp |= {1: "again " * 60, 2: None, 3: "", 4: rows[-1][1]}
    rows += [(5, rows[0][1].split(" é")[0] + " " + some("5c", 40))]  # 80 words of the first document
    d = docs(rows)
    exp[5], exp[100] = " " + some("5c", 40), " é100 " + some("100b", 30)  # words are cut, and the white space between them
    stages = dict(corpus_pipeline.STAGES)
    d = common.materialize(stages["repeated_passages"](spark, d, SF), "passages-cut", keep=True)
    out = {r.doc_id: r for r in d.collect()}
    assert {i: r.text for i, r in out.items()} == exp
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.values())
    # nothing of a benchmark here: the next stage changes nothing
    assert sorted(stages["benchmark_passages"](spark, d, SF).collect()) == sorted(d.collect())


def test_scratch_tables_of_other_results_stay(spark, docs):
    from tallyspark.llm import queries
    other = queries.QUERIES["op2_packing"](spark, SF)
    n = other.count()
    d = docs([(k, " ".join(f"w{(k * j) % 31}" for j in range(80))) for k in range(1, 30)])
    for name, stage in corpus_pipeline.STAGES[:3]:
        d = common.materialize(stage(spark, d, "/root/testdata/sf0.001"), f"live-{name}", keep=True)
    assert other.count() == n and d.count() >= 0
    with common.scratch() as made:
        t = common.materialize(d, "scoped")
        with common.scratch() as inner:
            common.materialize(d, "inner")
        kept = common.materialize(d, "kept", keep=True)
    assert len(made) == len(inner) == 1 and t.count() == kept.count()
    common.drop_scratch(spark, made)
    assert kept.count() == d.count()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "sequence_id", "offset", "ids_crc32"}
    assert out.count() > 0


def test_stages_take_empty_and_odd_tables(spark, docs):
    from .conftest import ODD
    rows = [(i, t) for i, t in ODD] + [(50 + k, " ".join(f"word{(k * j) % 23}" for j in range(60))) for k in range(1, 30)]
    for table in (docs([]), docs(rows)):
        d = table
        for name, stage in corpus_pipeline.STAGES:
            d = common.materialize(stage(spark, d, SF), f"odd-{name}", keep=True)
        assert d.count() >= 0
