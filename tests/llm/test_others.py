"""Operators 2, 6, 8, 9, 10: round trips, invariants, held-out accuracy."""

import collections
import hashlib
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import chat_format as C
from tallyspark.llm import packing as P
from tallyspark.llm import quality as Q
from tallyspark.llm import toxicity as T
from tallyspark.llm import warc as W

from .conftest import ODD

# -- operator 2 ---------------------------------------------------------------------------------------------------

TRICKY = ["a  b", "don't  x \n\n y", "éa ²b3", "", "  ", "\n", "x y .. ,., a.b,c d. e", "I'M we'll 'tis ''s", " lead", "a \n b",
          "a\n b", "Ωmega αβγ abc日本 x", "<|endoftext|> mid <|endoftext|>", "tab\tend\x85x y", "trail ", "1,000.5% (a)[b]{c}"]


def test_ids_equal_the_library():
    e = P.ByteLevelEncoder(P.tokenizer_path("byte_bpe_50k.json"), cache_parts=50)
    rng = random.Random(2)
    texts = TRICKY + ["".join(rng.choice("ab é.,'\n 1ß") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    exp = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [e(t) for t in texts] == exp


def test_words_with_stops_are_encoded_without_parts():
    e = P.ByteLevelEncoder(P.tokenizer_path("byte_bpe_50k.json"))
    text = "x " + " ".join(f"{w}{m}" for w in ("Reed", "schöne", "Übung", "thend") for m in ("", ".", ",", ".,"))
    assert np.frombuffer(e(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert set(e.parts) == {"x", ".", ",", ".,"}  # before, each word too


def test_runs_of_white_space_over_a_space():
    e = P.ByteLevelEncoder(P.tokenizer_path("byte_bpe_50k.json"))
    for text in ("a\n \n b", "a\n \nb", "a \nb", "x\xa0 \xa0 y", ", \xa0 \xa0", " \xa0 \xa0 \u2019.", "a, \xa0 \xa0 \xa0 b"):
        assert np.frombuffer(e(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_another_kind_of_file_goes_to_the_library():
    e = P.ByteLevelEncoder(P.tokenizer_path("word_bpe_49k.json"))
    assert np.frombuffer(e("Hello world"), "<u4").tolist() == e.tokenizer.encode("Hello world", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_places_every_token_once(spark, docs, capacity):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["one", "deux", "drei,", "cuatro."]) for _ in range(rng.choice([1, 5, 20, 40, 300])))) for k in range(300)]
    rows += [(1000 + k, t) for k, (_, t) in enumerate(ODD)] + [(2000 + k, t) for k, t in enumerate(TRICKY)]
    packed = P.pack(docs(rows, ["ids", "rank", "task", "offset"]), "byte_bpe_50k.json", capacity=capacity).collect()
    e = P.ByteLevelEncoder(P.tokenizer_path("byte_bpe_50k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in rows:
        ids = e(t or "") + struct.pack("<I", 0)
        ps = sorted(pieces[i], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert b"".join(p._ids for p in ps) == ids
        assert [p.start for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert all(p.length == capacity for p in ps[1:]) and (len(ps) == 1 or len(ids) // 4 > capacity)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r._offset):
            assert r._offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in packed)
    assert len(sequences) <= 1.1 * total / capacity + 2
    assert P.pack(docs([]), "byte_bpe_50k.json").count() == 0


def test_sequences_join_their_pieces(docs):
    packed = P.pack(docs([(1, "a b c"), (2, "d e"), (3, "f " * 60)]), "byte_bpe_50k.json", capacity=50).cache()
    joined = P.sequences(packed, 50).collect()
    assert sum(r.n_tokens for r in joined) == sum(r.length for r in packed.collect())
    assert all(len(r.ids) == 4 * r.n_tokens and r.n_tokens <= 50 for r in joined)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_and_is_near_its_bound(seed):
    rng = np.random.default_rng(seed)
    demand = np.zeros(257, np.int64)
    demand[rng.integers(1, 257, 120)] = rng.integers(0, 400, 120)
    bins, bound = P.plan_bins(demand, 256)
    used = np.zeros(257, np.int64)
    for config, times in bins:
        assert sum(k * n for k, n in config.items()) <= 256 and times > 0
        for k, n in config.items():
            used[k] += n * times
    assert (used == demand).all()
    count = sum(t for _, t in bins)
    assert bound <= count <= 1.05 * bound + 2
    assert -(-int((demand * np.arange(257)).sum()) // 256) <= count


def test_best_fit_equals_the_plain_form():
    rng = np.random.default_rng(0)
    demand = np.zeros(101, np.int64)
    demand[rng.integers(1, 101, 40)] = rng.integers(1, 30, 40)
    rooms = []
    for k in np.flatnonzero(demand)[::-1]:
        for _ in range(demand[k]):
            fit = [r for r in rooms if r >= k]
            room = min(fit) if fit else 100
            if fit:
                rooms.remove(room)
            rooms.append(room - k)
    assert sum(t for _, t in P.best_fit(demand, 100)) == len(rooms)


# -- operator 6 ---------------------------------------------------------------------------------------------------

def test_toxicity_separates_held_out_documents(spark, docs):
    rng = random.Random(0)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "ta", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    bad = ["zugglic", "worbler", "fnargly"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        n = rng.randint(40, 200)
        w = [rng.choice(bad) if toxic and rng.random() < 0.06 else rng.choice(words) for _ in range(n)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d = docs(rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(d.filter(~held), lab.filter(~held))
    out = T.score(d.filter(held).withColumn("score", F.lit("mine")), model).join(lab, "doc_id").collect()
    assert {r.score for r in out} == {"mine"}
    got = [(r._score, r.toxic) for r in out]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in got if x for b, y in got if not y]
    assert sum(pairs) / len(pairs) > 0.95


def test_toxicity_odd_rows(spark, docs):
    model = T.train_on(["bad words here"] * 5, ["good words there", "more good words"] * 5)
    out = T.score(docs([(k, t) for k, (_, t) in enumerate(ODD)]), model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    empty = T.train(docs([]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in T.score(docs([(1, "x"), (2, None)]), empty).collect())
    assert T.score(docs([]), model).count() == 0


def plain_score(text, model):
    """A score window by window, a new compressor for each, and the calibration written out."""
    import math
    import zstandard
    w = (text or "").encode().lower().split()
    cuts = [b" " + b" ".join(w[i:i + 16]) + b" " for i in range(0, len(w), 16)]

    def length(content, window):
        p = zstandard.ZstdCompressionParameters(window_log=22, chain_log=18, hash_log=19, search_log=3, min_match=4, target_length=8,
                                                strategy=zstandard.STRATEGY_GREEDY, write_content_size=False)
        if len(content) < 8:
            return len(zstandard.ZstdCompressor(compression_params=p).compress(window))
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(window))

    d = [length(model.ordinary, c) - length(model.toxic, c) for c in cuts]
    if not d:
        x = [0.0] * 7
    else:
        best = sorted(d, reverse=True)[:max(1, len(d) // 5)]
        top, n = sum(best) / len(best), math.log(1 + len(d))
        x = [top, sum(d) / len(d), max(d), sum(v >= 2 for v in d) / len(d), sum(v >= 4 for v in d) / len(d), n, top * n]
    z = model.weights[7] + sum(w * (v - c) / s for w, v, c, s in zip(model.weights, x, model.centre, model.scale))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_equals_a_plain_version(spark, docs):
    """Scores against a plain restatement, and the calibration against plain gradient steps."""
    import numpy as np
    rng = random.Random(3)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ne"]) for _ in range(3)) for _ in range(500)]

    def some(toxic):
        return " ".join("zugglic" if toxic and rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(1, 90)))

    tox, plain = [some(True) for _ in range(60)], [some(False) for _ in range(120)]
    model = T.train_on(tox, plain)
    texts = tox[:10] + plain[:10] + [None, "", " ", "zugglic", "ka " * 3000]
    out = {r.doc_id: r.score for r in T.score(docs(list(enumerate(texts))), model).collect()}
    assert out == pytest.approx({k: plain_score(t, model) for k, t in enumerate(texts)}, abs=1e-12)
    # the fit is where the weighted, ridged likelihood is flat
    compressors = [T._compressor(model.toxic), T._compressor(model.ordinary)]
    held = [(t, 1) for t in tox[40:]] + [(t, 0) for t in plain[80:]]
    x = (np.array([T.statistics(t, *compressors) for t, _ in held]) - model.centre) / model.scale
    slope = np.zeros(8)
    for row, (_, y) in zip(x, held):
        p = 1 / (1 + np.exp(-(row @ model.weights[:7] + model.weights[7])))
        slope += (1.0 if y else 1.25) * (y - p) * np.append(row, 1.0)
    assert np.abs(slope - np.append(model.weights[:7], 1e-6 * model.weights[7])).max() < 1e-4


def test_toxicity_sample_is_bounded_in_bytes(spark, docs, monkeypatch):
    rows = [(k, ("bad " if k % 2 else "good ") * (200 if k % 10 else 60_000)) for k in range(60)] + [(3, "bad again"), (100, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(100, 1)], "doc_id long, toxic int")
    seen = {}

    def keep(tox, plain, **_):
        seen.update(tox=tox, plain=plain)
    monkeypatch.setattr(T, "train_on", keep)
    T.train(docs(rows), labels, max_bytes=20_000)
    assert sum(len(t or "") for t in seen["tox"]) <= 10_000 and sum(len(t or "") for t in seen["plain"]) <= 10_000
    assert len(seen["tox"]) >= 10 and len(seen["plain"]) >= 9  # long texts are passed over, shorter ones still come
    T.train(docs(rows), labels)
    assert len(seen["tox"]) + len(seen["plain"]) == 62


# -- operator 8 ---------------------------------------------------------------------------------------------------

def pages_rows():
    big = "<p>" + "same payload " * 100
    rows = [(k, f"http://h/{k}", f"<html>{k} " + "text " * (k * 20)) for k in range(30)]
    rows += [(100 + k, "http://d/", big) for k in range(5)] + [(104, "http://again/", big), (None, "http://null/", big)]
    rows += [(200, None, None), (201, "http://x/\r\nWARC-Type: evil", ""), (202, "u", "small"), (203, "u", "small"),
             (300, "u", "ünï cödé\r\n\r\n" * 200)]
    return rows


@pytest.mark.parametrize("archive_bytes", [1 << 25, 6000])
def test_warc_round_trip(spark, archive_bytes):
    rows = pages_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = W.write_archives(pages, archive_bytes=archive_bytes)
    back = W.read_archives(manifest).collect()
    exp = collections.Counter()
    for i, u, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if g == h and len(raw) >= 1000]
        keeper = max((j for j in same if j is not None), default=None)
        ref = keeper if len(same) > 1 and i != keeper else None
        exp[None if i is None else str(i), u, "revisit" if ref is not None else "response",
            None if ref is None else str(ref), len(raw), hashlib.sha1(raw).hexdigest()] += 1
        if ref is None:
            assert any(r.payload == raw and r.page_id == (None if i is None else str(i)) for r in back)
    assert collections.Counter((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in back) == exp
    assert W.read_archives(W.write_archives(pages.limit(0))).count() == 0


def test_warc_keepers_beyond_the_broadcast(spark, monkeypatch):
    rows = [(k, "u", "page that is copied " * 100 if k % 3 else f"short {k}") for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def read():
        return sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in W.read_archives(W.write_archives(pages)).collect())

    wide = read()
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    assert read() == wide
    assert sum(t == "revisit" for _, t, _, _ in wide) == sum(k % 3 > 0 for k in range(400)) - 1


def test_short_pages_share_no_key(spark):
    """Nine tenths of the payloads are short: they are not shuffled to one task."""
    pages = spark.range(0, 20_000, numPartitions=8).selectExpr("id page_id", "'u' url", "if(id % 10 = 0, repeat(cast(id as string), 400), 'x') html")
    manifest = W.write_archives(pages, archive_bytes=1 << 20)
    n = [r.n_records for r in manifest.collect()]
    assert sum(n) == 20_000 and max(n) < 10_000


def test_warc_files_follow_the_format(spark, tmp_path):
    import zstandard
    pages = spark.createDataFrame(pages_rows(), "page_id long, url string, html string").coalesce(1)
    W.write_archives(pages, str(tmp_path / "w"))
    files = list((tmp_path / "w").glob("*.warc.zst"))
    assert files
    for f in files:
        data = f.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size], max_output_size=1 << 20))
        rest, n = data[8 + size:], 0
        while rest:  # one frame per record
            d = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            record = d.decompress(rest)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            rest, n = d.unused_data, n + 1
        assert n > 0


def test_warc_validation():
    r = W._record("1", "u", b"payload", None)
    assert W.parse_record(r)[2] == b"payload"
    bad = [r[:-1], r + b"x", r.replace(b"WARC/1.1", b"WARC/9.9"), r.replace(b"payload", b"pAyload"),
           re.sub(rb"WARC-Type: \w+\r\n", b"", r), r.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
           re.sub(rb"\r\nContent-Length: (\d+)\r\n", rb"\r\nContent-Length: 1\1\r\n", r, count=1),
           r.replace(b"WARC-Date", b"WARC-Type")]
    for b in bad:
        with pytest.raises(W.WarcError):
            W.parse_record(b)


# -- operator 9 ---------------------------------------------------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", "plain", "", "\\", "\\\\", "<\\s>", "[/INST", " [/INST]", "<<SYS>>x<</SYS>>", "[INST", "<s></s><s>",
        "[[INST]", "<</SYS>>\\[ROLE]", "tail\\", "a\\b \\[INST]", "[ROLE][AS][/ROLE]", "é \r\n", " <", "s>"]
ROLES = ["system", "user", "assistant", "tool", "", "[AS]", "\\", "assistant "]


def test_every_pair_of_turns_reads_back():
    rng = random.Random(0)
    for _ in range(3000):
        turns = [(rng.choice(ROLES), rng.choice(HARD) + rng.choice(HARD)) for _ in range(rng.randint(0, 5))]
        text, mask = C.format_turns(turns)
        assert C.parse(text) == turns
        assert "".join(C.unescape(text[a:b]) for a, b in mask) == "".join(t for r, t in turns if r == "assistant")


def test_plain_text_is_not_escaped():
    text, _ = C.format_turns([("user", "a < b [c] \\n?"), ("assistant", "fine")])
    assert text == "<s>[INST] a < b [c] \\\\n? [/INST] fine</s>"
    assert C.format_turns([("user", "a < b [c]")])[0] == "<s>[INST] a < b [c] [/INST]"


def test_broken_texts_do_not_parse():
    for s in ["", "[INST] a [/INST]", "<s>[INST] a", "<s>x", "<s> a</s>b", "<s>[INST] a <s> b [/INST]"]:
        with pytest.raises(C.GrammarError):
            C.parse(s)


def test_conversations_read_back(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(ROLES[:5]), rng.choice(HARD), "x") for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(7, None, "user", "null turn", "x"), (7, 0, "user", "tie", "x"), (None, 0, "user", "no id", "x"), (99, 0, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0


# -- operator 10 --------------------------------------------------------------------------------------------------

def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    count = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    hit = {j for k in range(len(w) - 7) if count[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), dup, len(hit))


def test_text_counts_equal_brute_force():
    rng = random.Random(9)
    texts = [t for _, t in ODD if t is None or len(t) < 2000] + ["".join(rng.choice(["a ", "b ", "c\n", "# ", "é\t", "A ", "\n"])
                                                                         for _ in range(rng.randint(0, 120))) for _ in range(400)]
    for t in texts:
        assert Q.text_counts(t)[:6] == brute_counts(t), t


def test_quality_keeps_the_usual_and_rejects_outliers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(700):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", "a"), (None, None)])
        size = {"en": 4, "de": 7, None: 5}[lang]
        w = ["".join(rng.choice("abcdefghij") for _ in range(max(1, int(rng.gauss(size, 1.5))))) for _ in range(rng.randint(30, 300))]
        junk = i % 10 == 0
        if junk:
            w = [x + rng.choice(["***", "$$$", "|||"]) for x in w]
        rows.append((i, " ".join(w), lang, source, junk))
    rows += [(1000, None, "en", "a", None), (1001, "few words", "xx", "lone", None), (1002, ("same eight words in a row again now " * 9), "en", "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept boolean")
    out = {r.doc_id: r for r in Q.quality(df).collect()}
    assert len(out) == len(rows)
    for i, t, *_ in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == brute_counts(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r._kept)
    good = [out[r[0]]._kept for r in rows if r[4] is False]
    bad = [out[r[0]]._kept for r in rows if r[4]]
    assert sum(good) >= 0.995 * len(good) and not any(bad)


def test_quality_without_rows(spark, docs):
    assert Q.quality(docs([])).count() == 0
    assert [r.kept for r in Q.quality(docs([(1, None), (2, "x")])).collect()] == [False, False]


def test_chi2():
    assert abs(Q.chi2_quantile(0.95, 2) - 5.9915) < 1e-3 and abs(Q.chi2_quantile(0.95, 6) - 12.5916) < 1e-3


