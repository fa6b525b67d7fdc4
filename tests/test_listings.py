"""Listing bodies (P2) against a brute-force scan, token-stream bodies (P3), outcome classes (P4), infer."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from tallyspark.operators import listing_blocks as B
from tallyspark.operators import listings as L

LISTING = ("// 0001a0: f\nint f(void)\n{\n  if (x) { y(); }\n}\n"
           "// 0001b0: g\nint g(void) { return 1; }\n"
           "// 1c0: h\nvoid h(void)\n{\n  open")


def brute(code, wanted):
    out = {}
    for m in re.finditer(r"// ([0-9A-Fa-f]+):", code):
        a = int(m.group(1), 16)
        if a not in wanted:
            continue
        i, depth, start, seen_nl, end = m.end(), 0, m.end(), False, -1
        while i < len(code):
            c = code[i]
            if c == "\n" and not seen_nl:
                start, seen_nl = i + 1, True
            if c == "{":
                depth += 1
            if c == "}":
                depth -= 1
                if depth == 0:
                    end = i + 1
                    break
            i += 1
        out[hex(a)] = code[start:end].strip()
    return out


def test_listing_bodies_match_brute_force(spark):
    wanted = ["0x1a0", "0x1c0", "0x1b0"]
    df = spark.createDataFrame([(1, LISTING, wanted), (2, "", wanted), (3, None, None)],
                               "listing_id long, code string, addresses array<string>")
    got = {(r.listing_id, r.address): r.body for r in L.listing_bodies(df).collect()}
    want = {(1, k): v for k, v in brute(LISTING, {int(a, 16) for a in wanted}).items()}
    assert got == want
    assert got[(1, "0x1a0")] == "int f(void)\n{\n  if (x) { y(); }\n}"
    assert got[(1, "0x1c0")] == "void h(void)\n{\n  ope"     # unbalanced: one character short


def test_token_bodies(spark):
    toks = [(1, 0, "cmnt", "// Address range: 0x10 - 0x20"), (1, 1, "t", "int f()"), (1, 2, "p", "{"),
            (1, 3, "t", " x; "), (1, 4, "p", "{"), (1, 5, "p", "}"), (1, 6, "p", "}"), (1, 7, "t", "junk"),
            (1, 8, "cmnt", "// Address range: 0x30 - 0x40"), (1, 9, "t", " g "), (1, 10, "p", "{"),
            (1, 11, "p", "}"), (1, 12, "cmnt", "// Address range: 0x50"), (1, 13, "p", "{")]
    t = spark.createDataFrame(toks, "listing_id long, pos long, kind string, val string")
    req = spark.createDataFrame([(1, "0x10"), (1, "0x30"), (1, "0x50")], "listing_id long, address string")
    got = {r.address: r.body for r in L.token_bodies(t, req).collect()}
    assert got == {"0x10": "int f(){ x; {}}", "0x30": "g {}"}
    rows = [(1, [(k, v) for _, _, k, v in toks], ["0x10", "0x30", "0x50"]), (2, [], ["0x10"]), (3, None, None),
            (4, [("cmnt", None), ("t", None)], [])]
    lists = spark.createDataFrame(rows, "listing_id long, tokens array<struct<kind: string, val: string>>, addresses array<string>")
    assert {(r.listing_id, r.address): r.body for r in L.token_list_bodies(lists).collect()} == \
        {(1, a): b for a, b in got.items()}


def test_outcome_reasons(spark):
    runs = spark.createDataFrame([
        ("s", True, 0, "x", ""), ("s", False, 0, "", ""), ("s", False, 1, "", ""), ("s", False, 2, "o", "e"),
        ("s", False, 0, "Failed to decompile the function.", ""), ("s", False, 0, "int f", "")],
        "system string, timed_out boolean, returncode int, stdout string, stderr string")
    got = [(r.reason, r.message) for r in L.classify_runs(runs).collect()]
    assert got == [("time_limit", "Exceeded time limit"), ("empty_result", "Empty decompile result"),
                   ("error", "No details provided"), ("error", "o\ne"), ("runner_failure", None), ("ok", None)]


def test_infer_isolates_row_failures(spark):
    def fake(s: pd.Series) -> pd.Series:
        if (s == "boom").any():
            raise RuntimeError("bad row")
        return s.str.upper()

    df = spark.createDataFrame([(k, "boom" if k == 3 else f"p{k}") for k in range(10)], "id long, prompt string")
    out = {r.id: (r.output, r.error) for r in L.infer(df, fake, batch_rows=4).collect()}
    assert out[3][0] is None and "bad row" in out[3][1]
    assert out[2] == ("P2", None) and out[9] == ("P9", None)


def random_listing(rng, parts):
    return "".join(rng.choice(["// 1a:", "// 02B:", "// 3c: f", "{", "}", "{", "}", "\n", "\n", " x", "é\U0001f600", "// zz:", "// Aa0: q\n{"])
                   for _ in range(parts))


def test_blocks_equal_the_loop(spark):
    """Random listings, from one character a block (one line) to one block a listing."""
    rng = random.Random(11)
    rows = [(k, random_listing(rng, rng.randrange(0, 120)), ["0x1a", "2b", "0X003C", "0xaa0", "0xff"]) for k in range(250)]
    df = spark.createDataFrame(rows, "listing_id long, code string, addresses array<string>")
    want = {(k, a): v for k, code, _ in rows for a, v in brute(code, {0x1A, 0x2B, 0x3C, 0xAA0}).items()}
    for block_chars in (1, 40, 1 << 16):
        got = [((r.listing_id, r.address), r.body) for r in L.listing_bodies(df, block_chars=block_chars).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_a_listing_in_64_blocks(spark):
    rng = random.Random(5)
    code = "\n".join(f"// {k:x}: f\nint f{k}()\n{{\n" + random_listing(rng, 300) + "\n}" for k in range(200))
    df = spark.createDataFrame([(1, code, [hex(k) for k in range(0, 200, 3)])], "listing_id long, code string, addresses array<string>")
    blocks = B.listing_blocks(df, block_chars=len(code) // 64 - 60)
    assert blocks.count() >= 60
    assert "".join(r.piece for r in blocks.orderBy("block").collect()) == code
    got = B.block_listing_bodies(blocks, df.select("listing_id", F.explode("addresses").alias("address")))
    assert {r.address: r.body for r in got.collect()} == brute(code, set(range(0, 200, 3)))
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "FlatMapGroups" not in plan


def plain_token_bodies(tokens, wanted):
    out, body, depth, opened, address = {}, None, 0, False, None
    for kind, val in tokens:
        m = re.search(r"0x\w+", val or "")
        if kind == "cmnt" and "// Address range:" in (val or "") and m and m[0] in wanted:
            body, depth, opened, address = "", 0, False, m[0]
            continue
        if body is None:
            continue
        depth += (val == "{") - (val == "}")
        opened |= val == "{"
        body += val or ""
        if depth == 0 and opened:
            out[address], body = body.strip(), None
    return out


def test_token_streams_equal_the_loop(spark):
    rng = random.Random(3)
    lists = []
    for k in range(120):
        toks = [rng.choice([("t", "{"), ("t", "}"), ("t", "{"), ("t", "}"), ("t", " a"), ("t", None), ("cmnt", "// note"), ("cmnt", None),
                            ("cmnt", f"// Address range: 0x{rng.randrange(6)} - 0x9")]) for _ in range(rng.randrange(0, 90))]
        lists.append((k, toks, [f"0x{j}" for j in range(0, 6, 2)] + ["0x5"]))
    want = {(k, a): b for k, toks, wanted in lists for a, b in plain_token_bodies(toks, wanted).items()}
    assert len(want) > 100
    df = spark.createDataFrame(lists, "listing_id long, tokens array<struct<kind: string, val: string>>, addresses array<string>")
    assert {(r.listing_id, r.address): r.body for r in L.token_list_bodies(df).collect()} == want
    stream = df.select("listing_id", F.posexplode("tokens").alias("pos", "t")).select("listing_id", F.col("pos").cast("long"), "t.*")
    requests = df.select("listing_id", F.explode("addresses").alias("address"))
    for block_tokens in (1, 7, 4096):
        got = [((r.listing_id, r.address), r.body) for r in L.token_bodies(stream, requests, block_tokens=block_tokens).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_listing_bodies_take_any_key(spark):
    df = spark.createDataFrame([("a.c", "// 10: f\nint f()\n{ }\n", ["0x10"])], "name string, code string, addresses array<string>")
    assert [(r.name, r.address) for r in L.listing_bodies(df, key="name").collect()] == [("a.c", "0x10")]


def fake_calls(kind):
    """A call that reports how many of its kind run; 'boom' fails, 'slow' takes long, 'none' gives nothing."""
    import asyncio
    import threading
    import time
    state = {"now": 0}

    def enter(x):
        with state.setdefault("lock", threading.Lock()):
            state["now"] += 1
            return state["now"]

    def leave(x, n):
        with state["lock"]:
            state["now"] -= 1
        if x == "boom":
            raise ValueError("bad " + x)
        return None if x == "none" else f"{x}:{n}"

    async def later(x):
        n = enter(x)
        try:
            await asyncio.sleep(10 if x == "slow" else 0.1)
        except asyncio.CancelledError:
            with state["lock"]:
                state["now"] -= 1
            raise
        return leave(x, n)

    def plain(x):
        n = enter(x)
        time.sleep(4 if x == "slow" else 0.1)
        return leave(x, n)

    return later if kind == "coroutine" else plain


def test_calls_in_flight(spark):
    import time
    n, k = 300, 10
    special = {7: "boom", 30: "slow", 31: "none", 99: None}
    df = spark.createDataFrame([(i, special.get(i, f"p{i}")) for i in range(n)], "id long, prompt string").coalesce(1)
    for kind in ("coroutine", "plain"):
        call = fake_calls(kind)
        start = time.time()
        out = L.infer_in_flight(df, call, in_flight=k, time_limit=2.0).collect()
        took = time.time() - start
        assert [r.id for r in out] == list(range(n))
        for r in out:
            if r.id in (7, 30, 31):
                assert r.output == "ERROR"
            else:
                value, running = r.output.split(":")
                assert value == str(r.prompt) and int(running) <= k and r.error is None
        assert out[7].error == "ValueError: bad boom" and "2.0 s" in out[30].error and out[31].error == "no result"
        assert max(int(r.output.split(":")[1]) for r in out if r.output != "ERROR") == k
        assert took < 15  # the worker's start included; one by one it would take 30 s and more
    assert L.infer_in_flight(df.filter("id < 0"), fake_calls("plain")).count() == 0


def test_run_time_sketches_merge(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice(["ok", "error"]), rng.lognormvariate(1, 2)) for _ in range(30_000)] + [("a", "ok", None), ("c", "ok", 3.0)]
    df = spark.createDataFrame(rows, "system string, reason string, seconds double")
    part = F.pmod(F.hash("seconds"), F.lit(7))
    parts = None
    for b in range(7):
        t = L.run_times(df.filter(F.coalesce(part, F.lit(0)) == b))
        parts = t if parts is None else parts.unionByName(t)
    merged = L.merge_run_times(parts)
    exact = {}
    for s, r, x in rows:
        if x is not None:
            exact.setdefault((s, r), []).append(x)
    got = {(r.system, r.reason): r for r in merged.collect()}
    assert {k: (v.runs, v.least, v.most) for k, v in got.items()} == {k: (len(v), min(v), max(v)) for k, v in exact.items()}
    for r in L.run_time_quantiles(merged, (0.01, 0.25, 0.5, 0.9, 0.99)).collect():
        xs = exact[r.system, r.reason]
        assert abs(sum(x <= r.value for x in xs) / len(xs) - r.rank) <= 2 * L.RANK_ERROR + 1 / len(xs) or len(xs) == 1


def test_token_rows_are_read_once(spark):
    """Blocks of 4 tokens, bodies over several blocks, null keys and places; the operator runs over its tokens a single time."""
    seen = spark.sparkContext.accumulator(0)
    mark = lambda a: ("cmnt", f"// Address range: {a} - 0xff")
    text = lambda s: [("text", w if w != "-" else None) for w in s.split()]
    lists = {1: [mark("0x1"), *text("f ( ) { a - b { c } d e f g h } i"), mark("0x2"), *text("} { x }")],
             2: [*text("{ }"), mark("0x1"), *text("j k l m n o { p"), mark("0x1"), *text("q { } r")], 3: text("{ }")}
    rows = [(k, i, *t) for k, ts in lists.items() for i, t in enumerate(ts)]

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "listing_id long, pos long, kind string, val string"
    tokens = spark.createDataFrame([*rows, (None, 0, "text", "{"), (1, None, "text", "{")], schema).mapInArrow(counted, schema)
    requests = spark.createDataFrame([(1, "0x1"), (1, "0x2"), (2, "0x1"), (2, "0x1"), (3, "0x1"), (None, "0x1")], "listing_id long, address string")
    got = sorted(tuple(r) for r in L.token_bodies(tokens, requests, block_tokens=4).select("listing_id", "address", "body").collect())
    assert got == [(1, "0x1", "f(){ab{c}defgh}"), (1, "0x2", "}{"), (2, "0x1", "q{}")]
    assert seen.value == len(rows) + 2


def test_tokens_in_any_order(spark):
    """Tokens of a block in several tasks and out of order, with gaps, long, empty and missing values."""
    rng = random.Random(17)
    rows, want = [], {}
    for k in range(-3, 40):
        toks = [rng.choice([("t", "{"), ("t", "}"), ("t", "{"), ("t", "}"), ("t", " é\U0001f600"), ("t", None), ("t", "x" * 300), ("t", ""),
                            ("cmnt", f"// Address range: 0x{rng.randrange(4)} - 0x9")]) for _ in range(rng.randrange(0, 90))]
        own = [*zip(sorted(rng.sample(range(-20, 120), len(toks))), toks)]
        rows += [(f"k{k}", p, *t) for p, t in own]
        for a, body in plain_token_bodies([t for _, t in own], {"0x1", "0x2"}).items():
            want[f"k{k}", a] = body
    assert len(want) > 5
    rng.shuffle(rows)
    stream = spark.createDataFrame(rows, "name string, pos int, kind string, val string").repartition(5)
    requests = spark.createDataFrame([(f"k{k}", a) for k in range(-3, 40) for a in ("0x1", "0x2")], "name string, address string")
    for block_tokens in (1, 16, 4096):
        got = [((r.name, r.address), r.body) for r in L.token_bodies(stream, requests, key="name", block_tokens=block_tokens).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_tokens_are_shuffled_in_packets(spark):
    """Bodies over several blocks are cut from packed tokens; no shuffle has an entry for each token."""
    rng = random.Random(4)
    names = ["".join(rng.choice(["ka", "lo", "mi", "ne", "ru"]) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    text = [" ".join(rng.choice(names) for _ in range(2000)) for _ in range(60)]
    lists = spark.createDataFrame(list(enumerate(text)), "listing_id long, text string")
    rows = lists.select("listing_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    m = F.col("pos") % 40
    mark = F.concat(F.lit("// Address range: 0x"), F.lower(F.hex(F.col("pos"))), F.lit(" - 0xff"))
    stream = rows.select("listing_id", F.col("pos").cast("long").alias("pos"), F.when(m == 0, "cmnt").otherwise("text").alias("kind"),
                         F.when(m == 0, mark).when(m == 2, "{").when(m == 30, "}").otherwise(F.col("word")).alias("val"))
    requests = rows.filter(m == 0).select("listing_id", F.concat(F.lit("0x"), F.lower(F.hex(F.col("pos")))).alias("address"))

    got = L.token_bodies(stream, requests, block_tokens=64)
    want = {(k, f"0x{p:x}"): "".join("{" if q % 40 == 2 else "}" if q % 40 == 30 else w for q, w in enumerate(t.split(" "))
                                     if p < q <= p + 30) for k, t in enumerate(text) for p in range(0, 2000, 40)}
    assert {(r.listing_id, r.address): r.body for r in got.collect()} == want
    assert "tokens" not in got._jdf.queryExecution().executedPlan().toString()  # before, arrays of them were joined
