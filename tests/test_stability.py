"""Baseline stability (G5) and target diff (G6) edge cases, plus a brute-force property check."""

from hypothesis import given, settings, strategies as st

from tallyspark.operators import stability as ST


def ref_diff(trials, target):
    """Plain restatement of the rules (None = probe yields no row)."""
    length, sets = 0, []
    for t in trials:
        if t is None:
            return None
        if length != 0 and len(t) != length:
            return None
        length = len(t)
        if not sets:
            sets = [set() for _ in range(length)]
        for i, ch in enumerate(t):
            sets[i].add(ch)
    if target is None:
        return False
    try:
        return not any(len(sets[i]) == 1 and ch not in sets[i] for i, ch in enumerate(target))
    except IndexError:
        return False


def spark_diff(spark, rows):
    df = spark.createDataFrame(rows, "k int, t1 string, t2 string, t3 string, target string")
    prof = ST.baseline_profile(df, ["k"], ["t1", "t2", "t3"])
    out = ST.diff_targets(prof, df.select("k", "target"), ["k"])
    return {r["k"]: r["passed"] for r in out.collect()}


CASES = [
    ("abc", "abc", "abc", "abc"),
    ("abc", "abc", "abc", "ab"),       # shorter: prefix only
    ("abc", "abc", "abc", ""),         # empty target passes
    ("abc", "abc", "abc", "abcd"),     # longer fails
    ("abc", "abc", "abc", "axc"),      # stable position differs
    ("abc", "axc", "abc", "azc"),      # unstable position ignored
    ("abc", "axc", "abc", "abz"),
    ("", "abc", "abc", "abc"),         # empty first trial ignored
    ("", "", "abc", "abd"),
    ("abc", "", "abc", "abc"),         # length change after non-empty: no row
    ("abc", "abcd", "abc", "abc"),
    ("abc", None, "abc", "abc"),       # error in a trial: no row
    ("abc", "abc", "abc", None),       # error in the target: fails
    ("", "", "", ""),                  # all empty, empty target
    ("", "", "", "a"),
    ("éà", "éà", "éb", "éz"),          # code points, not bytes
]


def test_cases_match_rules(spark):
    got = spark_diff(spark, [(k, *c) for k, c in enumerate(CASES)])
    want = {k: ref_diff(c[:3], c[3]) for k, c in enumerate(CASES)}
    assert got == {k: v for k, v in want.items() if v is not None}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=5), st.text("ab", max_size=5), st.text("ab", max_size=5),
                          st.one_of(st.none(), st.text("abc", max_size=6))), min_size=1, max_size=20))
def test_property_against_rules(spark, rows):
    got = spark_diff(spark, [(k, *r) for k, r in enumerate(rows)])
    want = {k: ref_diff(r[:3], r[3]) for k, r in enumerate(rows)}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_identical_target_always_passes(spark):
    rows = [(k, t, t, t, t) for k, t in enumerate(["", "a", "hello", "x" * 300])]
    assert set(spark_diff(spark, rows).values()) == {True}


def test_long_texts_by_blocks(spark):
    """Texts of several blocks with differences anywhere, also at the blocks' edges."""
    import random
    rng = random.Random(4)
    rows, alphabet = [], "abé\U0001f600\n"
    for k in range(60):
        base = "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 1023, 1024, 1025, 2048, 5000])))

        def changed(text, places):
            t = list(text)
            for p in places:
                t[p % len(t)] = "X"
            return "".join(t)

        places = [rng.choice([0, 1022, 1023, 1024, 1025, 2047, 2048, rng.randrange(5000)]) for _ in range(rng.randrange(6))]
        extra = [rng.randrange(5000)] if k % 3 == 0 else []
        target = changed(base, places[:rng.randrange(6)] + extra)[:rng.choice([len(base), len(base) // 2, 1])]
        rows.append((k, base, changed(base, places[::2]), changed(base, places[1::2]), target))
    got = spark_diff(spark, rows)
    assert got == {r[0]: ref_diff(r[1:4], r[4]) for r in rows} and len(set(got.values())) == 2
    df = spark.createDataFrame(rows, "k int, t1 string, t2 string, t3 string, target string")
    for r in ST.baseline_profile(df, ["k"], ["t1", "t2", "t3"]).collect():
        _, a, b, c, _ = rows[r.k]
        places = [i for i in range(len(a)) if len({a[i], b[i], c[i]}) > 1]
        assert [p for x in r.unstable or [] for p in range(x.start, x.end)] == places and (r.unstable is None) == (not places)
        assert all(x.end < y.start for x, y in zip(r.unstable or [], (r.unstable or [])[1:]))


def test_trials_do_not_travel_in_the_join(spark):
    import re
    df = spark.createDataFrame([(1, "a", "b", "a", "a")], "k int, t1 string, t2 string, t3 string, target string")
    j = ST.diff_targets(ST.baseline_profile(df, ["k"], ["t1", "t2", "t3"]), df.select("k", "target"), ["k"])
    plan = j._sc._jvm.PythonSQLUtils.explainString(j._jdf.queryExecution(), "formatted")
    joins = re.findall(r"Join.*?\n(?:.*\n)*?\n", plan)
    assert "unstable" in plan and not [x for x in joins if re.search(r"\bt[123]#", x)]
