"""Dense ids, chunk order and matchup sampling."""

from collections import Counter

from pyspark.sql import functions as F

from tallyspark.operators import sampling as S


def test_dense_index_is_a_permutation_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    out = S.dense_index(df, ["k"], "seq", partitions=5).collect()
    pairs = sorted((r.k, r.seq) for r in out)
    assert [s for _, s in pairs] == list(range(5000))


def test_chunk_runs_partition_invariant(spark):
    df = spark.range(0, 1234).withColumnRenamed("id", "task_id")
    a = sorted(S.chunk_runs(df).select("chunk_id", "chunk_seq").distinct().collect())
    b = sorted(S.chunk_runs(df.repartition(9)).select("chunk_id", "chunk_seq").distinct().collect())
    assert a == b and sorted(r.chunk_seq for r in a) == list(range(13))


def test_matchups_follow_weights(spark):
    systems = ["a", "b", "c", "d"]
    ratings = [1000.0, 1010.0, 1100.0, 1400.0]
    items = spark.range(0, 40000).withColumnRenamed("id", "item_id")
    m = S.matchups(items, systems, ratings).collect()
    assert all(r.model_a != r.model_b for r in m)
    # P(b | a): weights 1/(1 + d/dmin), dmin = min gap + 1e-6, then the seat swap
    pairs = Counter(frozenset((r.model_a, r.model_b)) for r in m)
    n = len(m)

    def cond(a):
        others = [s for s in systems if s != a]
        ra = ratings[systems.index(a)]
        d = [abs(ra - ratings[systems.index(o)]) for o in others]
        dmin = min(d) + 1e-6
        w = [1 / (1 + x / dmin) for x in d]
        return {o: wi / sum(w) for o, wi in zip(others, w)}

    for x in systems:
        for y in systems:
            if x < y:
                expect = 0.25 * (cond(x)[y] + cond(y)[x])
                assert abs(pairs[frozenset((x, y))] / n - expect) < 0.01, (x, y)
    # after the seat swap, seat A holds the uniform draw half of the time
    first = Counter(r.model_a for r in m)
    for x in systems:
        expect = 0.5 * 0.25 + 0.5 * sum(0.25 * cond(a)[x] for a in systems if a != x)
        assert abs(first[x] / n - expect) < 0.01


def test_eligible_pair(spark):
    df = spark.createDataFrame([("x", "y"), ("", "y"), ("none", "y"), (None, "y")], "a string, b string")
    assert [r[0] for r in df.select(S.eligible_pair(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_hash_uniform_equals_python_md5(spark):
    import hashlib
    from tallyspark.functions.uniform import hash_uniform
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    got = {r.k: r.u for r in df.select("k", hash_uniform("seed", F.col("k")).alias("u")).collect()}
    want = {k: int(hashlib.md5(f"seed|{k}".encode()).hexdigest()[:8], 16) / 2 ** 32 for k in range(500)}
    assert got == want


def test_a_thousand_systems_draw_as_plain_python(spark):
    """Same draws as a cumulative sum per item, tables joined and broadcast, one lookup per row in the plan."""
    import hashlib
    import random
    from bisect import bisect_right
    from itertools import accumulate
    rng = random.Random(1)
    m = 1000
    ratings = [1000 + 400 * rng.random() for _ in range(m)]
    items = spark.range(0, 3000).withColumnRenamed("id", "item_id")
    uniform = lambda tag, k: int(hashlib.md5(f"arena:{tag}|{k}".encode()).hexdigest()[:8], 16) / 2 ** 32
    out = S.matchups(items, [f"s{k}" for k in range(m)], ratings)
    got = {r.item_id: (r.model_a, r.model_b) for r in out.collect()}
    for k in range(0, 3000, 7):
        a = int(uniform("a", k) * m)
        others = [j for j in range(m) if j != a]
        gaps = [abs(ratings[a] - ratings[j]) for j in others]
        dmin = min(gaps) + 1e-6
        cum = list(accumulate(1.0 / (1.0 + g / dmin) for g in gaps))
        b = others[min(bisect_right(cum, uniform("b", k) * cum[-1]), m - 2)]
        pair = (f"s{b}", f"s{a}") if uniform("s", k) < 0.5 else (f"s{a}", f"s{b}")
        assert got[k] == pair
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BroadcastHashJoin" in plan
    before, S.BROADCAST_BYTES = S.BROADCAST_BYTES, 0
    try:
        joined = S.matchups(items, [f"s{k}" for k in range(m)], ratings)
        assert {r.item_id: (r.model_a, r.model_b) for r in joined.collect()} == got
    finally:
        S.BROADCAST_BYTES = before
