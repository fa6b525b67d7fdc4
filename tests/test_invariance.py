"""Results do not depend on the number of shuffle partitions or on input partitioning."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["g4_cer_rate", "g9_pairwise_table", "q1_matchups", "g6_target_diff", "j10_pivot_results",
         "q2_chunk_order", "p3_token_bodies", "g12_bootstrap_ratings"]


@pytest.mark.parametrize("name", NAMES)
def test_shuffle_partition_invariance(spark, name):
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(map(tuple, q(spark, SF).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = sorted(map(tuple, q(spark, SF).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_grid_completion_equals_join_form(spark):
    from pyspark.sql import functions as F
    from tallyspark.operators import scoring
    from tallyspark.plans import fixtures as fx
    runs = fx.runs(spark, SF)
    a = scoring.complete_outcomes(runs, ["suite", "item_id"], fx.RUN_SYSTEMS, fx.RUN_VARIANTS)
    tested = runs.groupBy("suite", "item_id", "system", "variant").agg(F.bool_and("ok").alias("ok"))
    grid = scoring.expand_by(scoring.expand_by(runs.select("suite", "item_id").distinct(), fx.RUN_SYSTEMS, "system"),
                             fx.RUN_VARIANTS, "variant")
    b = scoring.fill_missing_outcomes(grid, tested, ["suite", "item_id", "system", "variant"])
    cols = ["suite", "item_id", "system", "variant", "ok"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_cells_beyond_one_word_and_null_cells(spark):
    """More than 64 cells, null systems, rows outside the grid, repeated and failing outcomes."""
    import random
    from pyspark.sql import functions as F
    from tallyspark.operators import scoring
    rng = random.Random(7)
    systems, variants = [f"s{k}" for k in range(13)], [f"v{k}" for k in range(11)]
    rows = [(rng.choice(["a", "b", None]), rng.randrange(6), rng.choice([*systems, "other", None]), rng.choice([*variants, "vx"]),
             rng.choice([True, True, True, False, None])) for _ in range(6000)]
    runs = spark.createDataFrame(rows, "suite string, item_id int, system string, variant string, ok boolean")
    cells = {}
    for suite, item, s, v, ok in rows:
        cells.setdefault((suite, item, s, v), []).append(bool(ok))
    full = {(r.suite, r.item_id, r.system, r.variant): r.ok
            for r in scoring.complete_outcomes(runs, ["suite", "item_id"], systems, variants).collect()}
    items = {(r[0], r[1]) for r in rows}
    assert full == {(*i, s, v): all(cells.get((*i, s, v), [False])) for i in items for s in systems for v in variants}
    grid = spark.createDataFrame([(s, v) for s in [*systems, None] for v in variants if (s, v) != ("s0", "v0")], "system string, variant string")
    got = {(r.system, r.variant): (r.passes, r["items"]) for r in scoring.cer_rate(runs, grid).collect()}
    n = len({i for i in items if i[0] is not None})
    assert got == {(s, v): (sum(all(o) for (a, _, x, y), o in cells.items() if a is not None and (x, y) == (s, v)), n)
                   for s in [*systems, None] for v in variants if (s, v) != ("s0", "v0")}
    plan = runs._sc._jvm.PythonSQLUtils.explainString(scoring.cer_rate(runs, grid)._jdf.queryExecution(), "formatted")
    assert plan.count("bool_and") == 0 and plan.count("Generate") < 6
    none = scoring.cer_rate(runs.filter(F.lit(False)), grid)
    assert {(r.passes, r["items"]) for r in none.select("passes", "items").collect()} == {(0, 0)}
