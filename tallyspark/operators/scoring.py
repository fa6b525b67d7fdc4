"""Pass-rate scoring: recompile rate (G1), all-probes-pass (G3), coverage rate.

Shapes (long tables; one row per outcome):
  runs:    suite, item_id, probe, variant, system, ok(boolean)
  flags:   ..., system, variant, flag(0/1)

Every aggregate here is partial-aggregable (sum / count / bool_and), so a hot
key collapses to one row per map task before the shuffle; no group is ever
materialised whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dims_grid(spark: SparkSession, systems: Sequence, variants: Sequence,
              system_col: str = "system", variant_col: str = "variant") -> DataFrame:
    """system x variant grid from the run config (config-sized, built on the driver)."""
    return spark.createDataFrame([(s, v) for s in systems for v in variants], [system_col, variant_col])


def expand_by(df: DataFrame, values: Sequence, col: str) -> DataFrame:
    """Each row once per configured value (a generator over a literal list; no join)."""
    return df.withColumn(col, F.explode(F.array(*[F.lit(v) for v in values])))


def recompile_rate(flags: DataFrame, flag_col: str = "flag",
                   keys: Sequence[str] = ("system", "variant")) -> DataFrame:
    """G1: mean of a 0/1 flag per (system, variant); ineligible rows count as 0."""
    return (flags.groupBy(*keys)
            .agg(F.avg(F.coalesce(F.col(flag_col).cast("double"), F.lit(0.0))).alias("rate"),
                 F.count(F.lit(1)).alias("n")))


def all_pass(runs: DataFrame, item_keys: Sequence[str] = ("suite", "item_id"),
             cell_keys: Sequence[str] = ("system", "variant"), ok_col: str = "ok") -> DataFrame:
    """An item passes a (system, variant) iff every probe that reported passed (a null outcome is a failure)."""
    return (runs.groupBy(*item_keys, *cell_keys)
            .agg(F.bool_and(F.coalesce(F.col(ok_col), F.lit(False))).alias("passed")))


WORD_BITS = 64


def _cell_number(keys: Sequence[str], values: Sequence[Sequence]) -> Column:
    """Number of a row's cell in the product of the configured ``values`` of each key; null outside of it."""
    number = F.lit(0)
    for key, vs in zip(keys, values):
        known = F.array_position(F.array(*[F.lit(v) for v in vs if v is not None]), F.col(key)) - 1
        known = F.when(known >= 0, known)
        if None in vs:
            known = F.when(F.col(key).isNull(), F.lit(len(vs) - 1)).otherwise(known)
        number = number * len(vs) + known
    return number.cast("int")


def _cell_masks(runs: DataFrame, item_keys: Sequence[str], cell_keys: Sequence[str], values: Sequence[Sequence],
                ok_col: str) -> tuple[DataFrame, int]:
    """Per item the cells that passed as bits (``_w0``, ... of 64 cells each): seen by some outcome, failed by none.

    Two aggregates per 64 cells, combined on the map side, in place of one per cell.
    """
    n_cells = 1
    for vs in values:
        n_cells *= len(vs)
    words = -(-n_cells // WORD_BITS)
    r = runs.select(*item_keys, _cell_number(cell_keys, values).alias("_cell"), F.coalesce(F.col(ok_col), F.lit(False)).alias("_ok"))
    aggs = []
    for w in range(words):
        bit = F.when(F.col("_cell").between(w * WORD_BITS, w * WORD_BITS + WORD_BITS - 1),
                     F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_cell") - w * WORD_BITS)).otherwise(F.lit(0).cast("long"))
        aggs += [F.bit_or(bit).alias(f"_seen{w}"), F.bit_or(F.when(~F.col("_ok"), bit).otherwise(F.lit(0).cast("long"))).alias(f"_failed{w}")]
    per_item = r.groupBy(*item_keys).agg(*aggs)
    return per_item.select(*item_keys, *[F.col(f"_seen{w}").bitwiseAND(F.bitwise_not(F.col(f"_failed{w}"))).alias(f"_w{w}")
                                         for w in range(words)]), words


def _bit(number: int) -> Column:
    """Whether a cell's bit is set."""
    return F.shiftrightunsigned(F.col(f"_w{number // WORD_BITS}"), number % WORD_BITS).bitwiseAND(F.lit(1).cast("long")) == 1


def _numbers(cells: Sequence[Sequence], values: Sequence[Sequence]) -> list[int]:
    out = []
    for c in cells:
        n = 0
        for v, vs in zip(c, values):
            n = n * len(vs) + vs.index(v)
        out.append(n)
    return out


def cer_rate(runs: DataFrame, grid: DataFrame, items: DataFrame | None = None,
             item_keys: Sequence[str] = ("suite", "item_id"),
             cell_keys: Sequence[str] = ("system", "variant"), ok_col: str = "ok") -> DataFrame:
    """Passes summed over suites / number of distinct items in the whole dataset.

    ``grid`` is the configured system x variant grid (zero-filled output);
    ``items`` is the item table (untested items count as failures). When it is
    omitted the distinct items of ``runs`` are used. Rows with null item keys
    are ignored, as a pandas group-by drops them.

    An item's cells are bits (see ``_cell_masks``); items are counted by the cells whose bit is set.
    """
    valid = runs
    for k in item_keys:
        valid = valid.filter(F.col(k).isNotNull())
    cells = [tuple(r) for r in grid.select(*cell_keys).distinct().collect()]  # the configured grid
    values = [_distinct_last_null(c[k] for c in cells) for k in range(len(cell_keys))]
    numbers = _numbers(cells, values)
    masks, words = _cell_masks(valid, item_keys, cell_keys, values, ok_col)
    every = F.lit(-1)  # counts the items
    passed = F.array_compact(F.array(every, *[F.when(_bit(n), F.lit(n)) for n in numbers]))
    counts = masks.select(F.explode(passed).alias("_n")).groupBy("_n").agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.agg(F.map_from_entries(F.collect_list(F.struct("_n", "_c"))).alias("_m"))  # one entry per cell
    n_items = F.coalesce(F.try_element_at("_m", every), F.lit(0))
    if items is not None:
        n_items = items.select(*item_keys).dropna().distinct().agg(F.count(F.lit(1))).scalar()
    types = {f.name: f.dataType for f in grid.schema}
    rows = F.array(*[F.struct(*[F.lit(v).cast(types[n]).alias(n) for n, v in zip(cell_keys, c)],
                              F.coalesce(F.try_element_at("_m", F.lit(k)), F.lit(0)).cast("bigint").alias("passes"))
                     for k, c in zip(numbers, cells)])
    out = totals.select(F.explode(rows).alias("_g"), n_items.cast("bigint").alias("items")).select(
        *[F.col(f"_g.{n}").alias(n) for n in cell_keys], F.col("_g.passes").alias("passes"), "items")
    return out.withColumn("rate", F.col("passes").cast("double") / F.col("items"))


def _distinct_last_null(values) -> list:
    """Distinct values, null last."""
    vs = list(dict.fromkeys(values))
    return [v for v in vs if v is not None] + [None] * (None in vs)


def distinct_suites(df: DataFrame, suite_col: str = "suite") -> DataFrame:
    """Distinct suites (null dropped)."""
    return df.select(suite_col).where(F.col(suite_col).isNotNull()).distinct()


def fill_missing_outcomes(grid: DataFrame, outcomes: DataFrame, keys: Sequence[str],
                          ok_col: str = "ok") -> DataFrame:
    """A grid cell without an artifact/outcome is a failure; present cells keep theirs."""
    return (grid.join(outcomes, list(keys), "left")
            .withColumn(ok_col, F.coalesce(F.col(ok_col), F.lit(False))))


def complete_outcomes(runs: DataFrame, item_keys: Sequence[str], systems: Sequence, variants: Sequence,
                      ok_col: str = "ok") -> DataFrame:
    """J12 over a configured grid in one aggregation: every item x system x variant cell,
    ``ok`` = all reported outcomes passed, ``false`` when the cell has none.

    An item's cells are bits (see ``_cell_masks``), so a single shuffle of a few longs per item stands for the join of
    the expanded grid with the outcomes.
    """
    cell_keys = ("system", "variant")
    cells = [(s, v) for s in systems for v in variants]
    values = [list(systems), list(variants)]
    masks, words = _cell_masks(runs, item_keys, cell_keys, values, ok_col)
    # the exploded list is a constant; the bit is read from the row it comes to
    grid = F.array(*[F.struct(F.lit(s).alias("system"), F.lit(v).alias("variant"), F.lit(n).alias("n"))
                     for n, (s, v) in zip(_numbers(cells, values), cells)])
    word = F.col("_w0") if words == 1 else F.get(F.array(*[F.col(f"_w{w}") for w in range(words)]), F.floor(F.col("_g.n") / WORD_BITS).cast("int"))
    ok = F.call_function("shiftrightunsigned", word, F.col("_g.n") % WORD_BITS).bitwiseAND(F.lit(1).cast("long")) == 1
    return (masks.withColumn("_g", F.explode(grid))
            .select(*item_keys, F.col("_g.system").alias("system"), F.col("_g.variant").alias("variant"), ok.alias(ok_col)))
