"""Task grids, candidate merge, pivots and resume.

Grids expand each row by a run-config list (variants, systems) with
``explode`` of a literal array: a row-wise generator, no join and no shuffle.
Keys are business keys carried as columns; no operator relies on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_, java_regex

# Fixed value: artifact path layout and its parse pattern (suite, item, variant).
PATH_PREFIX = "task-"
PATH_SUFFIX = ".so"
PATH_PATTERN = r"task-([^_]+)_(.*)-(O\w).so"      # matched at the start only
STRIP_SUFFIX = ".strip"


def artifact_path(suite: Column | str, item: Column | str, variant: Column | str) -> Column:
    """``task-{suite}_{item}-{variant}.so``."""
    return F.concat(F.lit(PATH_PREFIX), col_(suite), F.lit("_"), col_(item), F.lit("-"),
                    col_(variant), F.lit(PATH_SUFFIX))


def parse_artifact_path(path: Column | str) -> Column:
    """struct(suite, item, variant, matched) from the path's last component.

    Matched at the start only (the end is not anchored; ``.`` is any char);
    a ``.strip`` file appends ``.strip`` to the variant. A suite containing
    ``_`` splits wrongly, as in the reference - prefer the real columns.
    """
    pat = "(?d)^" + java_regex(PATH_PATTERN)[len("(?d)"):]
    base = F.regexp_extract(col_(path), r"([^/]*)$", 1)
    ok = base.rlike(pat)
    var = F.regexp_extract(base, pat, 3)
    var = F.when(base.endswith(STRIP_SUFFIX), F.concat(var, F.lit(STRIP_SUFFIX))).otherwise(var)
    return F.struct(
        F.when(ok, F.regexp_extract(base, pat, 1)).alias("suite"),
        F.when(ok, F.regexp_extract(base, pat, 2)).alias("item"),
        F.when(ok, var).alias("variant"),
        ok.alias("matched"))


def task_grid(items: DataFrame, variants: Sequence[str], item_id: str = "item_id",
              suite: str = "suite", item: str = "item") -> DataFrame:
    """Item x variant with a deterministic dense ``task_id = item_id * V + ord`` and B6 path."""
    v = F.array(*[F.struct(F.lit(x).alias("variant"), F.lit(k).alias("ord")) for k, x in enumerate(variants)])
    g = items.withColumn("_v", F.explode(v)).select("*", "_v.variant", "_v.ord").drop("_v")
    return (g.withColumn("task_id", F.col(item_id) * F.lit(len(variants)) + F.col("ord"))
            .withColumn("path", artifact_path(suite, item, "variant")))


def request_grid(tasks: DataFrame, systems: Sequence[str], system: str = "system") -> DataFrame:
    """System x task (one request per pair), by explode of the configured systems."""
    return tasks.withColumn(system, F.explode(F.array(*[F.lit(s) for s in systems])))


def keep_before_first_failure(grid: DataFrame, item_keys: Sequence[str], ord_col: str = "ord",
                              ok_col: str = "ok") -> DataFrame:
    """A failure stops later variants of the item; earlier variants are kept.

    Window per item (rows per item = number of variants, so no hot partition).
    """
    w = Window.partitionBy(*item_keys)
    first_fail = F.min(F.when(~F.col(ok_col), F.col(ord_col))).over(w)
    return (grid.withColumn("_ff", first_fail)
            .filter(F.col("_ff").isNull() | (F.col(ord_col) < F.col("_ff"))).drop("_ff"))


def pivot_results(results: DataFrame, systems: Sequence[str], key: str = "task_id",
                  system: str = "system", value: str = "result", order: str = "seq") -> DataFrame:
    """One column per configured system, later entry (by ``order``) wins, null elsewhere.

    Single aggregation: ``pivot`` with explicit values + ``max_by``.
    """
    return (results.groupBy(key).pivot(system, list(systems))
            .agg(F.max_by(F.col(value), F.col(order))))


def unpivot_candidates(wide: DataFrame, ids: Sequence[str], systems: Sequence[str],
                       system: str = "system", value: str = "code") -> DataFrame:
    """Visit each configured system column that exists; other columns are dropped."""
    present = [s for s in systems if s in wide.columns]
    return wide.unpivot(list(ids), present, system, value)


def merge_candidates(base: DataFrame, candidates: DataFrame, key: str = "task_id",
                     system: str = "system", value: str = "code",
                     source_rank: str = "source_rank") -> DataFrame:
    """Left join of the long candidate set to the base by key.

    When several sources carry the same system, the first source (lowest
    ``source_rank``) wins - the reference keeps an existing column.
    """
    c = (candidates.groupBy(key, system)
         .agg(F.min_by(F.col(value), F.col(source_rank)).alias(value)))
    return base.join(c, key, "left")


def pending(tasks: DataFrame, done: DataFrame, key: str = "task_id", retry_errors: bool = False,
            value: str = "code", error_value: str = "ERROR") -> DataFrame:
    """Tasks not yet in the output. ``ERROR`` rows count as done unless ``retry_errors``."""
    d = done
    if retry_errors:
        d = d.filter(F.col(value) != error_value)
    return tasks.join(d.select(key).distinct(), key, "left_anti")


def pending_chunks(chunks: DataFrame, results: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Chunks without at least one stored result row (empty results rerun)."""
    return chunks.join(results.select(chunk).distinct(), chunk, "left_anti")


def range_slice(tasks: DataFrame, slice_id: int, size: int, n: int | None = None,
                key: str = "task_id") -> DataFrame:
    """Rows ``[id*size, min(id*size+size, n))`` of a dense key; arguments checked up front."""
    if slice_id < 0 or size <= 0:
        raise ValueError("slice id must be >= 0 and size > 0")
    start = slice_id * size
    if n is not None and start >= n:
        raise ValueError(f"slice start {start} is past the end {n}")
    end = start + size if n is None else min(start + size, n)
    return tasks.filter((F.col(key) >= start) & (F.col(key) < end))


def refine_source(model: str) -> str:
    """Which system's output a refining model reads."""
    return "ghidra" if "llm4decompile" in model.lower() else "hexrays"


def refine_candidates(wide: DataFrame, model: str, key: str = "task_id") -> DataFrame:
    """Rows whose source column is truthy (non-null, non-empty)."""
    src = refine_source(model)
    return (wide.filter(F.col(src).isNotNull() & (F.col(src) != ""))
            .select(key, F.col(src).alias("code")))


def error_or_code(code: Column | str) -> Column:
    """A failed or empty result is stored as ``ERROR``."""
    return F.coalesce(F.nullif(col_(code), F.lit("")), F.lit("ERROR"))
