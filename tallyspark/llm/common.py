"""Shared helpers of the training-data operators: scratch tables, batching, tokenizer files."""

from __future__ import annotations

import gc
import inspect
import re
from collections.abc import Iterable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, scratch_path
from ..sources.tables import read_table

#: the words of operators 1, 5 and 10: everything between ASCII white space (fixed value)
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Shared scratch folder, and Arrow batches small enough for batches of long texts."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that only finished jobs used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SCOPES: list[list[str]] = []


@contextmanager
def scratch():
    """The paths of scratch tables that are made within, for a caller that deletes them when what it builds on them is written.

    Scopes may be nested; a table belongs to the innermost one, and to none outside of all of them.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES[:] = [s for s in _SCOPES if s is not made]


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing needs any more."""
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str, release: bool = False, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage: a lost executor repeats only its tasks of the next
    step, and what a stage decided is not decided again. ``release``: lets Spark
    delete the shuffle files that only finished steps used, which it otherwise
    does whenever the driver happens to collect garbage. ``keep``: the table
    belongs to no ``scratch`` scope.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    if release:  # what the step before used is only let go now
        collect_garbage(spark)
    df.write.parquet(path)
    schema = df.schema
    if release:
        del df
        collect_garbage(spark)
    return spark.read.schema(schema).parquet(path)


_FROZEN: list[bool] = []


def give_back() -> None:
    """Return freed memory to the system: a Python worker serves many tasks, and its peak would otherwise stay with it.

    What the first call finds alive, modules for the most part, later ones do not look through again.
    """
    import ctypes
    import pyarrow as pa
    gc.collect()
    if not _FROZEN:
        _FROZEN.append(True)
        gc.freeze()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(fn):
    """``fn`` of ``mapInArrow`` (or of a group), whose worker keeps no freed memory when the task (or the group) has ended."""
    if inspect.isgeneratorfunction(fn):
        def run(batches):
            yield from fn(batches)
            give_back()
        return run

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        out = fn(rows)
        give_back()
        return out
    return group


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words as UTF-8: ``bytes.lower`` and ``bytes.split`` are exactly that rule."""
    return text.encode().lower().split() if text else []


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or a variation of it that no column has."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def tokenizer_path(name_or_path: str) -> str:
    """A tokenizer file: an absolute path is taken as it is, a name is looked up among the public ones."""
    if re.search(r"[/\\]", name_or_path):
        return name_or_path
    import public_tokenizers
    return public_tokenizers.path(name_or_path)


def schema_of(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """``name type`` of columns, for the schema of a ``mapInArrow``."""
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (df.columns if columns is None else columns)]


class Bounded(dict):
    """Values made on demand. The first ``limit`` keys stay (frequent ones come early), later ones for a while."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.late = make, limit, {}

    def __missing__(self, key):
        value = self.late.get(key)
        if value is None:
            value = self.make(key)
            if len(self) < self.limit:
                self[key] = value
            else:
                if len(self.late) * 4 >= self.limit:
                    self.late.clear()
                self.late[key] = value
        return value
