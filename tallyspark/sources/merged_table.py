"""A table that batches are appended to and that is compacted: stream updates (S1), done sets (J8, J9, A12), sketches.

``batch=<id>`` folders hold what a batch added; a repeated batch overwrites its own. ``upto=<id>`` folders hold the
merged rows of all batches up to that one. A compaction writes a new ``upto`` folder whole, and only then deletes what it
replaces; a folder without its ``_SUCCESS`` file does not count, so a compaction that is lost changes nothing. One writer at
a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class MergedTable:
    """Rows of ``schema`` under ``path``; ``merge`` turns the rows of many batches into those of one, in any grouping of the batches."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge

    def _folders(self, kind: str) -> dict[int, str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = {}
        for st in fs.listStatus(root) if fs.exists(root) else ():
            name = st.getPath().getName()
            if name.startswith(kind + "=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                found[int(name[len(kind) + 1:])] = f"{self.path}/{name}"
        return found

    def _current(self) -> tuple[int, list[str], list[str]]:
        """(last compacted batch, folders that count, folders that are replaced)."""
        merged, batches = self._folders("upto"), self._folders("batch")
        last = max(merged, default=-1)
        live = [merged[last]] if merged else []
        return last, live + [p for b, p in sorted(batches.items()) if b > last], \
            [p for b, p in merged.items() if b < last] + [p for b, p in batches.items() if b <= last]

    def append(self, rows: DataFrame, batch_id: int) -> None:
        if batch_id > self._current()[0]:  # one that was compacted before its caller noted it is repeated for nothing
            rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def next_batch(self) -> int:
        return max([-1, *self._folders("upto"), *self._folders("batch")]) + 1

    def compact(self) -> None:
        """Merge all batches so far into one folder."""
        batches = self._folders("batch")
        last, live, _ = self._current()
        upto = max(batches, default=-1)
        if upto > last:
            self._merged(live).write.mode("overwrite").parquet(f"{self.path}/upto={upto}")
        for p in self._current()[2]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _merged(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self.spark.read.schema(self.schema).parquet(*folders))

    def current(self) -> DataFrame:
        """The merged rows of all batches."""
        return self._merged(self._current()[1])

    def n_folders(self) -> int:
        return len(self._folders("batch")) + len(self._folders("upto"))
