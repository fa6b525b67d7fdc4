"""Scans of the evaluation inputs (A1-A5, A7, A8, A13) and the covered-item
filter / joins built on them (B1, J2, J6, J7, G2).

Readers take an explicit schema (no inference pass) and return DataFrames.
Files that are one JSON document each (coverage exports, compile-command
arrays, task queues) are read whole per file (``wholetext``) and exploded with
their array positions, since "last entry wins" rules need the position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .named_files import read_named_files, write_named_files

# Fixed values
C_LANGUAGES = ("c", "c++")
ENTRY_NAME = "LLVMFuzzerTestOneInput"
MIN_COUNT = 10
ELF_MAGIC = bytes([0x7F, 0x45, 0x4C, 0x46])
SYMBOLIZER = "llvm-symbolizer"
PATCHED_SUFFIX = "_patched"
SKIPPED_SUITES = ("cpython3",)

COVERAGE_SCHEMA = ("struct<data: array<struct<functions: array<struct<name: string, "
                   "filenames: array<string>, count: bigint>>>>>")
COMMANDS_SCHEMA = "array<struct<file: string, directory: string, arguments: array<string>>>"
QUEUE_SCHEMA = ("array<struct<uuid: string, status: string, metadata: struct<idx: bigint, decompiler: string>, "
                "decompiler: string, result: map<string, string>, error: string>>")


def _file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def _parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


# A1 --------------------------------------------------------------------------
def c_suites(manifests: DataFrame, language: str = "language") -> DataFrame:
    """A1: keep suites whose manifest has a language in {c, c++} (missing fails)."""
    return manifests.filter(F.col(language).isin(*C_LANGUAGES))


def read_manifests(spark: SparkSession, root: str, name: str = "project.yaml") -> DataFrame:
    """A1: ``suite, language`` of every ``<suite>/project.yaml`` under ``root``.

    The language is the last top-level scalar of that key, plain or in quotes, without a comment; null where there is none.
    """
    files = read_named_files(spark, root, suffix=name).filter(F.col("name") == name)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    value = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(r"(?m)^language[ \t]*:[ \t]+(.*)$"), F.lit(1))), -1)
    plain = F.coalesce(F.nullif(F.regexp_extract(value, r"""^(["'])(.*?)\1""", 2), F.lit("")),
                       F.nullif(F.regexp_extract(value, r"""^([^"'#\s].*?)[ \t]*(?:[ \t]#.*)?$""", 1), F.lit("")))
    return files.select(F.col("folder").alias("suite"), F.when(~plain.isin("null", "~"), plain).alias("language"))


# A2 --------------------------------------------------------------------------
def read_coverage_reports(spark: SparkSession, path: str) -> DataFrame:
    """A2: one coverage export per file; only ``data[0].functions`` is read.

    Output: ``file_path, pos, name, filenames, count`` (a missing file gives no rows).
    """
    raw = (spark.read.option("wholetext", True).text(path)
           .select(F.col("_metadata.file_path").alias("file_path"), "value"))
    return parse_coverage_reports(raw, ["file_path"])


def parse_coverage_reports(reports: DataFrame, keys: Sequence[str], text: str = "value") -> DataFrame:
    """A2 on documents that are rows: ``keys`` plus ``pos, name, filenames, count``."""
    fns = F.get(F.from_json(text, COVERAGE_SCHEMA)["data"], 0)["functions"]
    return (reports.select(*keys, F.posexplode_outer(fns).alias("pos", "f"))
            .filter(F.col("pos").isNotNull())
            .select(*keys, "pos", F.col("f.name").alias("name"), F.col("f.filenames").alias("filenames"),
                    F.col("f.count").alias("count")))


# B1 --------------------------------------------------------------------------
def covered_items(functions: DataFrame, suite: str = "suite", probe: str = "probe", order: str = "pos") -> DataFrame:
    """B1: items a probe covers, with their first ``.c`` file.

    Dropped: count < 10, no ``.c`` file, ``:`` in the name, the fuzzer entry
    point, any ``.c`` path containing the probe name, or no ``.c`` path
    containing the suite name. The same name twice in a probe: last wins.
    """
    c_files = F.filter("filenames", lambda f: f.endswith(".c"))
    f = functions.withColumn("_c", c_files)
    keep = ((F.col("count") >= MIN_COUNT) & (F.size("_c") > 0) & ~F.col("name").contains(":")
            & (F.col("name") != ENTRY_NAME)
            & ~F.exists("_c", lambda p: p.contains(F.col(probe)))
            & F.exists("_c", lambda p: p.contains(F.col(suite))))
    kept = f.filter(keep).withColumn("path", F.get(F.col("_c"), 0))
    return (kept.groupBy(suite, probe, "name")
            .agg(F.max_by("path", F.col(order)).alias("path")))


# A3 --------------------------------------------------------------------------
def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """A3: compile-command arrays; the last entry for a file wins (per suite folder)."""
    raw = (spark.read.option("wholetext", True).text(path)
           .select(F.col("_metadata.file_path").alias("file_path"), "value"))
    return last_commands(parse_compile_commands(raw, ["file_path"]), ["file_path"])


def parse_compile_commands(arrays: DataFrame, keys: Sequence[str], text: str = "value") -> DataFrame:
    """A3 on arrays that are rows: ``keys`` plus ``pos`` and the entry ``c``."""
    # outer + filter on the output keeps the parse single (see judgements.explode_battles)
    return (arrays.select(*keys, F.posexplode_outer(F.from_json(text, COMMANDS_SCHEMA)).alias("pos", "c"))
            .filter(F.col("pos").isNotNull()))


def last_commands(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last entry of every source file, per ``keys``."""
    return (entries.groupBy(*keys, F.col("c.file").alias("file"))
            .agg(F.max_by(F.struct(F.col("c.directory").alias("directory"),
                                   F.col("c.arguments").alias("arguments")), "pos").alias("cmd"))
            .select(*keys, "file", "cmd.directory", "cmd.arguments"))


# A4 --------------------------------------------------------------------------
def read_function_files(spark: SparkSession, root: str) -> DataFrame:
    """A4: one ``.c`` file per function under ``root/<suite>/``; bytes decoded as
    UTF-8 with replacement; suites in :data:`SKIPPED_SUITES` are skipped."""
    files = read_named_files(spark, root, suffix=".c")
    out = files.select(F.col("folder").alias("suite"), _file_stem(F.col("name")).alias("item"),
                       F.make_valid_utf8(F.col("content").cast("string")).alias("source"), "path")
    return out.filter(~F.col("suite").isin(*SKIPPED_SUITES))


def write_function_files(items: DataFrame, root: str, suite: str = "suite", item: str = "item", source: str = "source",
                         overwrite: bool = False) -> None:
    """A4: ``root/<suite>/<item>.c`` for every row; no shuffle. Two rows of one name fail the write."""
    write_named_files(items, root, F.concat(F.col(suite), F.lit("/"), F.col(item), F.lit(".c")), F.col(source), overwrite=overwrite)


# A5 --------------------------------------------------------------------------
def discover_probes(spark: SparkSession, root: str) -> DataFrame:
    """A5: executables (ELF magic) under ``root``, by file name: ``suite`` (their folder), ``probe``, ``path``.

    The symbolizer and patched copies are excluded. Only the magic's bytes of a file are read.
    """
    files = read_named_files(spark, root, head=len(ELF_MAGIC))
    return (files.filter((F.col("content") == F.lit(ELF_MAGIC)) & (F.col("name") != SYMBOLIZER) & ~F.col("name").endswith(PATCHED_SUFFIX))
            .select(F.col("folder").alias("suite"), F.col("name").alias("probe"), "path"))


# A7 --------------------------------------------------------------------------
def read_headered_jsonl(spark: SparkSession, path: str, n_tasks: int | None = None,
                        order: str | None = None) -> DataFrame:
    """JSON-lines result files, each with an optional ``{"model": ...}`` header line.

    A file is one system: the header's model, or the file's stem without one;
    headers of one file must agree (the job fails otherwise). Lines that do not
    parse and lines without ``idx`` are skipped. A repeated ``idx`` keeps the
    last line of the file: lines are ordered by the start of their split and by
    their place in it, so a file may be split among tasks. ``order`` names a
    column of the lines to order by instead. An ``idx`` outside ``[0,
    n_tasks)`` fails the job; a missing ``code`` is null. Output: ``source``
    (the file), ``system, task_id, code``.
    """
    fields = "model string, idx long, code string, _corrupt_record string" + (f", `{order}` long" if order else "")
    place = F.col(order) if order else F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rec = (spark.read.schema(fields).option("columnNameOfCorruptRecord", "_corrupt_record")
           .option("recursiveFileLookup", True).json(path)
           .select(F.col("_metadata.file_path").alias("source"), place.alias("place"), "model", "idx", "code",
                   "_corrupt_record"))
    rec = rec.filter(F.col("_corrupt_record").isNull())
    header = (rec.filter(F.col("model").isNotNull()).groupBy("source")
              .agg(F.min("model").alias("model"), F.max("model").alias("other")))
    header = header.select("source", F.when(F.col("model") != F.col("other"),
                                            F.raise_error(F.lit("Multiple model names found")))
                           .otherwise(F.col("model")).alias("model"))
    idx = F.col("idx")
    if n_tasks is not None:
        idx = F.when((idx < 0) | (idx >= n_tasks), F.raise_error(F.lit("idx out of range"))).otherwise(idx)
    body = rec.filter(F.col("model").isNull() & F.col("idx").isNotNull())
    last = (body.select("source", idx.alias("task_id"), "code", "place")
            .groupBy("source", "task_id").agg(F.max_by("code", "place").alias("code")))
    return (last.join(header, "source", "left")
            .select("source", F.coalesce("model", _file_stem(F.col("source"))).alias("system"), "task_id", "code"))


def write_headered_jsonl(results: DataFrame, path: str, system: str = "system", order: str = "seq",
                         files_per_system: int = 8, file_rows: int = 250_000) -> None:
    """A9 sink: ``{idx, code}`` lines in ``order``, each file led by its system's header line.

    A system's tasks are dealt into ``files_per_system`` files, or more where the
    largest system would have over ``file_rows`` rows in one, by a hash of the task, so one large system does not land in one task and a repeated task
    stays in one file, in order.
    """
    largest = results.groupBy(system).count().agg(F.max("count")).first()[0] or 0
    files = max(files_per_system, -(-largest // file_rows))
    part = F.pmod(F.xxhash64("task_id"), F.lit(files)).cast("int").alias("part")
    body = results.select(system, part, F.lit(1).alias("body"), F.col(order).cast("long").alias("place"),
                          F.to_json(F.struct(F.col("task_id").alias("idx"), "code"),
                                    {"ignoreNullFields": "false"}).alias("value"))
    head = body.select(system, "part").distinct().select(
        system, "part", F.lit(0).alias("body"), F.lit(0).cast("long").alias("place"),
        F.to_json(F.struct(F.col(system).alias("model"))).alias("value"))
    (head.unionByName(body).repartition(system, "part").sortWithinPartitions(system, "part", "body", "place")
     .drop("body", "place").write.partitionBy(system, "part").text(path))


def write_result_files(results: DataFrame, root: str, system: str = "system", order: str = "seq", file_rows: int = 250_000,
                       without_header: Sequence[str] = ()) -> None:
    """A9 sink with file names: ``{idx, code}`` lines in ``order`` in ``root/part-<k>/<system>.jsonl``, each led by its header line.

    A system without a header line is named by its files. The number of parts follows from the largest system's rows; a task's
    lines stay in one file, in order.
    """
    largest = results.groupBy(system).count().agg(F.max("count")).first()[0] or 0
    part = F.pmod(F.xxhash64("task_id"), F.lit(max(1, -(-largest // file_rows))))
    line = F.to_json(F.struct(F.col("task_id").alias("idx"), "code"), {"ignoreNullFields": "false"})
    head = F.concat(F.to_json(F.struct(F.col(system).alias("model"))), F.lit("\n"))
    if without_header:
        head = F.when(~F.col(system).isin(*without_header), head)
    write_named_files(results, root, F.concat(F.lit("part-"), part.cast("string"), F.lit("/"), F.col(system), F.lit(".jsonl")),
                      F.concat(line, F.lit("\n")), head, F.col(order))


# A8 --------------------------------------------------------------------------
def read_task_queue(spark: SparkSession, path: str) -> DataFrame:
    """Saved task-queue arrays; keeps array position for later-entry-wins rules."""
    raw = (spark.read.option("wholetext", True).text(path)
           .select(F.col("_metadata.file_path").alias("source"), "value"))
    return parse_task_queue(raw, ["source"])


def parse_task_queue(arrays: DataFrame, keys: Sequence[str], text: str = "value") -> DataFrame:
    """A8 on arrays that are rows: ``keys`` plus ``pos`` and the entry's fields."""
    return (arrays.select(*keys, F.posexplode_outer(F.from_json(text, QUEUE_SCHEMA)).alias("pos", "t"))
            .filter(F.col("pos").isNotNull()).select(*keys, "pos", "t.*"))


def queue_results(queue: DataFrame, systems: Sequence[str]) -> DataFrame:
    """A8 + J10: completed entries with a non-empty result; first map value; later entry wins."""
    ok = queue.filter((F.col("status") == "completed") & F.col("result").isNotNull() & (F.size("result") > 0))
    v = ok.select(F.col("metadata.idx").alias("task_id"), F.col("metadata.decompiler").alias("system"),
                  F.get(F.map_values("result"), 0).alias("code"), "pos")
    return v.groupBy("task_id").pivot("system", list(systems)).agg(F.max_by("code", "pos"))


# A13 -------------------------------------------------------------------------
def select_systems(spark: SparkSession, configured: Sequence[str], requested: Sequence[str] | None) -> DataFrame:
    """Configured systems, intersected with a requested list when given (unknown names drop)."""
    wanted = [s for s in configured if not requested or s in requested]
    kind = "string" if any(isinstance(s, str) for s in configured) else "long"
    return spark.createDataFrame([(s,) for s in wanted], f"system {kind}")


# J2 / J6 ---------------------------------------------------------------------
def attach_commands(items: DataFrame, commands: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Item -> compile command by file; returns (matched, missing) - a miss skips that item only."""
    cmd = commands.select(F.col("file").alias(path), "directory", "arguments")
    return items.join(cmd, path, "inner"), items.join(cmd, path, "left_anti")


def extract_grid(covered: DataFrame, suite: str = "suite", probe: str = "probe") -> DataFrame:
    """One extraction per (suite, item name); the lowest probe's path is the fixed choice."""
    return (covered.groupBy(suite, "name")
            .agg(F.min_by("path", F.col(probe)).alias("path"), F.min(probe).alias(probe)))


# J7 --------------------------------------------------------------------------
def relocation_map(relocs: DataFrame, symbols: DataFrame, key: str = "binary") -> DataFrame:
    """Relocation -> binary symbol address.

    ``relocs``: ``binary, so_offset, so_func``; ``symbols``: ``binary, table_ord, name, value``.
    Named relocations only; symbols with value 0 are ignored; a name in several
    tables takes the last table's value; unmatched relocations are dropped.
    Output: ``binary, binary_offset, so_offset`` as hex text.
    """
    sym = (symbols.filter((F.col("name") != "") & (F.col("value") != 0))
           .groupBy(key, "name").agg(F.max_by("value", "table_ord").alias("value")))
    r = relocs.filter(F.col("so_func").isNotNull() & (F.col("so_func") != ""))
    j = r.join(sym, (r[key] == sym[key]) & (r["so_func"] == sym["name"]))
    return j.select(r[key], F.concat(F.lit("0x"), F.lower(F.hex(sym["value"]))).alias("binary_offset"),
                    F.concat(F.lit("0x"), F.lower(F.hex(r["so_offset"]))).alias("so_offset"))


# G2 --------------------------------------------------------------------------
def flatten_outcomes(raw: DataFrame, outcomes: str = "outcomes") -> DataFrame:
    """``(probe, item, {"system-variant": ok})`` -> long rows; key split at the last ``-``.

    Empty outcome maps give no rows.
    """
    e = raw.select(*[c for c in raw.columns if c != outcomes], F.explode(outcomes).alias("key", "ok"))
    last_dash = r"(?s)^(.*)-([^-]*)$"
    return (e.withColumn("system", F.regexp_extract("key", last_dash, 1))
            .withColumn("variant", F.regexp_extract("key", last_dash, 2))
            .filter(F.col("key").contains("-")).drop("key"))


def nested_results_json(long: DataFrame) -> DataFrame:
    """A10: nested ``system -> variant -> [{probe, ok}]`` JSON per (suite, item), built on demand.

    Entries are sorted (keys as text, runs by probe) so the text is deterministic.
    Each level collects at most systems x variants x probes entries of one item.
    One shuffle by item serves all three levels.
    """
    def by_key(arr):
        return F.array_sort(arr, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))

    lvl3 = (long.repartition("suite", "item").groupBy("suite", "item", "system", "variant")
            .agg(F.sort_array(F.collect_list(F.struct("probe", "ok"))).alias("runs")))
    lvl2 = lvl3.groupBy("suite", "item", "system").agg(F.map_from_entries(by_key(F.collect_list(
        F.struct(F.col("variant").cast("string").alias("k"), F.col("runs").alias("v"))))).alias("v"))
    lvl1 = lvl2.groupBy("suite", "item").agg(F.map_from_entries(by_key(F.collect_list(
        F.struct(F.col("system").cast("string").alias("k"), F.col("v").alias("v"))))).alias("s"))
    return lvl1.select("suite", "item", F.to_json("s").alias("json"))


# A4 + B12 + B13 ----------------------------------------------------------------
def extract_items(files: DataFrame, spans: DataFrame) -> DataFrame:
    """Items from source files and their function spans (spans come from an
    external parser; this package does not parse C).

    ``files``: ``path, content``; ``spans``: ``path, name, is_definition, sl, sc,
    el, ec, ord`` (``ord`` = parser walk order). Only functions named like the
    file stem count. Each definition's prelude is the file with the earlier
    declarations' text removed once (in walk order), the body cut out and
    ``#undef`` lines blanked after it. Output: ``path, item, func, include``.
    The join is on the file path; per-file declaration lists are small.
    """
    from ..functions.code_text import span_text, split_prelude

    # keep only the stem's spans before the join, so a file's text travels
    # with its one or two relevant spans, not with every function in the file
    s = (spans.filter(F.col("name") == _file_stem(F.col("path"))).join(files, "path")
         .withColumn("body", span_text("content", "sl", "sc", "el", "ec"))
         .filter(F.col("body").isNotNull() & (F.col("body") != "")))
    decls = (s.filter(~F.col("is_definition")).groupBy("path")
             .agg(F.array_sort(F.collect_list(F.struct("ord", "body"))).alias("decls")))
    defs = s.filter(F.col("is_definition")).join(decls, "path", "left")
    earlier = F.transform(F.filter(F.coalesce("decls", F.array().cast("array<struct<ord:bigint,body:string>>")),
                                   lambda d: d["ord"] < F.col("ord")), lambda d: d["body"])
    return defs.select("path", F.col("name").alias("item"), F.col("body").alias("func"),
                       split_prelude(F.col("content"), earlier, F.col("body")).alias("include"))
