"""Files with given names, as a Spark data source (A4, A5, A9): ``format("named_files")``.

Spark's own writers choose the names of their files, and its ``binaryFile`` reader
reads whole files. This source reads and writes files whose names mean something.

Reading (``path, folder, name, size, content``): the planner lists the folder and packs the files into partitions by
bytes; a task reads its files, or only their first ``head`` bytes. Options: ``suffix`` (of the names), ``recursive``
(default true), ``head``, ``partition_bytes``, ``partition_files``. Files and folders whose names begin with ``_`` or ``.`` are passed over.

Writing (rows of ``name``, ``content`` and perhaps ``header``): consecutive rows of one name make one file, which begins with the header
of its first row; null contents add nothing. Each attempt of a task writes to a staging folder of its own and reports its names; when all tasks
have ended, the commit moves the files of the reported attempts to their places (a new folder that one task wrote goes whole) and removes the
staging folder, so a lost task or a job that fails leaves no file. A name that two tasks report, or (without ``mode("overwrite")``) one that exists, fails the commit before anything is moved;
a name that leaves the folder fails the task. ``overwrite`` replaces files of the same names and keeps others.

Tasks reach files through ``pyarrow.fs`` (local and mounted folders, hdfs, s3, gs, abfs). The planner holds one name and
size a file, as Spark's own file sources do.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "path string, folder string, name string, size long, content binary"
FORMAT = "named_files"
STAGING = "_staging-"
OPEN_COST = 64 << 10  # bytes that opening a file counts as
MOVERS = 16
MOVED_AT_ONCE = 2000  # names that the movers are given together
RENAMING = ("local", "hdfs")  # file systems in which moving a folder does not copy its files


def _open_fs(path: str):
    """(filesystem, path in it) of a URI or an absolute path."""
    from pyarrow import fs
    if path.startswith("file:/"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path.rstrip("/"))


def _inside(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def _above(folder: str) -> list[str]:
    """The folders that hold ``folder``."""
    steps = folder.split("/")
    return ["/".join(steps[:k]) for k in range(1, len(steps))]


def _true(value: str | None, default: bool) -> bool:
    return default if value is None else value.lower() == "true"


@dataclass
class _Files(InputPartition):
    files: list  # (path, size)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.suffix = options.get("suffix", "")
        self.recursive = _true(options.get("recursive"), True)
        self.head = int(options["head"]) if "head" in options else None
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.partition_files = int(options.get("partition_files", 10_000))

    def partitions(self):
        from pyarrow import fs as afs
        fs, root = _open_fs(self.root)
        found = []

        def files(infos):
            for info in infos:
                inside = info.path[len(root):].strip("/").split("/")
                if info.type == afs.FileType.File and inside[-1].endswith(self.suffix) and not any(p[0] in "_." for p in inside):
                    yield info.path, info.size

        top = fs.get_file_info(afs.FileSelector(root, recursive=False, allow_not_found=True))
        found.extend(files(top))
        if self.recursive:  # folder by folder, so no more is held of a file than its path and size
            folders = iter([i.path for i in top if i.type == afs.FileType.Directory and i.path[len(root):].strip("/")[0] not in "_."])
            with ThreadPoolExecutor(MOVERS) as pool:
                while some := list(islice(folders, MOVED_AT_ONCE)):
                    for held in pool.map(lambda f: list(files(fs.get_file_info(afs.FileSelector(f, recursive=True, allow_not_found=True)))), some):
                        found.extend(held)
        found.sort()
        parts, held, cost = [], [], 0
        for path, size in found:
            held.append((path, size))
            cost += OPEN_COST + (size if self.head is None else min(size, self.head))
            if cost >= self.partition_bytes or len(held) >= self.partition_files:
                parts.append(_Files(held))
                held, cost = [], 0
        return [*parts, _Files(held)] if held or not parts else parts

    def read(self, partition):
        import pyarrow as pa
        fs, _ = _open_fs(self.root)
        schema = pa.schema([("path", pa.string()), ("folder", pa.string()), ("name", pa.string()), ("size", pa.int64()),
                            ("content", pa.binary())])
        held, size = [], 0
        for path, total in partition.files:
            with fs.open_input_stream(path) as f:
                content = f.read() if self.head is None else f.read(self.head)
            steps = path.rsplit("/", 2)
            held.append((path, steps[-2] if len(steps) > 1 else "", steps[-1], total, content))
            size += len(content) + 256
            if size >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    attempt: str  # its folder in the staging folder
    folders: dict  # names in each folder


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, columns: list[str], overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.staging = f"{STAGING}{uuid.uuid4().hex}"
        if not {"name", "content"} <= set(columns) <= {"name", "content", "header"}:
            raise ValueError("rows of name, content and perhaps header are written")
        self.has_header = "header" in columns
        fs, root = _open_fs(self.root)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator):
        fs, root = _open_fs(self.root)
        attempt = uuid.uuid4().hex
        place = f"{root}/{self.staging}/{attempt}"
        fs.create_dir(place, recursive=False)  # fails once the job has been given up and its staging folder removed
        folders, out, current = {}, None, None
        as_bytes = lambda v: v.encode() if isinstance(v, str) else v
        try:
            for batch in iterator:
                headers = batch.column("header").to_pylist() if self.has_header else [None] * batch.num_rows
                for name, content, header in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), headers):
                    if name != current or out is None:
                        if out is not None:
                            out.close()
                        if not name or name[0] == "/" or any(p in ("", ".", "..") or p[0] in "_." for p in name.split("/")):
                            raise ValueError(f"not a name for a file: {name!r}")
                        folder, _, last = name.rpartition("/")
                        if folder not in folders:
                            fs.create_dir(f"{place}/{folder}", recursive=True)
                            folders[folder] = {}
                        if last in folders[folder]:
                            raise ValueError(f"rows of {name!r} are not consecutive")
                        folders[folder][last] = None
                        out, current = fs.open_output_stream(f"{place}/{name}"), name
                        if header is not None:
                            out.write(as_bytes(header))
                    if content is not None:
                        out.write(as_bytes(content))
        finally:
            if out is not None:
                out.close()
        return _Written(attempt, {f: list(names) for f, names in folders.items()})

    def commit(self, messages):
        from pyarrow import fs as afs
        fs, root = _open_fs(self.root)
        try:
            messages = [m for m in messages if m]
            writers = Counter(f for m in messages for f in m.folders)
            shared = {f: set() for f, n in writers.items() if n > 1}
            for m in messages:
                for folder in shared.keys() & m.folders.keys():
                    for name in m.folders[folder]:
                        if name in shared[folder]:
                            raise ValueError(f"two tasks wrote {_inside(folder, name)!r}")
                        shared[folder].add(name)
            del shared
            with ThreadPoolExecutor(MOVERS) as pool:
                def each(f, items):
                    items = iter(items)
                    while some := list(islice(items, MOVED_AT_ONCE)):
                        yield from pool.map(f, some)

                def exists(at):
                    return fs.get_file_info(f"{root}/{at}").type != afs.FileType.NotFound

                # a new folder that one task wrote, and that holds no other, is moved whole where a folder has a name to change
                inner = {a for f in writers for a in _above(f)}
                alone = [f for f, n in writers.items() if f and n == 1 and f not in inner] if fs.type_name in RENAMING else []
                whole = {f for f, there in zip(alone, each(exists, alone)) if not there}
                names = lambda: ((m.attempt, _inside(f, n)) for m in messages for f in m.folders if f not in whole for n in m.folders[f])
                if not self.overwrite:
                    for (_, name), there in zip(names(), each(exists, (n for _, n in names()))):
                        if there:
                            raise FileExistsError(f"{root}/{name}")
                for folder in {f.rpartition("/")[0] if f in whole else f for f in writers} - {""}:
                    fs.create_dir(f"{root}/{folder}", recursive=True)
                moves = chain(((m.attempt, f) for m in messages for f in m.folders if f in whole), names())
                for _ in each(lambda x: fs.move(f"{root}/{self.staging}/{x[0]}/{x[1]}", f"{root}/{x[1]}"), moves):
                    pass
        finally:
            self._clear(fs, root)

    def abort(self, messages):
        fs, root = _open_fs(self.root)
        self._clear(fs, root)

    def _clear(self, fs, root):
        """Remove the staging folder; tasks that still write to it are on their way out."""
        from pyarrow import fs as afs
        for wait in (0, 0.1, 0.5, 2, 5):
            time.sleep(wait)
            try:
                if fs.get_file_info(f"{root}/{self.staging}").type == afs.FileType.NotFound:
                    return
                fs.delete_dir(f"{root}/{self.staging}")
            except OSError:
                continue


class NamedFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema.fieldNames(), overwrite)


def register_format(spark: SparkSession) -> None:
    """Make ``format("named_files")`` known to the session."""
    spark.dataSource.register(NamedFiles)


def read_named_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """Files under ``root``: ``path, folder, name, size, content``; see the module for options."""
    register_format(spark)
    return spark.read.format(FORMAT).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load(root)


def write_named_files(rows: DataFrame, root: str, name: Column, content: Column, header: Column | None = None,
                      order: Column | None = None, overwrite: bool = False, folder: Column | None = None) -> None:
    """One file per ``name``. With ``order``, rows of a name are brought together and written in that order; without, each
    row is a file and stays where it is, or goes to the task of its ``folder``: small rows lie in few parts, and a file takes the
    same time however small."""
    register_format(rows.sparkSession)
    columns = [name.alias("name"), content.alias("content")] + ([] if header is None else [header.alias("header")])
    if order is None:
        if folder is not None:  # a given number of parts is not joined by their bytes
            rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), folder)
        out = rows.select(*columns)
    else:
        out = (rows.select(*columns, order.alias("_order")).repartition("name").sortWithinPartitions("name", "_order").drop("_order"))
    out.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(root)
