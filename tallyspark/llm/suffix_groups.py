"""Operator 12: substring dedup with prefix-partitioned suffix trees.

A suffix is a text from one of its words on, as far as ``n`` words; only words
that a whole suffix of ``n`` words covers can be removed. The ``n`` words are
read as ``SYMBOLS`` symbols of about n / SYMBOLS words each, and the tree branches by
symbols. No task could hold the tree of a corpus, so it is cut by prefixes of
variable length:

1. Blocks of texts count their prefixes of two symbols; counts are summed by
   range of the prefix. A prefix that one suffix has leads to a leaf and is dropped:
   no repeat lies below it. A prefix of at most ``group_suffixes`` suffixes is
   given to a group of about that size. A more frequent one is extended by a
   symbol and counted again.
2. Each group gets its suffixes and builds its subtree (sorted suffixes and the
   symbols that neighbours share). An internal node at the full depth stands for
   ``n`` repeated words; all its leaves but the first in corpus order are marked.
   Longer maximal repeats are marked suffix by suffix, at every depth.
3. A prefix of all ``n`` words that still has more suffixes than a group may hold is
   itself such a node; its first leaf is a minimum that is combined before the
   shuffle.

A block sends equal suffixes once (its first one), so a passage that all texts share
burdens no task, and only the number of its own suffixes comes back to a block.

Rows are ordered by ``key``, null ones last; rows that share a key by their place
in the stored blocks. Null, empty and short texts have no repeats. Repeated rows:
all but the first lose what a window covers. An empty table gives no rows. A text of
any length is held by one task, as it is one row. Columns besides key and text do not
matter. Words, symbols and prefixes are named by 64-bit hashes, and suffixes by four 32-bit
symbols: two different ones among m would be taken for equal with odds of about m^2 / 2^129.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import lean, materialize

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
SYMBOLS = 4
FIRST = 2  # symbols of the shortest prefixes
LAST_KEY = np.iinfo(np.int64).max  # stands for null: after all others
SALTS = 32

UNIQUE, LONGER, GROUPS = 0, 1, 2  # codes of a prefix: dropped; to be extended; GROUPS + k: group k of its range


def _squeeze(data: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(values: np.ndarray, width: int) -> bytes:
    """Integers below 256 ** width, byte plane by byte plane, compressed."""
    return _squeeze(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(_expand(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, whose upper bytes are mostly zero."""
    return _pack(np.diff(keys, prepend=keys.dtype.type(0)), 8)


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, 8), dtype=np.uint64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the first place of each, and the number of every key's distinct one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


def _ranges(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """The range of every key of ``bits`` bits, by its upper 32 ones."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


@contextmanager
def _few_rows(spark, rows: int = 1):
    """Blocks are large rows: few of them per Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# -- blocks --------------------------------------------------------------------------------------------------------

BLOCK = "block long, n_windows long, keys array<long>, sizes binary, vocabulary binary, width int, tokens binary"


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _blocks(docs: DataFrame, key: str, text: str, n: int, block_words: int) -> DataFrame:
    """Texts as rows of word numbers, a block's texts ordered by key."""

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task, count = TaskContext.get().partitionId(), 0

        def flush():
            nonlocal count
            held.sort(key=lambda h: (h[0] is None, h[0] or 0))
            sizes = np.array([len(t) for _, t in held], np.int64)
            width = 4 if len(numbers) >= 1 << 24 else 3 if len(numbers) >= 1 << 16 else 2
            row = ((task << 32) + count, int(np.maximum(sizes - n + 1, 0).sum()), [k for k, _ in held],
                   sizes.astype("<i8").tobytes(), _squeeze(b" ".join(numbers)), width,
                   _pack(np.concatenate([t for _, t in held]), width))
            count += 1
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)],
                                              names=["block", "n_windows", "keys", "sizes", "vocabulary", "width", "tokens"])

        numbers, held, total = _Numbers(), [], 0
        for b in batches:
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                w = t.encode().split() if t else []  # bytes.split: between ASCII white space
                held.append((k, np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))))
                total += len(w) + 1
                if total >= block_words:
                    yield flush()
                    numbers, held, total = _Numbers(), [], 0
        if held:
            yield flush()

    return materialize(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(lean(build), BLOCK),
                       "suffix-blocks")


class _Suffixes:
    """A block's suffixes of n words: their symbols, prefixes and the distinct ones, in corpus order."""

    def __init__(self, row, n: int, bits: int):
        self.block, self.bits = row["block"], bits
        self.vocabulary = v = _expand(row["vocabulary"]).split(b" ")
        self.keys = np.array([LAST_KEY if k is None else k for k in row["keys"]], np.int64)
        self.sizes = np.frombuffer(row["sizes"], "<i8").astype(np.int64)
        self.tokens = _unpack(row["tokens"], row["width"]).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        windows = np.maximum(self.sizes - n + 1, 0)
        text = np.repeat(np.arange(len(self.sizes)), windows)
        first = np.cumsum(windows) - windows
        self.starts = (self.ends - self.sizes)[text] + np.arange(len(text)) - first[text]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, v), np.uint64, len(v))[self.tokens] if len(self.tokens) else \
            np.zeros(0, np.uint64)
        cuts = [n * k // SYMBOLS for k in range(SYMBOLS + 1)]
        self.symbols, self.prefixes, prefix = [], [], np.zeros(len(text), np.uint64)
        for a, z in zip(cuts, cuts[1:]):
            s = np.zeros(len(text), np.uint64)
            for k in range(a, z):
                s = (s ^ (s >> np.uint64(29))) * _A + hashes[self.starts + k]
            s = (s ^ (s >> np.uint64(32))) * _B
            prefix = (prefix ^ (prefix >> np.uint64(31))) * _C + s
            prefix = (prefix ^ (prefix >> np.uint64(30))) * _A
            self.symbols.append(s)
            self.prefixes.append(prefix)
        _, at, number = _distinct(prefix ^ (prefix >> np.uint64(32)))
        order = np.argsort(at)  # distinct suffixes in corpus order
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        self.distinct, self.number = at[order], rank[number]
        self.key = self.keys[text[self.distinct]]

    def prefix(self, symbols: int, of: np.ndarray) -> np.ndarray:
        """The prefixes of ``symbols`` symbols of some distinct suffixes, cut to the bits that are counted."""
        p = self.prefixes[symbols - 1][self.distinct[of]]
        return (p ^ (p >> np.uint64(33))) >> np.uint64(64 - self.bits)

    def walk(self, back, ranges: int):
        """(suffixes whose prefix is to be counted next, its symbols; places of groups: (symbols, range, group) -> suffixes)."""
        codes: dict[int, list] = {}
        for r in sorted(back or (), key=lambda r: (r["symbols"], r["range"])):
            codes.setdefault(r["symbols"], []).append(_unpack(r["codes"], 2))
        active, groups = np.arange(len(self.distinct)), []
        for symbols in range(FIRST, SYMBOLS + 1):
            if symbols not in codes or not len(active):
                return active, symbols, groups
            names, _, number = _distinct(self.prefix(symbols, active))
            code = np.concatenate(codes[symbols]).astype(np.int64)
            assert len(code) == len(names)
            of = code[number]
            inside = of >= GROUPS
            if inside.any():
                place = _ranges(names, self.bits, ranges)[number[inside]]
                slot = (place << 16) + of[inside] - GROUPS
                order = np.argsort(slot, kind="stable")
                slot, members = slot[order], active[inside][order]
                for part in np.split(np.arange(len(slot)), np.flatnonzero(np.diff(slot)) + 1):
                    groups.append((symbols, int(slot[part[0]] >> 16), int(slot[part[0]] & 0xFFFF), members[part]))
            active = active[of == LONGER]
        return active, SYMBOLS + 1, groups


# -- prefixes of variable length -----------------------------------------------------------------------------------

COUNTED = "symbols int, range int, block long, keys binary, counts binary"
CODED = "symbols int, range int, block long, codes binary, longer long"


def _count(s: _Suffixes, back, ranges: int):
    """The prefixes that a block still has to count, with its number of suffixes, dealt by range."""
    active, symbols, _ = s.walk(back, ranges)
    if not len(active) or symbols > SYMBOLS:
        return
    names, _, number = _distinct(s.prefix(symbols, active))
    counts = np.bincount(number)
    at = np.searchsorted(_ranges(names, s.bits, ranges), np.arange(ranges + 1))
    for k in np.flatnonzero(np.diff(at)):
        a, z = at[k], at[k + 1]
        yield symbols, int(k), s.block, _pack_sorted(names[a:z]), _pack(counts[a:z], 4)


def _code(group_suffixes: int):
    """Over all blocks, what becomes of every prefix of a range: dropped, extended or given to a group."""

    def code(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        parts = [_unpack_sorted(k) for k in rows["keys"]]
        names, _, number = _distinct(np.concatenate(parts))
        total = np.bincount(number, np.concatenate([_unpack(c, 4) for c in rows["counts"]]), len(names)).astype(np.int64)
        inside = (total > 1) & (total <= group_suffixes)
        filled = np.cumsum(total * inside)
        codes = np.where(inside, GROUPS + (filled - total * inside) // group_suffixes, np.where(total > 1, LONGER, UNIQUE))
        out, at = [], 0
        for symbols, k, block, p in zip(rows["symbols"], rows["range"], rows["block"], parts):
            own = codes[number[at:at + len(p)]]
            at += len(p)
            out.append((symbols, k, block, _pack(own, 2), int((own == LONGER).sum())))
        return pd.DataFrame(out, columns=["symbols", "range", "block", "codes", "longer"])

    return code


# -- subtrees ------------------------------------------------------------------------------------------------------

GATHERED = "symbols int, range int, grp int, block long, n int, suffixes binary, keys binary"
MARKED = "symbols int, range int, grp int, block long, marks binary"


def _gather(s: _Suffixes, groups):
    for symbols, k, g, members in groups:
        at = s.distinct[members]
        named = np.stack([(x[at] >> np.uint64(32)).astype("<u4") for x in s.symbols], 1)
        keys = s.key[members].astype(np.uint64) ^ np.uint64(1 << 63)  # unsigned, in the same order
        yield symbols, k, g, s.block, len(members), named.tobytes(), _pack_sorted(keys)


def deep_nodes(symbols: np.ndarray, order: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Subtree of suffixes (rows of symbols): (suffixes in tree order, start of the internal nodes of full depth that each
    belongs to, or -1). Leaves of a node stand in the order of the keys ``order`` (most significant last, as in lexsort)."""
    m, depth = symbols.shape
    sa = np.lexsort((*order, *(symbols[:, k] for k in range(depth - 1, -1, -1))))
    ranked = symbols[sa]
    shared = np.zeros(m, np.int64)  # symbols shared with the suffix before
    same = np.ones(max(m - 1, 0), bool)
    for k in range(depth):
        same &= ranked[1:, k] == ranked[:-1, k]
        shared[1:] += same
    head = np.maximum.accumulate(np.where(shared < depth, np.arange(m), 0))
    size = np.bincount(head, minlength=m)
    return sa, np.where(size[head] > 1, head, -1)


def _marks(rows: pd.DataFrame) -> pd.DataFrame:
    """Per block, one bit per suffix that it sent: not the first leaf of a deep node."""
    rows = rows.sort_values("block")
    symbols = np.frombuffer(b"".join(rows["suffixes"]), "<u4").reshape(-1, SYMBOLS)
    keys = np.concatenate([_unpack_sorted(k) for k in rows["keys"]])
    place = np.arange(len(keys))  # by block, and within a block in corpus order
    sa, node = deep_nodes(symbols, (place, keys))
    marked = np.zeros(len(keys), bool)
    marked[sa] = (node >= 0) & (node != np.arange(len(sa)))
    at = np.concatenate([[0], np.cumsum(rows["n"])])
    bits = [_squeeze(np.packbits(marked[a:z]).tobytes()) for a, z in zip(at, at[1:])]
    return rows[["symbols", "range", "grp", "block"]].assign(marks=bits)


# -- the operator --------------------------------------------------------------------------------------------------

HOT = "w0 long, w1 long, key long, block long"


def _hot_names(s: _Suffixes, of: np.ndarray) -> np.ndarray:
    """128-bit names of suffixes by their symbols, as pairs of longs."""
    at = s.distinct[of]
    s0, s1, s2, s3 = (x[at] >> np.uint64(32) for x in s.symbols)
    return np.stack([(s0 << np.uint64(32)) | s1, (s2 << np.uint64(32)) | s3], 1).view(np.int64)


def _arrow(schema: str) -> list:
    import pyarrow as pa
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return [(c.split(" ")[0], types[c.split(" ")[1]]) for c in schema.split(", ")]


def _batches(rows, schema: str, limit: int = 1 << 23):
    import pyarrow as pa
    names, types = zip(*_arrow(schema))
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes)) + 64
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=list(names))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=list(names))


def remove_repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 20,
                            group_suffixes: int = 1 << 19, block_words: int = 1 << 19, range_keys: int = 1 << 21) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept`` (the kept words, joined by a space) of every row.

    A word goes if a window of ``n`` words that covers it also starts earlier in the corpus. ``key`` is of an integral type.
    """
    if n < SYMBOLS:
        raise ValueError(f"n must be at least {SYMBOLS}")
    kind = docs.schema[key].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("rows are ordered by a key of an integral type")
    spark = docs.sparkSession
    blocks = _blocks(docs, key, text, n, block_words)
    windows = blocks.agg(F.sum("n_windows")).first()[0] or 0
    bits = min(64, max(33, int(windows).bit_length() + 8))  # one unique prefix in 256 is taken for a repeated one
    ranges = max(8, -(-windows // range_keys))

    def passed(back: dict[str, tuple[DataFrame, str]], fn, schema: str) -> DataFrame:
        """One pass over the blocks with what came back to them."""
        rows = blocks
        for name, (df, columns) in back.items():
            rows = rows.join(df.groupBy("block").agg(F.collect_list(F.struct(*columns.split())).alias(name)), "block", "left")

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    yield from fn(row, _Suffixes(row, n, bits))

        return rows.mapInArrow(lean(run), schema)

    codes, symbols = None, FIRST
    code_columns = "symbols range codes"
    while symbols <= SYMBOLS:
        back = {} if codes is None else {"codes": (codes, code_columns)}
        counted = passed(back, lambda row, s: _batches(_count(s, row.get("codes"), ranges), COUNTED), COUNTED)
        with _few_rows(spark):
            now = materialize(counted.groupBy("symbols", "range").applyInPandas(lean(_code(group_suffixes)), CODED),
                              "suffix-prefixes", release=True)
        codes = now if codes is None else codes.unionByName(now)
        if now.filter("longer > 0").isEmpty():
            break
        symbols += 1
    hot = symbols > SYMBOLS  # some prefixes of the full depth have too many suffixes for a group

    gathered = passed({"codes": (codes, code_columns)},
                      lambda row, s: _batches(_gather(s, s.walk(row["codes"], ranges)[2]), GATHERED), GATHERED)
    with _few_rows(spark):
        marks = materialize(gathered.groupBy("symbols", "range", "grp").applyInPandas(lean(_marks), MARKED), "suffix-marks",
                            release=True)
    back = {"codes": (codes, code_columns), "marks": (marks, "symbols range grp marks")}

    if hot:
        def hot_rows(row, s):
            import pyarrow as pa
            active, symbols, _ = s.walk(row["codes"], ranges)
            if symbols > SYMBOLS and len(active):
                w = _hot_names(s, active)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(s.key[active]), pa.array(np.full(len(active), s.block))],
                    names=["w0", "w1", "key", "block"])

        with _few_rows(spark):
            sent = materialize(passed({"codes": (codes, code_columns)}, hot_rows, HOT), "suffix-hot", release=True)
        first = (sent.groupBy("w0", "w1").agg(F.min(F.struct("key", "block"))["block"].alias("first"))
                 .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        later = (sent.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
                 .join(first, ["w0", "w1", "salt"]).filter("block <> first"))
        back["hot"] = (later, "w0 w1")

    def finish(row, s: _Suffixes):
        import pyarrow as pa
        active, _, groups = s.walk(row["codes"], ranges)
        sent = {(r["symbols"], r["range"], r["grp"]): r["marks"] for r in row["marks"] or ()}
        marked = np.zeros(len(s.distinct), bool)
        for *group, members in groups:
            bits_ = np.unpackbits(np.frombuffer(_expand(sent[tuple(group)]), np.uint8), count=len(members))
            marked[members] = bits_.astype(bool)
        if row.get("hot"):
            later = {(r["w0"], r["w1"]) for r in row["hot"]}
            marked[active] = [tuple(w) in later for w in _hot_names(s, active).tolist()]
        later = np.ones(len(s.starts), bool)
        later[s.distinct] = False  # an equal suffix stands before it in the block
        at = s.starts[later | marked[s.number]]
        covered = np.zeros(len(s.tokens) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + n, -1)
        gone = np.cumsum(covered[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        starts = s.ends - s.sizes
        kept = []
        for a, z in zip(starts.tolist(), s.ends.tolist()):
            w = s.tokens[a:z]
            kept.append(b" ".join(map(s.vocabulary.__getitem__, w[~gone[a:z]].tolist())))
        step = 2000
        keys = row["keys"]
        for a in range(0, len(keys), step):
            cut = slice(a, a + step)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[cut], pa.int64()), pa.array(s.sizes[cut]), pa.array((removed[s.ends] - removed[starts])[cut]),
                 pa.array(kept[cut], pa.binary()).cast(pa.string())], names=["key", "n_words", "n_removed", "kept"])

    with _few_rows(spark):
        out = materialize(passed(back, finish, "key long, n_words long, n_removed long, kept string"), "suffix-kept", release=True)
    return out.select(F.col("key").cast(kind).alias(key), "n_words", "n_removed", "kept")
