"""Operator 1: language-model scores from a probabilistic suffix tree.

The model's contexts are the last words before a token, up to ``depth`` of
them. A context longer than none is kept if it passes a divergence test against
the context one word shorter: how much better its own next-word counts, each
without the occurrence at hand, predict those occurrences. A context that
occurs once gains exactly nothing, so the test begins with two occurrences.
Next-word distributions are smoothed by absolute discounting towards the
shorter context, down to the words' own counts, where one share is set aside
for all unknown words. A token is scored by the longest kept suffix of its
history.

The tree grows with the corpus, so it is never gathered in one place. Texts are
stored as blocks of word numbers. For every level, a block sends its distinct
(context, next word) pairs, as sorted arrays of hashes dealt by range of the
hash, and gets back the corpus counts of exactly these pairs; one block owns
each pair and adds it to its context's sums, which are dealt and returned the
same way. A pair that all texts share is one entry per block, so no word or
context, however frequent, burdens a task. Blocks and what came back to them are
tables bucketed by block: a pass reads them side by side and shuffles only what
is new.

Tokens are lower-cased words and one end per text. Null and empty texts have
the end alone. Rows with a null or false ``train`` column are only scored.
Repeated rows are learnt as often as they occur. Without training tokens all
words are unknown and the score is that of the unknown share alone.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from . import common
from .common import collect_garbage, drop_scratch, lean, materialize

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MIXED = 1 << 15
DISCOUNT = 0.75
PRIOR = 1000.0  # of the distribution that the divergence test uses
GAIN = 5.0  # nats a context must gain
DEPTH = 4  # words of the longest contexts
BLOCKS_PER_TASK = 2
ONCE_MORE = 2  # what occurs once has gain 0: the least count that can pass the test


def _mix(h: np.ndarray) -> np.ndarray:
    out = np.empty(len(h), np.uint64)
    spare = np.empty(min(len(h), _MIXED), np.uint64)
    for at in range(0, len(h), _MIXED):  # as many at once as a processor's own cache holds
        a, b = h[at:at + _MIXED], out[at:at + _MIXED]
        c = spare[:len(a)]
        np.right_shift(a, np.uint64(30), out=b)
        b ^= a
        b *= _B
        np.right_shift(b, np.uint64(27), out=c)
        c ^= b
        c *= _C
        np.right_shift(c, np.uint64(31), out=b)
        b ^= c
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of one of each, and the number of every key's distinct one."""
    order, ranked = _ranked(keys)
    new = np.zeros(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32)
    new[:1] = True
    new = np.flatnonzero(new)
    return ranked[new], order[new], number


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of hashes, and they in it. Their upper bits are sorted with their places in the lower ones, which is
    much faster than to sort places; where hashes differ in lower bits only and come out wrong, places are sorted."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = keys & ~low
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():
        order = np.argsort(keys)
        ranked = keys[order]
    return order, ranked


def _pack(numbers: np.ndarray) -> bytes:
    """Word numbers, byte plane by byte plane, compressed."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _woven(planes: np.ndarray) -> np.ndarray:
    """Byte planes, put together to rows of bytes."""
    out = np.empty(planes.shape[::-1], np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out


def _unpack(data: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return _woven(planes).view("<u4").ravel().astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, whose upper bytes are mostly zero, byte plane by byte plane, compressed."""
    import zstandard
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_keys(data: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(_woven(planes).view("<u8").ravel(), dtype=np.uint64)


def _words(texts):
    """How many words texts have, and all their words, as ``common.words`` takes them."""
    import pyarrow.compute as pc
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    parts = pc.list_flatten(lists)
    word = pc.greater(pc.binary_length(parts), 0)  # white space at an end of a text leaves an empty part
    before = np.concatenate([[0], np.cumsum(word.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return np.diff(before[ends], prepend=0), parts.filter(word)


def _blocks(docs: DataFrame, key: str, text: str, block_tokens: int) -> DataFrame:
    """Rows of texts as word numbers: ``block``, ``keys``, ``train``, ``sizes``, ``vocabulary`` (hashes), ``tokens``."""
    kind = docs.schema[key].dataType.simpleString()

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task, count = TaskContext.get().partitionId(), 0

        def flush():
            nonlocal count
            n = np.concatenate(sizes)
            named = pa.concat_arrays([pa.array([""], held[0].type), *held]).dictionary_encode()  # the end is the first word
            vocabulary = named.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
            inside = np.ones(int(n.sum()), bool)
            inside[np.cumsum(n) - 1] = False
            tokens = np.zeros(len(inside), np.int32)
            tokens[inside] = named.indices.to_numpy()[1:]
            row = ((task << 32) + count, keys, train, n.astype("<i4").tobytes(), hashes.tobytes(), _pack(tokens))
            count += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.list_(key_type), pa.list_(pa.bool_()), pa.binary(),
                                                        pa.binary(), pa.binary()))],
                names=["block", "keys", "train", "sizes", "vocabulary", "tokens"])

        keys, train, sizes, held, total, key_type = [], [], [], [], 0, None
        for b in batches:
            key_type = b.schema.field("key").type
            ids, learn, (n, found) = b.column("key").to_pylist(), b.column("learn").to_pylist(), _words(b.column("text"))
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                filled = total + np.cumsum(n[at:] + 1)
                to = at + min(int(np.searchsorted(filled, block_tokens)) + 1, len(filled))  # up to the text that fills the block
                begin = int(ends[at - 1]) if at else 0
                keys += ids[at:to]
                train += map(bool, learn[at:to])
                sizes.append(n[at:to] + 1)
                held.append(found.slice(begin, int(ends[to - 1]) - begin))
                total = int(filled[to - at - 1])
                at = to
                if total >= block_tokens:
                    yield flush()
                    keys, train, sizes, held, total = [], [], [], [], 0
        if keys:
            yield flush()

    return materialize(docs.select(F.col(key).alias("key"), F.col("_learn").alias("learn"), F.col(text).alias("text"))
                       .mapInArrow(lean(build), f"block long, keys array<{kind}>, train array<boolean>, sizes binary, "
                                          "vocabulary binary, tokens binary"), "lm-texts")


class _Tables:
    """Scratch tables of a row per block, bucketed by block: joins of them shuffle nothing."""

    def __init__(self, spark):
        self.spark, self.buckets, self.names = spark, 1, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` is dealt by ``dealt``."""
        path = scratch_path(self.spark, name)
        if common._SCOPES:
            common._SCOPES[-1].append(path)
        table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        self.names.append(table)
        collect_garbage(self.spark)  # what the step before used is only let go now
        df.write.format("parquet").bucketBy(self.buckets, "block").option("path", path).saveAsTable(table)
        del df
        collect_garbage(self.spark)
        return self.spark.table(table)

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, "block")

    def forget(self) -> None:
        """The tables leave the catalog; their files are scratch files."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")


# -- sums over the corpus for keys that blocks hold ----------------------------------------------------------------

SENT = "kind int, bucket int, block long, keys binary, v0 binary, v1 binary"
BACK = "kind int, bucket int, block long, n int, v0 binary, kept binary, owned binary"


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts, mostly small ones, byte plane by byte plane, compressed."""
    import zstandard
    width = max(1, (int(counts.max()).bit_length() + 7) // 8) if len(counts) else 1
    planes = b"".join((counts if not k else counts >> 8 * k).astype(np.uint8).tobytes() for k in range(width))
    return zstandard.ZstdCompressor(level=3).compress(planes)


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = raw[:n].astype("<i8")
    for k in range(1, len(raw) // n if n else 0):
        out |= raw[k * n:k * n + n].astype("<i8") << 8 * k
    return out


def _pack_gains(gains: np.ndarray) -> bytes:
    """Gains, of which most are those of pairs that occur once, few values in all, by their places among the distinct ones."""
    import zstandard
    values, number = np.unique(gains.view("<i8"), return_inverse=True)
    return (len(values).to_bytes(4, "little")
            + zstandard.ZstdCompressor(level=1).compress(values.tobytes() + number.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))


def _unpack_gains(data: bytes) -> np.ndarray:
    import zstandard
    n, raw = 8 * int.from_bytes(data[:4], "little"), np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), np.uint8)
    number = _woven(raw[n:].reshape(4, -1)).view("<u4").ravel()
    return raw[:n].view("<f8")[number]


def _pack_flags(flags: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=3).compress(np.packbits(flags).tobytes())


def _unpack_flags(data: bytes, n: int) -> np.ndarray:
    import zstandard
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), count=n).astype(bool)


def _send(kind: int, block: int, buckets: int, keys: np.ndarray, v0: np.ndarray, v1: np.ndarray | None = None):
    """Rows for sorted distinct ``keys`` and their values, dealt by range of the key."""
    at = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(at)):
        a, z = at[k], at[k + 1]
        yield (kind, int(k), block, _pack_keys(keys[a:z]), _pack_counts(v0[a:z]), b"" if v1 is None else _pack_gains(v1[a:z]))


def _batches(rows, schema: list, limit: int = 1 << 22):
    import pyarrow as pa
    names, types = zip(*schema)
    held, size = [], 0

    def batch():
        columns = list(zip(*held)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))

    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes)) + 64
        if size >= limit:
            yield batch()
            held, size = [], 0
    yield batch()


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    """Sums per key over the blocks of a bucket; every block gets those of its keys, one of them owns a key.

    Of a context's gain only the test's result goes back, a bit.
    """
    kind = int(group["kind"].iloc[0])
    group = group.sort_values("block")
    parts = [_unpack_keys(k) for k in group["keys"]]
    sizes, keys = [len(k) for k in parts], np.concatenate(parts)
    distinct, first, inverse = _distinct(keys)
    owned = np.zeros(len(keys), bool)
    owned[first] = True
    sent = np.concatenate([_unpack_counts(v, n) for v, n in zip(group["v0"], sizes)])
    counts = np.bincount(inverse, sent, len(distinct)).astype(np.int64)[inverse]
    gains = [_unpack_gains(v) for v in group["v1"] if v]
    kept = (np.bincount(inverse, np.concatenate(gains), len(distinct)) > GAIN)[inverse] if gains else None
    rows, at = [], 0
    for bucket, block, n in zip(group["bucket"], group["block"], sizes):
        cut = slice(at, at + n)
        # nobody asks who owns a context
        rows.append((kind, bucket, block, n, _pack_counts(counts[cut]), *((_pack_flags(kept[cut]), b"") if gains else
                                                                          (b"", _pack_flags(owned[cut])))))
        at += n
    return pd.DataFrame(rows, columns=["kind", "bucket", "block", "n", "v0", "kept", "owned"])


class _Back:
    """What came back to a block: values aligned with its sorted keys of a kind."""

    def __init__(self, rows):
        self.rows: dict[int, list] = {}
        for r in sorted(rows or (), key=lambda r: (r["kind"], r["bucket"])):
            self.rows.setdefault(r["kind"], []).append(r)

    def counts(self, kind: int) -> np.ndarray:
        parts = [_unpack_counts(r["v0"], r["n"]) for r in self.rows.get(kind, ())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def flags(self, kind: int, column: str) -> np.ndarray:
        parts = [_unpack_flags(r[column], r["n"]) for r in self.rows.get(kind, ())]
        return np.concatenate(parts) if parts else np.zeros(0, bool)


# kinds of keys: words; then for every level its pairs and its contexts
WORDS = 0


def _pairs(level: int) -> int:
    return 2 * level + 1


def _contexts(level: int) -> int:
    return 2 * level + 2


class _Root:
    """The words' own distribution."""

    def __init__(self, tokens: float, distinct: float, once: float, twice: float):
        self.tokens, self.distinct = tokens, distinct
        d = once / (once + 2 * twice) if once else 0.5
        self.discount = min(max(d, 0.05), 0.95)

    def of(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(count))
        return np.where(count > 0, count - self.discount, self.discount * self.distinct) / self.tokens

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))


class _Level:
    """A block's distinct pairs of contexts of one length and next words."""

    def __init__(self, key: np.ndarray, at: np.ndarray):
        # key: hash of context and next word, per position that has such a context; at: these positions
        self.at = at
        self.keys, self.one, self.inverse = _distinct(key)

    def counted(self, count: np.ndarray, size: np.ndarray) -> None:
        """``count``: of every pair; ``size``: the context's, per position."""
        self.count = count
        self.first = self.at[self.one]
        self.size = size[self.one].astype(float)

    def name(self, names: np.ndarray, parent: np.ndarray) -> None:
        """The contexts by which pairs are known here: ``names``, sorted, has the hash of every number of a context;
        ``parent``: the context's number, per position."""
        parent = parent[self.one]
        there = np.zeros(len(names), bool)
        there[parent] = True
        self.names = names[there]
        self.number = (np.cumsum(there, dtype=np.int32) - np.int32(1))[parent]

    def settle(self) -> None:
        """Lets go of what only the sums of the level and the next one need."""
        for name in ("keys", "one", "owned", "names", "shorter_tested"):
            self.__dict__.pop(name, None)

    def tested(self, count: np.ndarray, shorter: np.ndarray, left_out: int = 0) -> np.ndarray:
        """Next-word probability of every pair, as the divergence test takes it."""
        return (count - left_out + PRIOR * shorter) / (self.size - left_out + PRIOR)


def _walk(row, depth: int, least: list[int], root: _Root | None, named, tested: bool = True):
    """A block's arrays, level by level, as far as what came back allows. ``named``: levels whose contexts are wanted.
    ``tested``: whether their gains are."""
    back = _Back(row["back"])
    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    order = np.argsort(vocabulary)
    tokens, sizes = _unpack(row["tokens"]), np.frombuffer(row["sizes"], "<i4").astype(np.int64)
    train = np.repeat(np.array(row["train"], bool), sizes)
    state = {"back": back, "vocabulary": vocabulary, "order": order, "tokens": tokens, "sizes": sizes, "train": train, "levels": []}
    if WORDS not in back.rows:
        return state
    count = np.empty(len(vocabulary), np.int64)
    count[order] = back.counts(WORDS)
    state["count"] = count[tokens]
    if root is None:
        return state
    n = len(tokens)
    token = vocabulary[tokens]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    end = np.zeros(n, bool)
    end[np.cumsum(sizes) - 1] = True
    state["root"] = root.of(count)[tokens]
    shorter = state["root"].copy() if tested else None
    # a context is known by its number among sorted names: words, then the pairs of the level before, each of which makes
    # a longer context that occurs as often as the pair
    names, held = vocabulary[order], state["count"]
    before = np.flatnonzero(~end & (held >= least[0]))
    size, context = held[before], _mix(token[before] + _B)
    parent = rank[tokens[before]] if 0 in named else None
    for k in range(depth):
        at = (before + 1).astype(np.int32)
        context *= _A
        context += token[at]
        key = _mix(context)
        level = _Level(key, at)
        if k > 1 and len(at):  # an empty level may stand for one that is not sent yet
            state["levels"][k - 2].settle()
        state["levels"].append(level)
        if _pairs(k) not in back.rows:
            level.train = np.bincount(level.inverse[train[at]], minlength=len(level.keys)).astype("<i4")
            if len(at):
                break
        level.counted(back.counts(_pairs(k)), size)
        if tested:
            level.owned = back.flags(_pairs(k), "owned")
            level.shorter_tested = shorter[level.first]
            if k + 1 < depth and _pairs(k + 1) in back.rows:  # the level's own probability where it has one, for the test of the next level
                shorter[at] = level.tested(level.count, level.shorter_tested)[level.inverse]
        if k in named:
            level.name(names, parent)
        if k + 1 < depth:
            held = level.count[level.inverse]
            longer = np.flatnonzero((held >= least[k + 1]) & ~end[at])
            names, before, size, context = level.keys, at[longer], held[longer], _mix(key[longer] ^ _C)
            parent = level.inverse[longer] if k + 1 in named else None
    return state


def _context_sums(level: _Level):
    """Per context, from the pairs that the block owns: how many next words it has, and its gain over the shorter one."""
    own = level.owned & (level.count > 0)
    c = level.count[own].astype(float)
    left_out = (c - 1 + PRIOR * level.shorter_tested[own]) / (level.size[own] - 1 + PRIOR)
    gain = c * np.log(left_out / level.shorter_tested[own])
    n = len(level.names)
    return (level.names, np.bincount(level.number[own], minlength=n).astype("<i4"),
            np.bincount(level.number[own], gain, n).astype("<f8"))


def _scores(state, root: _Root, depth: int) -> np.ndarray:
    """log10 probability of every token by the longest kept suffix of its history."""
    p = state["root"].copy()  # of the longest suffix so far, kept or not: what longer ones are smoothed with
    best = p.copy()
    for k, level in enumerate(state["levels"][:depth]):
        if not len(level.at):
            break
        next_words = state["back"].counts(_contexts(k))[level.number].astype(float)
        passed = state["back"].flags(_contexts(k), "kept")[level.number]
        shorter = p[level.first]
        own = (np.maximum(level.count - DISCOUNT, 0) + DISCOUNT * next_words * shorter) / level.size
        p[level.at] = own[level.inverse]
        kept = passed[level.inverse]
        best[level.at[kept]] = p[level.at[kept]]
    return np.log10(best)


@contextmanager
def _few_rows(spark, rows: int):
    """Blocks are large rows: few of them per Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", depth: int | None = None,
          least: tuple = (ONCE_MORE,) * DEPTH, block_tokens: int = 1 << 20, bucket_tokens: int = 3 << 19) -> DataFrame:
    """``key``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    ``train``: which rows the model learns from. ``least``: for every length of
    contexts, how often they must occur to be tested; 2 leaves out nothing that
    could pass. ``depth``: the longest contexts, as many as ``least`` has by default.
    """
    tables = _Tables(docs.sparkSession)
    try:
        return _score(tables, docs, train, key, text, len(least) if depth is None else depth, list(least), block_tokens, bucket_tokens)
    finally:
        tables.forget()


def _score(tables: _Tables, docs: DataFrame, train: Column, key: str, text: str, depth: int, least: list, block_tokens: int,
           bucket_tokens: int) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    with common.scratch() as texts:
        dealt_anyhow = _blocks(docs.withColumn("_learn", F.coalesce(train, F.lit(False))), key, text, block_tokens)
    if common._SCOPES:
        common._SCOPES[-1].extend(texts)
    n_blocks = dealt_anyhow.count()
    buckets = max(1, -(-n_blocks * block_tokens // bucket_tokens))
    sent_schema = _arrow(SENT)
    tables.buckets = max(1, -(-n_blocks // BLOCKS_PER_TASK))
    blocks = tables.write(tables.dealt(dealt_anyhow), "lm-blocks")
    drop_scratch(spark, texts)

    def passed(back: list[DataFrame], fn, name: str, root, schema: str = SENT, named=(), tested: bool = True) -> DataFrame:
        """One pass over the blocks with all that came back to them; what they send is summed and returned to them."""
        rows = blocks
        parts = []
        for k, df in enumerate(back):
            wanted = ["counts"] if schema == SENT else ["counts", "sums"]  # contexts' sums are for the scores
            df = df.select("block", *[F.col(c).alias(f"{c}{k}") for c in wanted])
            parts += df.columns[1:]
            rows = rows.join(df.hint("shuffle_hash"), "block", "left")  # large rows are not sorted

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    row["back"] = [r for part in parts for r in row.pop(part) or ()]
                    yield from fn(row, _walk(row, depth, least, root, named, tested))

        out = rows.mapInArrow(lean(run), schema)
        with _few_rows(spark, 1):
            if schema != SENT:
                return materialize(out, name, release=True)
            out = tables.dealt(out.groupBy("kind", "bucket").applyInPandas(lean(_sum), BACK))
            returned, of_contexts = F.struct("kind", "bucket", "n", "v0", "kept", "owned"), (F.col("kind") > 0) & (F.col("kind") % 2 == 0)
            return tables.write(out.groupBy("block").agg(F.collect_list(F.when(~of_contexts, returned)).alias("counts"),
                                                         F.collect_list(F.when(of_contexts, returned)).alias("sums")), name)

    def send_words(row, s):
        counts = np.bincount(s["tokens"][s["train"]], minlength=len(s["vocabulary"])).astype("<i4")
        o = s["order"]
        return _batches(_send(WORDS, row["block"], buckets, s["vocabulary"][o], counts[o]), sent_schema)

    back = [passed([], send_words, "lm-word-counts", None)]
    root = _root(back[0])

    for k in range(depth):
        def send(row, s, k=k):
            def rows():
                if k and len(s["levels"]) >= k:
                    names, words_after, gain = _context_sums(s["levels"][k - 1])
                    yield from _send(_contexts(k - 1), row["block"], buckets, names, words_after, gain)
                if len(s["levels"]) > k:
                    yield from _send(_pairs(k), row["block"], buckets, s["levels"][k].keys, s["levels"][k].train)

            return _batches(rows(), sent_schema)

        back.append(passed(back, send, "lm-pair-counts", root, named=(k - 1,)))

    def send_last(row, s):
        names, words_after, gain = _context_sums(s["levels"][depth - 1])
        return _batches(_send(_contexts(depth - 1), row["block"], buckets, names, words_after, gain), sent_schema)

    back.append(passed(back, send_last, "lm-context-sums", root, named=(depth - 1,)))

    def finish(row, s):
        import pyarrow as pa
        ends = np.cumsum(s["sizes"])
        starts = ends - s["sizes"]
        sums = [np.add.reduceat(v, starts) for v in (s["count"] > 0, np.log10(root.base(s["count"])), _scores(s, root, depth))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["keys"], key_type), pa.array(row["train"]), pa.array(s["sizes"]), pa.array(sums[0].astype(np.int64)),
             pa.array([int(root.tokens)] * len(ends), pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
            names=[key, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    key_type = _arrow(f"key {kind}")[0][1]
    return passed(back, finish, "lm-scores", root, f"`{key}` {kind}, train boolean, n_tokens long, n_known long, "
                                                   "train_tokens long, base_score double, score double",
                  named=range(depth), tested=False)


def _arrow(schema: str) -> list:
    import pyarrow as pa
    types = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(),
             "smallint": pa.int16(), "double": pa.float64()}
    return [(n, types[t]) for n, t in (c.rsplit(" ", 1) for c in schema.split(", "))]


def _root(back: DataFrame) -> _Root:
    """Totals over the distinct words, each counted where it is owned."""

    def totals(batches):
        import pyarrow as pa
        sums = np.zeros(4)
        for b in batches:
            for rows in b.column("counts").to_pylist():
                for r in rows:
                    c = _unpack_counts(r["v0"], r["n"])[_unpack_flags(r["owned"], r["n"])]
                    sums += c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=list("abcd"))

    t = back.select("counts").mapInArrow(totals, "a double, b double, c double, d double")
    return _Root(*(x or 0.0 for x in t.agg(*[F.sum(c) for c in "abcd"]).first()))
