"""Operator 3: removal of long repeated byte strings with a run-length index.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else, in the same or another text, is marked; strings are judged on the input.

*Shards.* Of the 128-byte strings within a window of ``length`` bytes, the one
with the least hash is the window's anchor. Equal windows have equal anchors,
so consecutive windows with one anchor form a segment, and segments are dealt
by anchor. Only anchors that occur in two places of the distinct texts matter;
a text that occurs twice as a whole is marked as a whole. Equal segments are
stored once with the number of their places. An anchor with more distinct
segments than a task should hold is split by further anchors, which are also
functions of the window alone. What stays large after two splits, as a passage
between many different neighbours does, is not gathered: its windows are
counted by name over the corpus.

*Index.* Each shard builds a run-length index of its segments and streams
their matching statistics; a match of ``length`` bytes or more, or a segment
that has several places, marks bytes. Marks return to the texts as spans.

Null texts are empty; texts shorter than ``length`` are never marked; repeated
rows are copies of a text like any others.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import fresh, lean, materialize, schema_of
from .run_index import RunIndex

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
ANCHOR = 128
SPANS = "array<struct<start: long, end: long>>"


def window_anchors(data: bytes, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the strings that may be anchors, and the least one in the window from every position on."""
    h = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)) * (_A + np.uint64(2 * salt))
    h ^= h >> np.uint64(29)
    size, anchor = 8, min(ANCHOR, 1 << ((length // 2).bit_length() - 1))
    while size < anchor:
        right = h[size:]
        h = h[:-size] * _A + (right ^ (right >> np.uint64(31))) * _B
        h ^= h >> np.uint64(29)
        size *= 2
    h *= _C
    h ^= h >> np.uint64(32)
    return h, _least(h, length - anchor + 1)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least hash in each window: the least of the end of one block and the begin of the next."""
    count = len(h) - width + 1
    blocks = -(-len(h) // width)
    p = np.full(blocks * width, ~np.uint64(0))
    p[:len(h)] = h
    p = p.reshape(blocks, width)
    ahead = np.minimum.accumulate(p, axis=1).ravel()
    behind = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def anchor_runs(data: bytes, length: int, salt: int = 0):
    """Runs of windows with one anchor: the hashes, where segments (all bytes of the run's windows) start and end, and
    whether the anchor stands in several places of the segment, so that its windows may equal one another."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
    h, m = window_anchors(data, length, salt)
    change = np.flatnonzero(m[1:] != m[:-1]) + 1
    start, last = np.concatenate(([0], change)), np.concatenate((change, [len(m)])) - 1
    view = np.lib.stride_tricks.sliding_window_view(h, len(h) - len(m) + 1)
    several = np.zeros(len(start), bool)
    for k in range(0, len(start), 1024):  # first place in the first window, last place in the last one
        first = start[k:k + 1024] + view[start[k:k + 1024]].argmin(axis=1)
        final = last[k:k + 1024] + view.shape[1] - 1 - view[last[k:k + 1024], ::-1].argmin(axis=1)
        several[k:k + 1024] = first != final
    return m[start].view(np.int64), start.astype(np.int32), (last + length).astype(np.int32), several


def marked_parts(segments: list[bytes], places: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For every segment, the marked ranges of its bytes."""
    index = RunIndex(segments)
    hit = index.statistics() >= length
    out = []
    for s, n, a, z in zip(segments, places, index.start[:-1], index.start[1:]):
        if n > 1:
            out.append([(0, len(s))])
            continue
        out.append(_ranges(hit[a:z], length))
    return out


def _ranges(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """What the marked windows cover, as maximal ranges."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return [(int(x), int(y) + length) for x, y in zip(at[np.concatenate(([0], cut + 1))],
                                                      at[np.concatenate((cut, [len(at) - 1]))])]


def join_spans(spans) -> list[tuple[int, int]]:
    """Union of ranges, as maximal ranges in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def without(data: bytes, spans) -> bytes:
    at, parts = 0, []
    for a, z in spans:
        parts.append(data[at:a])
        at = z
    return b"".join([*parts, data[at:]])


def _text_spans(docs: DataFrame, text: str, length: int, keep: list[str], shard_bytes: int, anchor_bytes: int):
    """Rows (``keep``, ``_digest``, ``_bytes``), and by digest the texts to mark as a whole and the spans of others."""
    if length < 32:
        raise ValueError("length must be at least 32 bytes")

    def cut(batches):
        import pyarrow as pa
        for b in batches:
            raw = [(t or "").encode() for t in b.column(text).to_pylist()]
            runs = [anchor_runs(r, length) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [
                    pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary()),
                    pa.array([len(r) for r in raw], pa.int64()),
                    pa.array([r[0] for r in runs], pa.list_(pa.int64())), pa.array([r[1] for r in runs], pa.list_(pa.int32())),
                    pa.array([r[2] for r in runs], pa.list_(pa.int32())), pa.array([r[3] for r in runs], pa.list_(pa.bool_()))],
                names=[*keep, "_digest", "_bytes", "_anchor", "_start", "_end", "_several"])

    rows = docs.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(cut), ", ".join([*schema_of(docs, keep), "_digest binary, _bytes long, _anchor array<long>, _start array<int>, "
                                                "_end array<int>, _several array<boolean>"]))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "anchors")
    texts = materialize(rows.filter(F.col("_bytes") >= length).groupBy("_digest").agg(
        F.count("*").alias("copies"), F.min("_row").alias("_row")), "distinct-texts", release=True)
    runs = (rows.join(texts.select("_row", "copies"), "_row")
            .select(F.col("_digest").alias("digest"), "copies",
                    F.explode(F.arrays_zip("_anchor", "_start", "_end", "_several")).alias("r"))
            .select("digest", "copies", F.col("r._anchor").alias("anchor"), F.col("r._start").alias("start"),
                    F.col("r._end").alias("end"), F.col("r._several").alias("several")))
    shared = (runs.groupBy("anchor").agg(F.count("*").alias("n"), F.max("several").alias("several"))
              .filter("n > 1 or several").select("anchor"))
    wanted = runs.join(shared, "anchor").groupBy("digest").agg(
        F.first("copies").alias("copies"), F.collect_list(F.struct("anchor", "start", "end")).alias("runs"))
    content = F.coalesce(F.col(text), F.lit(""))
    bodies = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("body")).dropDuplicates(["digest"])
    bodies = materialize(bodies.join(wanted, "digest"), "texts-with-shared-anchors", release=True)
    segments = materialize(bodies.select("digest", "copies", "body", "runs").mapInArrow(lean(_segments), "anchor long, segment binary, digest binary, start int, end int, copies long, bytes binary"), "segments", release=True)
    marks = _marks(segments, length, shard_bytes, anchor_bytes)
    found = (segments.filter("copies = 1").select("anchor", "segment", "digest", "start").join(marks, ["anchor", "segment"])
             .select("digest", (F.col("start") + F.col("low")).cast("long").alias("low"),
                     (F.col("start") + F.col("high")).cast("long").alias("high"))
             .groupBy("digest").agg(F.collect_list(F.struct("low", "high")).alias("found")))
    whole = texts.filter("copies > 1").select("_digest", F.lit(True).alias("_whole"))
    return rows, whole, bodies, found


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 400, keep: list[str] | None = None,
                   shard_bytes: int = 3 << 19, anchor_bytes: int = 1 << 21) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) plus ``n_bytes``, ``spans`` (byte ranges to remove) and
    ``kept_sha256`` of the bytes that remain."""
    kept = docs.columns if keep is None else keep
    n_bytes, spans, sha = (fresh(x, docs.columns) for x in ("n_bytes", "spans", "kept_sha256"))
    rows, whole, bodies, found = _text_spans(docs, text, length, kept, shard_bytes, anchor_bytes)

    def finish(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for body, ranges in zip(b.column("body").to_pylist(), b.column("found").to_pylist()):
                s = join_spans([(r["low"], r["high"]) for r in ranges])
                out.append(([{"start": a, "end": z} for a, z in s],
                            hashlib.sha256(without(body.encode(), s)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), pa.array([o[0] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([o[1] for o in out], pa.string())], names=["_digest", "_spans", "_sha"])

    partly = bodies.select("digest", "body").join(found, "digest").mapInArrow(lean(finish), f"_digest binary, _spans {SPANS}, _sha string")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_bytes").alias("end")))
    return (rows.select(*kept, "_digest", "_bytes").join(whole, "_digest", "left").join(partly, "_digest", "left")
            .select(*kept, F.col("_bytes").alias(n_bytes),
                    F.when(F.col("_whole"), all_).otherwise(F.coalesce("_spans", F.array().cast(SPANS))).alias(spans),
                    F.when(F.col("_whole"), F.sha2(F.lit(""), 256)).otherwise(
                        F.coalesce("_sha", F.lower(F.hex("_digest")))).alias(sha)))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 400, shard_bytes: int = 3 << 19,
                   anchor_bytes: int = 1 << 21) -> DataFrame:
    """``docs`` with the marked bytes cut from ``text``; a character that is cut in part goes as a whole.

    Rows stay, also those of which nothing remains; null texts stay null.
    """
    _, whole, _, found = _text_spans(docs, text, length, [], shard_bytes, anchor_bytes)
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return _cut(docs.withColumn("_digest", digest).join(whole, "_digest", "left").join(
        found.withColumnRenamed("digest", "_digest"), "_digest", "left"), docs, text)


def _cut(joined: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` without the bytes that ``_whole`` and ``found`` mark in ``text``."""
    columns = docs.columns

    def cut(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for t, all_, ranges in zip(*(b.column(c).to_pylist() for c in (text, "_whole", "found"))):
                if t and all_:
                    t = ""
                elif t and ranges:
                    t = without(t.encode(), join_spans([(r["low"], r["high"]) for r in ranges])).decode(errors="ignore")
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else b.column(c) for c in columns],
                                             names=columns)

    return joined.select(*docs.columns, "_whole", "found").mapInArrow(lean(cut), ", ".join(schema_of(docs)))


def _segments(batches):
    """The bytes of every run, with a name for equal ones."""
    import pyarrow as pa
    for b in batches:
        out, size = [], 0
        for d, n, body, runs in zip(*(b.column(c).to_pylist() for c in ("digest", "copies", "body", "runs"))):
            raw = body.encode()
            for r in runs:
                s = raw[r["start"]:r["end"]]
                out.append((r["anchor"], xxhash.xxh3_128_digest(s), d, r["start"], r["end"], n, s))
                size += len(s)
            if size > 1 << 24:
                yield _segment_batch(out)
                out, size = [], 0
        yield _segment_batch(out)


def _segment_batch(out):
    import pyarrow as pa
    types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    columns = list(zip(*out)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      names=["anchor", "segment", "digest", "start", "end", "copies", "bytes"])


def _marks(segments: DataFrame, length: int, shard_bytes: int, anchor_bytes: int, most: int = 3) -> DataFrame:
    """``anchor``, ``segment``, ``low``, ``high``: marked ranges of distinct segments."""
    # parent: the segment that a part was cut from, and where; equal parts collapse before they are dealt
    parts = segments.select("anchor", "bytes", "copies")
    parts = materialize(parts.groupBy("anchor", "bytes").agg(F.sum("copies").alias("places")), "distinct-segments", release=True)
    done, origin, left = [], None, None
    for salt in range(1, most + 1):
        large = parts.groupBy("anchor").agg(F.sum(F.octet_length("bytes")).alias("b"), F.count("*").alias("n")) \
            .filter((F.col("b") > anchor_bytes) & (F.col("n") > 1)).select("anchor")
        large = materialize(large, "large-anchors")
        if large.isEmpty():
            done.append((parts, origin))
            break
        done.append((parts.join(large, "anchor", "left_anti"), origin))
        hot = parts.join(large, "anchor")
        if salt == most:
            left = hot
            break

        def split(batches, salt=salt):
            import pyarrow as pa
            for b in batches:
                out = []
                for a, s, n in zip(*(b.column(c).to_pylist() for c in ("anchor", "bytes", "places"))):
                    name = xxhash.xxh3_128_digest(s)
                    for k, x, z in zip(*(v.tolist() for v in anchor_runs(s, length, salt)[:3])):
                        out.append((a, name, x, (a * 0x9E3779B9 ^ k) + salt & 0x7FFFFFFFFFFFFFFF, n, s[x:z]))
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(),
                                                              pa.binary()))],
                    names=["up", "up_segment", "at", "anchor", "places", "bytes"])

        cut = materialize(hot.select("anchor", "bytes", "places").mapInArrow(lean(split), "up long, up_segment binary, at int, anchor long, places long, bytes binary"), "split-segments")
        origin = _joined(origin, cut)
        parts = materialize(cut.groupBy("anchor", "bytes").agg(F.sum("places").alias("places")), "distinct-segments", release=True)
    found = [(_index_marks(parts, length, shard_bytes), origin) for parts, origin in done]
    if left is not None:
        found.append((_window_marks(left, length), origin))
    out = None
    for marks, origin in found:
        if origin is not None:  # back to the segments of the first level
            marks = marks.join(origin, ["anchor", "segment"]).select(
                F.col("up").alias("anchor"), F.col("up_segment").alias("segment"), (F.col("low") + F.col("at")).alias("low"),
                (F.col("high") + F.col("at")).alias("high"))
        out = marks if out is None else out.unionByName(marks)
    return materialize(out, "marks", release=True)


def _joined(origin, cut):
    """Where each part stands in a segment of the first level."""
    named = cut.select("up", "up_segment", "at", "anchor", F.col("bytes"))

    def name(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("up", "up_segment", "at", "anchor")]
                + [pa.array([xxhash.xxh3_128_digest(s) for s in b.column("bytes").to_pylist()], pa.binary())],
                names=["up", "up_segment", "at", "anchor", "segment"])

    here = named.mapInArrow(lean(name), "up long, up_segment binary, at int, anchor long, segment binary")
    if origin is None:
        return here
    above = origin.select(F.col("up").alias("top"), F.col("up_segment").alias("top_segment"), F.col("at").alias("base"),
                          F.col("anchor").alias("up"), F.col("segment").alias("up_segment"))
    return here.join(above, ["up", "up_segment"]).select(
        F.col("top").alias("up"), F.col("top_segment").alias("up_segment"), (F.col("at") + F.col("base")).alias("at"),
        "anchor", "segment")


def _index_marks(parts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    total = parts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        segments = list(group["bytes"])
        found = marked_parts(segments, list(group["places"]), length)
        out = [(a, xxhash.xxh3_128_digest(s), x, y) for a, s, f in zip(group["anchor"], segments, found) for x, y in f]
        return pd.DataFrame(out, columns=["anchor", "segment", "low", "high"])

    return (parts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard")
            .applyInPandas(lean(mark), "anchor long, segment binary, low int, high int"))


def _window_names(segment: bytes, length: int) -> np.ndarray:
    """128-bit names of the windows of a segment."""
    names = [xxhash.xxh3_128_digest(segment[k:k + length]) for k in range(len(segment) - length + 1)]
    return np.frombuffer(b"".join(names), "S16")


def _window_marks(parts: DataFrame, length: int, block_bytes: int = 1 << 18) -> DataFrame:
    """As ``_index_marks``, for anchors of any number of segments: no anchor's segments meet.

    Segments are stored in blocks as they come. A block sends each of its
    distinct windows once, with its places, and gets back those that the corpus
    has twice or more; a window that all segments share is one row a block.
    """
    blocks = materialize(parts.select("anchor", "bytes", "places").mapInArrow(lean(_segment_blocks(block_bytes)), "block long, anchors array<long>, segments array<binary>, places array<long>"),
        "segment-blocks", release=True)

    def names(batches):
        import pyarrow as pa
        for b in batches:
            for block, segments, places in zip(*(b.column(c).to_pylist() for c in ("block", "segments", "places"))):
                of = [_window_names(x, length) for x in segments]
                name, number = np.unique(np.concatenate(of), return_inverse=True)
                n = np.bincount(number, np.repeat(places, [len(x) for x in of])).astype(np.int64)
                halves = np.frombuffer(name.tobytes(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                                                  pa.array(n)], names=["block", "w0", "w1", "n"])

    sent = blocks.mapInArrow(lean(names), "block long, w0 long, w1 long, n long")
    several = sent.groupBy("w0", "w1").agg(F.sum("n").alias("n")).filter("n > 1").select("w0", "w1")
    back = (sent.select("block", "w0", "w1").join(several, ["w0", "w1"]).groupBy("block")
            .agg(F.collect_list("w0").alias("w0"), F.collect_list("w1").alias("w1")))

    def mark(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for anchors, segments, places, w0, w1 in zip(*(b.column(c).to_pylist() for c in (
                    "anchors", "segments", "places", "w0", "w1"))):
                several = np.frombuffer(np.array([w0, w1], "<i8").T.tobytes(), "S16")
                for a, s, n in zip(anchors, segments, places):
                    ranges = [(0, len(s))] if n > 1 else _ranges(np.isin(_window_names(s, length), several), length)
                    out += [(a, xxhash.xxh3_128_digest(s), x, y) for x, y in ranges]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()))],
                                             names=["anchor", "segment", "low", "high"])

    return blocks.join(back, "block").mapInArrow(lean(mark), "anchor long, segment binary, low int, high int")


def _segment_blocks(block_bytes: int):
    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(((task << 32) + count, *map(list, zip(*held))), (
                    pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())))],
                names=["block", "anchors", "segments", "places"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "bytes", "places"))):
                held.append(row)
                size += len(row[1])
                if size >= block_bytes:
                    yield flush()
                    count, held, size = count + 1, [], 0
        if held:
            yield flush()

    return build


# -- passages of words ---------------------------------------------------------------------------------------------

GRAM = 8  # words of an anchor


def _word_windows(raw: bytes, n: int):
    """Where the words of a text start and end, their hashes (A-Z lower-cased), and the anchor of every window of n words."""
    at = [m.span() for m in re.finditer(rb"\S+", raw)]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, raw.lower().split()), np.uint64, len(at))
    if len(h) < n:
        return at, h, np.zeros(0, np.int64)
    size, g = 1, h
    while size < GRAM:
        g = g[:-size] * _A + (g[size:] ^ (g[size:] >> np.uint64(31))) * _B
        g ^= g >> np.uint64(29)
        size *= 2
    return at, h, _least(g * _C, n - GRAM + 1).view(np.int64)


def _wanted_names(raw: bytes, anchors: list[int], n: int):
    """The words' places, the windows with a wanted anchor, and their 128-bit names."""
    at, h, anchor = _word_windows(raw, n)
    data, wanted = h.tobytes(), np.flatnonzero(np.isin(anchor, anchors))
    return at, wanted, np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[8 * k:8 * (k + n)]) for k in wanted.tolist()]), "S16")


def remove_passages(docs: DataFrame, text: str = "text", n: int = 51, block_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` without the runs of ``n`` or more words that rows of ``docs`` share, whatever their length in bytes.

    Words are compared lower-cased (A-Z) and without the white space between
    them. Every occurrence is cut; rows stay, and null texts stay null. Only
    windows with an anchor that two rows share are named and counted, as in
    ``_window_marks``; no group gathers them.
    """
    if n < GRAM:
        raise ValueError(f"n must be at least {GRAM}")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))

    def anchors(batches):
        import pyarrow as pa
        for b in batches:
            found = [np.unique(_word_windows((t or "").encode(), n)[2]) for t in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(found, pa.list_(pa.int64()))], names=["digest", "anchors"])

    bodies = docs.select(digest.alias("digest"), F.col(text).alias("body"))
    # an anchor counts once a row, so copies of a text share all of theirs
    runs = materialize(bodies.mapInArrow(lean(anchors), "digest binary, anchors array<long>")
                       .select("digest", F.explode("anchors").alias("anchor")), "passage-anchors", release=True)
    shared = runs.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
    wanted = runs.join(shared, "anchor").groupBy("digest").agg(F.collect_set("anchor").alias("anchors"))
    texts = bodies.groupBy("digest").agg(F.first("body").alias("body"), F.count("*").alias("copies")).join(wanted, "digest")

    def block(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            types = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(((task << 32) + count, *map(list, zip(*held))), types)],
                                              names=["block", "digests", "bodies", "copies", "anchors"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("digest", "body", "copies", "anchors"))):
                held.append(row)
                size += len(row[1])
                if size >= block_bytes:
                    yield flush()
                    count, held, size = count + 1, [], 0
        if held:
            yield flush()

    blocks = materialize(texts.select("digest", "body", "copies", "anchors").mapInArrow(lean(block), "block long, digests array<binary>, bodies array<string>, copies array<long>, anchors array<array<long>>"),
        "passage-blocks", release=True)

    def names(batches):
        import pyarrow as pa
        for b in batches:
            for k, bodies, copies, anchors in zip(*(b.column(c).to_pylist() for c in ("block", "bodies", "copies", "anchors"))):
                of = [np.unique(_wanted_names(t.encode(), a, n)[2]) for t, a in zip(bodies, anchors)]  # once a row
                name, number = np.unique(np.concatenate(of), return_inverse=True)
                c = np.bincount(number, np.repeat(copies, [len(x) for x in of])).astype(np.int64)
                halves = np.frombuffer(name.tobytes(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k)), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                                                  pa.array(c)], names=["block", "w0", "w1", "n"])

    sent = blocks.mapInArrow(lean(names), "block long, w0 long, w1 long, n long")
    several = sent.groupBy("w0", "w1").agg(F.sum("n").alias("n")).filter("n > 1").select("w0", "w1")
    back = (sent.select("block", "w0", "w1").join(several, ["w0", "w1"]).groupBy("block")
            .agg(F.collect_list("w0").alias("w0"), F.collect_list("w1").alias("w1")))

    def mark(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for digests, bodies, anchors, w0, w1 in zip(*(b.column(c).to_pylist() for c in ("digests", "bodies", "anchors", "w0", "w1"))):
                several = np.frombuffer(np.array([w0, w1], "<i8").T.tobytes(), "S16")
                for d, t, a in zip(digests, bodies, anchors):
                    at, wanted, name = _wanted_names(t.encode(), a, n)
                    hit = np.zeros(len(at), bool)
                    hit[wanted[np.isin(name, several)]] = True
                    if spans := [{"low": at[x][0], "high": at[z - 1][1]} for x, z in _ranges(hit, n)]:
                        out.append((d, spans))
            columns = list(zip(*out)) or [()] * 2
            spans = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], spans)], names=["_digest", "found"])

    found = materialize(blocks.join(back, "block").mapInArrow(lean(mark), "_digest binary, found array<struct<low: long, high: long>>"), "passages", release=True)
    return _cut(docs.withColumn("_digest", digest).join(found, "_digest", "left").withColumn("_whole", F.lit(False)), docs, text)
