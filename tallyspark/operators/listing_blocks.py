"""Bodies from listings (P2) and token streams (P3) of any size: segmented scans over blocks.

A listing is cut into blocks. Inside a block the brace depth is counted from the block's
begin; a block is summed up by its change of depth and the places where it first comes down to (or through) each
depth. The blocks' starting depths are running sums over these summaries, a few numbers per block. The brace that
closes a body is then known by depth: in the body's own block, or in the first later block that comes to the wanted depth, which is
a look-ahead among summaries of one (listing, depth). Texts travel only where a body needs them, block by block, so no
group holds a listing and no task more than some blocks or one body.
"""

from __future__ import annotations

import gc
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import java_regex, py_strip
from ..session import scratch_path
from .listings import ADDRESS_COMMENT, RANGE_ADDRESS, RANGE_MARKER

BLOCK_CHARS = 1 << 16
BLOCK_TOKENS = 4096
PACKED_TOKENS = 1 << 16  # a task packs so many tokens at a time,
PACKED_BYTES = 64 << 20  # or so many bytes


def hex_address(c: Column | str) -> Column:
    """An address as ``0x`` and lower-case digits without leading zeros."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("0x"), F.lower(F.regexp_replace(c, r"^(?:0[xX])?0*(?=[0-9A-Fa-f])", "")))


def listing_blocks(listings: DataFrame, key: str = "listing_id", code: str = "code", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key, block, piece``: listings cut at line ends into blocks of at least ``block_chars`` characters (or one long line)."""
    pieces = F.regexp_extract_all(F.col(code), F.lit(rf"(?s).{{1,{block_chars}}}+[^\n]*+(?:\n|\z)"), F.lit(0))
    return (listings.select(F.col(key), F.posexplode_outer(pieces).alias("block", "piece")).filter(F.col("piece").isNotNull()))


def _scan_block(piece: str):
    """(characters, change of depth, first '}' that comes down to each depth, address comments) of a block."""
    chars = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32)
    closes = chars == ord("}")
    depth = np.cumsum((chars == ord("{")).astype(np.int64) - closes)
    at = np.flatnonzero(closes)
    depths, first = np.unique(depth[at], return_index=True)
    newlines = np.flatnonzero(chars == ord("\n"))
    marks = []
    for m in ADDRESS_COMMENT.finditer(piece):
        s = m.end()
        before = int(depth[s - 1])
        own = at[np.searchsorted(at, s):]
        hits = own[depth[own] == before]
        line = np.searchsorted(newlines, s)
        marks.append({"at": s, "address": hex(int(m.group(1), 16)), "depth": before,
                      "line_end": int(newlines[line]) if line < len(newlines) else -1, "close": int(hits[0]) if len(hits) else -1})
    return len(chars), int(depth[-1]) if len(chars) else 0, [{"depth": int(d), "at": int(at[k])} for d, k in zip(depths, first)], marks


def _scanned(blocks: DataFrame, key: str) -> DataFrame:
    kind = blocks.schema[key].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa
        pair = pa.list_(pa.struct([("depth", pa.int64()), ("at", pa.int64())]))
        mark = pa.list_(pa.struct([("at", pa.int64()), ("address", pa.string()), ("depth", pa.int64()), ("line_end", pa.int64()),
                                   ("close", pa.int64())]))
        for b in batches:
            n, change, closes, marks = zip(*map(_scan_block, b.column("piece").to_pylist())) if b.num_rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column("block"), pa.array(n, pa.int64()), pa.array(change, pa.int64()), pa.array(closes, pair),
                 pa.array(marks, mark)], names=[key, "block", "n", "change", "closes", "marks"])

    return blocks.select(key, "block", "piece").mapInArrow(
        scan, f"`{key}` {kind}, block int, n long, change long, closes array<struct<depth: long, at: long>>, "
              "marks array<struct<at: long, address: string, depth: long, line_end: long, close: long>>")


def _before(change: str, key: str, order: str = "block") -> Column:
    """Sum of ``change`` over the blocks before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(change).over(w), F.lit(0))


def _next_at_depth(marks: DataFrame, stops: DataFrame, key: str) -> DataFrame:
    """``marks`` (``key, depth, block``, ...) with ``stop``: the first of ``stops`` (``key, depth, block, at``) at their depth in a later
    block, or null."""
    kept = [c for c in marks.columns if c not in (key, "depth", "block")]
    m = marks.select(key, "depth", "block", F.struct(*kept).alias("m"), F.lit(None).cast("long").alias("at"))
    kind = m.schema["m"].dataType
    s = stops.select(key, "depth", "block", F.lit(None).cast(kind).alias("m"), F.col("at").cast("long").alias("at"))
    later = Window.partitionBy(key, "depth").orderBy("block").rangeBetween(1, Window.unboundedFollowing)
    found = F.min(F.when(F.col("at").isNotNull(), F.struct("block", "at"))).over(later)
    return (m.unionByName(s).withColumn("stop", found).filter(F.col("m").isNotNull())
            .select(key, "depth", "block", "m.*", "stop"))


def _joined(bodies: DataFrame, blocks: DataFrame, key: str, part: Column, name: list[str]) -> DataFrame:
    """Bodies (``key, *name, block, end_block``, ...) with ``body``: ``part`` of every block from the first to the last, joined."""
    pieces = (bodies.withColumn("first_block", F.col("block")).withColumn("block", F.explode(F.sequence("block", "end_block")))
              .join(blocks, [key, "block"]).select(key, *name, "block", part.alias("part")))
    parts = F.array_sort(F.collect_list(F.struct("block", "part")))
    return pieces.groupBy(key, *name).agg(py_strip(F.array_join(F.transform(parts, lambda p: p["part"]), "")).alias("body"))


def block_listing_bodies(blocks: DataFrame, requests: DataFrame, key: str = "listing_id") -> DataFrame:
    """P2 over blocks (``key, block, piece``; blocks end at line ends): one row per requested ``(key, address)`` that a ``// HEX:`` comment names.

    The body starts on the line after the comment and ends at the brace that balances; an unbalanced one ends one
    character before the listing does. A later comment of the same address wins. Same rows as
    :func:`~tallyspark.operators.listings.listing_bodies`. Null pieces and addresses give nothing.
    """
    blocks = blocks.filter(F.col("piece").isNotNull() & (F.col("piece") != ""))
    scanned = _scanned(blocks, key).checkpoint()
    base = (scanned.withColumn("base", _before("change", key))
            .withColumn("last", F.max(F.struct("block", "n")).over(Window.partitionBy(key))))
    wanted = requests.select(key, hex_address("address").alias("address")).dropna().distinct()
    marks = (base.select(key, "block", "base", "last", F.explode("marks").alias("m"))
             .select(key, "block", "last", "m.at", "m.address", "m.line_end", "m.close", (F.col("base") + F.col("m.depth")).alias("depth"))
             .join(wanted, [key, "address"], "left_semi")
             .groupBy(key, "address").agg(F.max_by(F.struct("block", "last", "at", "line_end", "close", "depth"),
                                                   F.struct("block", "at")).alias("m"))
             .select(key, "address", "m.*"))
    stops = base.select(key, "block", "base", F.explode("closes").alias("c")).select(
        key, (F.col("base") + F.col("c.depth")).alias("depth"), "block", F.col("c.at").alias("at"))
    found = _next_at_depth(marks, stops, key)
    own = F.col("close") >= 0
    begin = F.when((F.col("line_end") >= 0) & (~own | (F.col("line_end") < F.col("close"))), F.col("line_end") + 1).otherwise(F.col("at"))
    end_block = F.when(own, F.col("block")).when(F.col("stop").isNotNull(), F.col("stop.block")).otherwise(F.col("last.block"))
    end = F.when(own, F.col("close") + 1).when(F.col("stop").isNotNull(), F.col("stop.at") + 1).otherwise(F.col("last.n") - 1)
    bodies = found.select(key, "address", "block", begin.alias("begin"), end_block.alias("end_block"), end.alias("end"))
    start = F.when(F.col("block") == F.col("first_block"), F.col("begin")).otherwise(F.lit(0))
    stop = F.when(F.col("block") == F.col("end_block"), F.col("end")).otherwise(F.length("piece"))
    part = F.substring("piece", (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))
    return _joined(bodies, blocks.select(key, "block", "piece"), key, part, ["address"])


def _packed(rel: np.ndarray, lengths: np.ndarray, text: bytes, codec) -> bytes:
    """Tokens of a block: places in it (ascending), bytes of each, all their bytes; compressed."""
    wide, even = bool(len(lengths) and lengths.max() > 255), int(rel[-1] - rel[0]) + 1 == len(rel)
    raw = lengths.astype("<u4" if wide else "u1").tobytes() + (b"" if even else rel.astype("<i4").tobytes()) + text
    head = np.array([len(rel), rel[0], wide, even, len(raw)], "<i8").tobytes()
    return head + codec.compress(raw, asbytes=True)


def _unpacked(chunk: bytes, codec) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(places, ends of the tokens from 0 on, bytes) of :func:`_packed`."""
    n, first, wide, even, size = (int(x) for x in np.frombuffer(chunk, "<i8", 5))
    raw = codec.decompress(memoryview(chunk)[40:], size, asbytes=True)
    lengths = np.frombuffer(raw, "<u4" if wide else "u1", n)
    rel = np.arange(first, first + n) if even else np.frombuffer(raw, "<i4", n, lengths.nbytes).astype(np.int64)
    return rel, np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), raw[lengths.nbytes + (0 if even else 4 * n):]


def _chunks(tokens: DataFrame, key: str, block_tokens: int) -> DataFrame:
    """``key, block, chunk, braces, marks`` of tokens (``key, pos, val, address``): what a task has of a block together, packed. A block
    has several rows where its tokens are in several tasks or far apart in one."""
    kind = tokens.schema[key].dataType.simpleString()

    def packed(t):
        import pyarrow as pa
        import pyarrow.compute as pc
        codec = pa.Codec("zstd", compression_level=3)

        def of(t):
            whole = lambda c: pa.concat_arrays(t.column(c).chunks)
            ids, val = whole(key).dictionary_encode().indices.to_numpy(zero_copy_only=False), whole("val").cast(pa.large_string())
            return ids, t.column("pos").to_numpy(), val
        ids, pos, val = of(t)
        if ((ids[1:] == ids[:-1]) & (pos[1:] <= pos[:-1])).any():
            t = t.take(pc.sort_indices(pa.table({"id": ids, "pos": pos, "val": val}), [(c, "ascending") for c in ("id", "pos", "val")]))
            ids, pos, val = of(t)
        block = pos // block_tokens
        rel = pos - block * block_tokens
        starts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (block[1:] != block[:-1]))))
        edges = np.concatenate((starts, [len(pos)]))
        delta = np.zeros(len(pos), np.int32)
        for sign, brace in ((1, "{"), (-1, "}")):
            delta[pc.fill_null(pc.equal(val, brace), False).to_numpy(zero_copy_only=False)] = sign
        braces = np.flatnonzero(delta)
        signed = ((rel[braces] + 1) * delta[braces]).astype("<i4")
        marked = np.flatnonzero(t.column("address").is_valid().to_numpy())
        addresses = pa.concat_arrays(t.column("address").take(pa.array(marked)).cast(pa.string()).chunks or [pa.array([], pa.string())])
        val = pc.fill_null(val, "")
        at = np.frombuffer(val.buffers()[1], np.int64)[val.offset:val.offset + len(val) + 1]
        data = memoryview(val.buffers()[2] or b"")
        lengths = np.diff(at)
        of_block = np.searchsorted(braces, edges)
        chunks = [_packed(rel[a:e], lengths[a:e], bytes(data[at[a]:at[e]]), codec) for a, e in zip(edges[:-1], edges[1:])]
        marks = pa.ListArray.from_arrays(pa.array(np.searchsorted(marked, edges), pa.int32()),
                                         pa.StructArray.from_arrays([pa.array(pos[marked]), addresses], names=["pos", "address"]))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(t.column(key).take(pa.array(starts)).chunks), pa.array(block[starts]), pa.array(chunks, pa.binary()),
             pa.array([signed[a:e].tobytes() for a, e in zip(of_block[:-1], of_block[1:])], pa.binary()), marks],
            names=[key, "block", "chunk", "braces", "marks"])

    def pack(batches):
        import pyarrow as pa
        held, rows, size = [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= PACKED_TOKENS or size >= PACKED_BYTES:
                yield packed(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
        if held:
            yield packed(pa.Table.from_batches(held))

    return tokens.select(key, "pos", "val", "address").mapInArrow(
        pack, f"`{key}` {kind}, block long, chunk binary, braces binary, marks array<struct<pos: long, address: string>>")


def _scan_token_block(pos: np.ndarray, delta: np.ndarray, marks: list):
    """(change of depth, first '{', first place of each depth, the same from the first '{' on, marks) of a block of tokens."""
    depth, opens = np.cumsum(delta), pos[delta > 0]

    def first(since: int):
        depths, at = np.unique(depth[since:], return_index=True)
        return [{"depth": int(d), "at": int(pos[since + k])} for d, k in zip(depths, at)]

    found = []
    for m in marks:
        k, o = np.searchsorted(pos, m["pos"], "right"), np.searchsorted(opens, m["pos"], "right")
        before, begin, close = int(depth[k - 1]) if k else 0, None, None
        if o < len(opens):
            begin = int(opens[o])
            since = np.searchsorted(pos, begin)
            hits = np.flatnonzero(depth[since:] == before)
            close = int(pos[since + hits[0]]) if len(hits) else None
        found.append({"at": m["pos"], "address": m["address"], "depth": before, "open": begin, "close": close})
    return (int(delta.sum()), int(opens[0]) if len(opens) else None, first(0),
            first(int(np.searchsorted(pos, opens[0]))) if len(opens) else [], found)


def _scanned_tokens(chunks: DataFrame, key: str, block_tokens: int) -> DataFrame:
    kind = chunks.schema[key].dataType.simpleString()

    def scanned(block: int, braces: list, marks: list):
        signed = np.frombuffer(b"".join(braces), "<i4").astype(np.int64)
        pos, delta = np.abs(signed) - 1 + block * block_tokens, np.sign(signed)
        order = np.lexsort((delta, pos))
        marks = sorted((m for of in marks for m in of), key=lambda m: (m["pos"], m["address"]))
        return _scan_token_block(pos[order], delta[order], marks)

    def scan(batches):
        import pyarrow as pa
        pair = pa.list_(pa.struct([("depth", pa.int64()), ("at", pa.int64())]))
        mark = pa.list_(pa.struct([("at", pa.int64()), ("address", pa.string()), ("depth", pa.int64()), ("open", pa.int64()), ("close", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pair, pair, mark]
        for b in batches:
            found = [*zip(*map(scanned, *(b.column(c).to_pylist() for c in ("block", "braces", "marks"))))] or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("block"), *map(pa.array, found, kinds)],
                                             names=[key, "block", "change", "open", "closes", "after", "marks"])

    pairs = "array<struct<depth: long, at: long>>"
    return chunks.groupBy(key, "block").agg(F.collect_list("braces").alias("braces"), F.collect_list("marks").alias("marks")).mapInArrow(
        scan, f"`{key}` {kind}, block long, change long, open long, closes {pairs}, after {pairs}, "
              "marks array<struct<at: long, address: string, depth: long, open: long, close: long>>")


def _cut_tokens(wanted: DataFrame, key: str, block_tokens: int) -> DataFrame:
    """``key, block, address, part``: of every block's ``chunks`` the tokens that its ``wants`` (address, start, close) name, joined."""
    kind = wanted.schema[key].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa
        codec = pa.Codec("zstd")

        def pieces(block: int, chunks: list, wants: list):
            """The parts of a block; chunks that are not one after the other are put in order token by token."""
            held = [_unpacked(c, codec) for c in chunks]
            if len(held) == 1:
                rel, ends, text = held[0]
            else:
                tokens = sorted((int(p), text[a:e]) for rel, ends, text in held for p, a, e in zip(rel, ends[:-1], ends[1:]))
                rel, text = np.array([p for p, _ in tokens], np.int64), b"".join(v for _, v in tokens)
                ends = np.concatenate(([0], np.cumsum([len(v) for _, v in tokens], dtype=np.int64)))
            for w in wants:
                a, e = np.searchsorted(rel + block * block_tokens, (w["start"], w["close"]), "right")
                yield w["address"], text[ends[a]:ends[e]].decode()

        for b in batches:
            chunks, row, address, part, size = b.column("chunks"), [], [], [], 0
            for k, (block, wants) in enumerate(zip(b.column("block").to_pylist(), b.column("wants").to_pylist())):
                for name, piece in pieces(block, chunks[k].as_py(), wants):
                    row.append(k)
                    address.append(name)
                    part.append(piece)
                    size += len(piece)
                if k + 1 == b.num_rows or size > 4 << 20:
                    at = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(key).take(at), b.column("block").take(at), pa.array(address, pa.string()),
                                                      pa.array(part, pa.string())], names=[key, "block", "address", "part"])
                    row, address, part, size = [], [], [], 0

    return wanted.select(key, "block", "chunks", "wants").mapInArrow(cut, f"`{key}` {kind}, block long, address string, part string")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again; the shuffle files it was made from are let go."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def block_token_bodies(tokens: DataFrame, requests: DataFrame, key: str = "listing_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """P3 over a token stream ``(key, pos, kind, val)`` of any length; same rules as
    :func:`~tallyspark.operators.listings.token_list_bodies`.

    Tokens are read once, packed where they are by blocks of ``block_tokens`` positions, and shuffled once as such packets, to what
    is wanted of them; depths change at braces only, so all else works on braces and comments, and blocks' summaries are all that is
    ordered over a listing.
    """
    val = F.col("val")
    address = F.when((F.col("kind") == "cmnt") & val.contains(RANGE_MARKER), F.nullif(F.regexp_extract("val", java_regex(RANGE_ADDRESS), 0), F.lit("")))
    t = (tokens.filter(F.col(key).isNotNull() & F.col("pos").isNotNull())
         .select(key, F.col("pos").cast("long").alias("pos"), "val", address.alias("address")))
    chunks = _kept(_chunks(t, key, block_tokens), "token-chunks")
    base = _scanned_tokens(chunks, key, block_tokens).withColumn("base", _before("change", key))
    after = Window.partitionBy(key).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    later = F.first(F.when(F.col("open").isNotNull(), F.struct("block", "open", "base", "after")), ignorenulls=True).over(after)
    base = _kept(base.withColumn("later", later).select(key, "block", "base", "closes", "later", "marks"), "token-depths")
    wanted = requests.select(key, "address").dropna().distinct()
    depth = F.col("base") + F.col("m.depth")
    there = F.get(F.filter("later.after", lambda x: x["depth"] + F.col("later.base") == depth), 0)["at"]
    own = F.col("m.open").isNotNull()
    marks = (base.select(key, "block", "base", "later", F.explode("marks").alias("m"))
             .select(key, "m.address", F.col("m.at").alias("start"), F.col("block").alias("start_block"), depth.alias("depth"),
                     F.when(own, F.col("block")).otherwise(F.col("later.block")).alias("block"), F.when(own, F.col("m.close")).otherwise(there).alias("own"))
             .join(wanted, [key, "address"], "left_semi")
             .withColumn("next", F.lead("start").over(Window.partitionBy(key).orderBy("start")))
             .filter(F.col("block").isNotNull()))  # a body has a brace that opens
    kept = [key, "address", "start", "start_block", "next"]
    stops = base.select(key, "block", "base", F.explode("closes").alias("c")).select(
        key, (F.col("base") + F.col("c.depth")).alias("depth"), "block", F.col("c.at").alias("at"))
    # what the next comment ends before the block does closes in no later block
    on = marks.filter(F.col("own").isNull() & (F.col("next").isNull() | (F.floor(F.col("next") / block_tokens) > F.col("block"))))
    closed = (marks.filter(F.col("own").isNotNull()).select(*kept, F.col("own").alias("close"))
              .unionByName(_next_at_depth(on.select(*kept, "depth", "block"), stops, key).select(*kept, F.col("stop.at").alias("close"))))
    found = (closed.filter(F.col("close").isNotNull() & (F.col("next").isNull() | (F.col("close") < F.col("next"))))
             .groupBy(key, "address").agg(F.max_by(F.struct("start", "start_block", "close"), F.col("start")).alias("m"))
             .select(key, "address", "m.*").withColumn("end_block", F.floor(F.col("close") / block_tokens).cast("long")))
    wants = _kept(found.withColumn("block", F.explode(F.sequence("start_block", "end_block")))
                  .groupBy(key, "block").agg(F.collect_list(F.struct("address", "start", "close")).alias("wants")), "token-wants")
    held = chunks.groupBy(key, "block").agg(F.collect_list("chunk").alias("chunks"))
    parts = F.sort_array(F.collect_list(F.struct("block", "part")))
    return (_cut_tokens(held.join(wants, [key, "block"]), key, block_tokens).groupBy(key, "address")
            .agg(py_strip(F.array_join(F.transform(parts, lambda p: p["part"]), "")).alias("body")))
