"""Operator 8: WARC archives as Zstandard files.

An archive starts with a skippable frame that holds the dictionary of its
records, then comes one Zstandard frame per record. The reader loads that
dictionary, decodes one frame at a time and validates headers and lengths.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with
the largest id is a response and the others are revisits that name it; smaller
payloads are always responses. Null payloads are empty, a null id ranks below
every other (rows whose equal payloads all lack an id are responses), repeated
rows give repeated records. A revisit's block holds the HTTP headers of its
payload without the payload.

Files are written by tasks into a folder that all executors share, under names
used once; the rows a committed task returns name its files, so files of lost
or repeated attempts are never read. Memory is bounded by ``archive_bytes``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .common import materialize

#: fixed values of the format: magic of the dictionary's skippable frame, and of a Zstandard frame
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"
DATE = "2020-01-01T00:00:00Z"


KEEPER_BYTES, BROADCAST_BYTES, SALTS = 128, 64 << 20, 16


class WarcError(ValueError):
    pass


def _open(uri: str, mode: str):
    from pyarrow import fs
    if "://" in uri or uri.startswith("file:"):
        system, path = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))
    else:
        system, path = fs.LocalFileSystem(), uri
    if mode == "r":
        return system.open_input_stream(path, compression=None)  # the archive's own frames, not those of a name's ending
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def _header(value: str) -> str:
    """A header value without line ends: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if refers_to is None else b"")
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
            f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {_header(page_id)}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{_header(refers_to)}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes], size: int, sample_bytes: int):
    """A dictionary trained on records spread over the archive; raw content where there is too little to train on."""
    import zstandard as zstd
    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    sample = [r[:1 << 16] for r in records[::step]]
    try:
        return zstd.train_dictionary(size, sample, k=512, d=8, f=18, split_point=1.0, accel=4)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(sample)[:size]) if sample else None


def _write_archive(uri: str, records: list[bytes], level: int, dict_bytes: int, sample_bytes: int) -> None:
    import zstandard as zstd
    d = _dictionary(records, dict_bytes, sample_bytes)
    with _open(uri, "w") as f:
        if d is not None and len(d.as_bytes()) >= 8:
            packed = zstd.ZstdCompressor(level=level).compress(d.as_bytes())
            f.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            d.precompute_compress(level=level)
            c = zstd.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
        else:
            c = zstd.ZstdCompressor(level=level, write_checksum=True)
        for r in records:
            f.write(c.compress(r))


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url",
                   payload: str = "html", min_revisit: int = 1000, archive_bytes: int = 1 << 25, level: int = 3,
                   dict_bytes: int = 1 << 16, sample_bytes: int = 1 << 22) -> DataFrame:
    """Write the archives; returns the manifest: ``path``, ``n_records`` of every archive."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    long = F.octet_length("payload") >= min_revisit
    # one row per payload that occurs more than once; copies collapse before the shuffle
    repeated = (rows.filter(long).select(F.sha1("payload").alias("digest"), "page_id")
                .groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
                .filter("n > 1").drop("n"))
    repeated = materialize(repeated, "warc-keepers")
    # only long payloads are looked up; a page that is copied everywhere is dealt by a salt, if the keepers are too many to broadcast
    named = rows.filter(long).withColumn("digest", F.sha1("payload"))
    if repeated.count() * KEEPER_BYTES <= BROADCAST_BYTES:
        found = named.join(F.broadcast(repeated), "digest", "left")
    else:
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
        found = named.withColumn("salt", salt).join(
            repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"], "left")
    keeper = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).cast("string")
    marked = (found.select("page_id", "url", "payload", keeper.alias("refers_to"))
              .unionByName(rows.filter(~long).withColumn("refers_to", F.lit(None).cast("string")))
              .withColumn("page_id", F.col("page_id").cast("string")))

    def write(batches):
        held, size, out = [], 0, []

        def flush():
            nonlocal held, size
            uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            _write_archive(uri, held, level, dict_bytes, sample_bytes)
            out.append((uri, len(held)))
            held, size = [], 0

        for b in batches:
            for p, u, text, ref in zip(*(b[c].astype(object).where(b[c].notna(), None)
                                         for c in ("page_id", "url", "payload", "refers_to"))):
                held.append(_record(p, u, text.encode(), ref))
                size += len(held[-1])
                if size >= archive_bytes:
                    flush()
        if held:
            flush()
        yield pd.DataFrame(out, columns=["path", "n_records"])

    return materialize(marked.mapInPandas(write, "path string, n_records long"), "warc-manifest")


def frames(stream, block: int = 1 << 20):
    """The decoded records of an archive, one Zstandard frame each; at most a record and a block are held."""
    import zstandard as zstd
    head = stream.read(4)
    dictionary = None
    if len(head) == 4 and struct.unpack("<I", head)[0] == DICTIONARY_MAGIC:
        (n,) = struct.unpack("<I", stream.read(4))
        data = stream.read(n)
        if len(data) != n:
            raise WarcError("the dictionary's frame is cut off")
        if data[:4] == struct.pack("<I", FRAME_MAGIC):
            data = zstd.ZstdDecompressor().decompressobj().decompress(data)
        dictionary, head = zstd.ZstdCompressionDict(data), b""
    decoder = zstd.ZstdDecompressor(dict_data=dictionary) if dictionary else zstd.ZstdDecompressor()
    rest = bytes(head)
    while True:
        rest = rest or stream.read(block)
        if not rest:
            return
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise WarcError("a frame is cut off")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(block)
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of one record; raises WarcError where lengths or digests differ."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError(f"not a record: {lines[0][:40]!r}")

    def fields(lines):
        out = {}
        for x in lines:
            k, colon, v = x.partition(":")
            if not colon or not k or k.lower() in out:
                raise WarcError(f"bad header line {x[:60]!r}")
            out[k.lower()] = v.strip()
        return out

    h = fields(lines[1:])
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
        raise WarcError(f"no {sorted(missing)}")
    if not h["content-length"].isdigit():
        raise WarcError("bad Content-Length")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, its header says {n}")
    block = rest[:n]
    if f"sha1:{hashlib.sha1(block).hexdigest()}" != h.get("warc-block-digest"):
        raise WarcError("block digest differs")
    http, sep, body = block.partition(b"\r\n\r\n")
    lines = http.decode().split("\r\n")
    if not sep or not lines[0].startswith("HTTP/"):
        raise WarcError("no HTTP header")
    g = fields(lines[1:])
    if not g.get("content-length", "").isdigit():
        raise WarcError("bad HTTP Content-Length")
    if h["warc-type"] == "response":
        if len(body) != int(g["content-length"]):
            raise WarcError("payload length differs")
        if f"sha1:{hashlib.sha1(body).hexdigest()}" != h.get("warc-payload-digest"):
            raise WarcError("payload digest differs")
    elif h["warc-type"] != "revisit" or body or "warc-refers-to" not in h:
        raise WarcError(f"bad {h['warc-type']} record")
    return h, g, body


def _plain(value: str | None) -> str | None:
    return None if value is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives that ``manifest`` names: ids, url, type, payload and its length and digest."""

    def read(batches):
        for b in batches:
            for path, n in zip(b["path"], b["n_records"]):
                rows, size, seen = [], 0, 0
                with _open(path, "r") as f:
                    for data in frames(f):
                        h, g, body = parse_record(data)
                        ref = h.get("warc-refers-to")
                        rows.append((_plain(h.get("warc-page-id")), _plain(h.get("warc-target-uri")), h["warc-type"],
                                     _plain(ref[len("<urn:page:"):-1]) if ref else None, int(g["content-length"]),
                                     h["warc-payload-digest"].removeprefix("sha1:"),
                                     body if ref is None else None))
                        size, seen = size + len(body), seen + 1
                        if size > 1 << 23:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                if seen != n:
                    raise WarcError(f"{path} has {seen} records, the manifest says {n}")
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    spread = manifest.repartition(max(1, manifest.count()))  # an archive is the unit of work
    return spread.mapInPandas(read, "page_id string, url string, record_type string, refers_to string, "
                                    "payload_bytes long, payload_digest string, payload binary")
