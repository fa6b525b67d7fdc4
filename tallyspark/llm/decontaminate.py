"""Operator 7: benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case (A-Z) words joined by one space; a word is
a run of ASCII letters, digits and characters beyond ASCII. A window is
``window`` consecutive words of an item; an item of fewer words, but not none,
is one window. The automaton holds every window of every item and scans each
document once; a match is mapped to the words it covers and, through them, to
offsets in the original text.

The automaton is broadcast, so the size of the benchmark is checked first:
beyond ``shard_bytes`` of item text the items are dealt into shards by digest,
each an automaton of bounded size and a scan of its own, and their hits are
merged per document.

A null text has no words. A null item id counts as an empty one; repeated item
rows count once, repeated documents are scanned each by itself. Without items nothing is hit; an empty table of
documents gives no rows. A text of any length is scanned by one task.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import fresh, materialize, schema_of

#: bytes of words stay (A-Z in lower case), all others become a space
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPANS = "array<struct<word_start: long, word_end: long, char_start: long, char_end: long>>"


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def windows(text: str | None, n: int) -> list[bytes]:
    w = normal_words(text)
    return [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def build_automaton(items: list[tuple[str, str]], n: int):
    """Every window of the items, with the indexes of the items that have it; None if there is no window."""
    import ahocorasick
    owners: dict[bytes, list[int]] = {}
    for k, (_, text) in enumerate(items):
        for w in set(windows(text, n)):
            owners.setdefault(w, []).append(k)
    if not owners:
        return None
    a = ahocorasick.Automaton()
    for w, ks in owners.items():
        key = f" {w.decode('latin-1')} "  # a character per byte: offsets are those of the bytes
        a.add_word(key, (len(key), w.count(b" ") + 1, tuple(ks)))
    a.make_automaton()
    return a


def scan(automaton, text: str | None):
    """Number of words, hit runs and the indexes of the items met in one text."""
    if not text:
        return 0, [], set()
    raw = text.encode()
    clean = raw.translate(_TABLE)
    w = clean.split()
    if not w or automaton is None:
        return len(w), [], set()
    line = f" {b' '.join(w).decode('latin-1')} "
    hits, met = [], set()
    for end, (size, n, ks) in automaton.iter(line):
        hits.append((end - size + 1, n))
        met.update(ks)
    if not hits:
        return len(w), [], met
    # a window starts at the space before its first word: the number of spaces before it is that word's index
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    first = np.searchsorted(spaces, np.array([h[0] for h in hits]))
    mark = np.zeros(len(w) + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + np.array([h[1] for h in hits]), -1)
    hit = np.cumsum(mark[:-1]) > 0
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # words in the original: runs of kept bytes; code points: bytes that do not continue one
    kept = np.diff(np.concatenate(([0], (np.frombuffer(clean, np.uint8) != 32).view(np.int8), [0])))
    begin, end = np.flatnonzero(kept == 1), np.flatnonzero(kept == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    spans = [{"word_start": int(a), "word_end": int(z), "char_start": int(chars[begin[a]]),
              "char_end": int(chars[end[z - 1]])} for a, z in zip(lo, hi)]
    return len(w), spans, met


_BUILT: dict = {}
SHARD_BYTES = 1 << 19  # of items in one automaton, which then has about four million nodes and 200 MB


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = 10, shard_bytes: int = SHARD_BYTES,
                       keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) plus ``n_words``, ``spans`` and ``items``.

    ``spans``: the runs of hit words, as ranges of words and of characters of
    the original text. ``items``: sorted ids, as strings, of items with windows
    in the text. A column of ``docs`` of the same name keeps it; the new one
    gets an underscore in front. An automaton has up to ``window`` nodes for a byte of an item, so items beyond ``shard_bytes`` are
    dealt into shards of that size, each of which scans the documents once more.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col(item_text), F.lit("")).alias("words")).distinct()
    size = bench.agg(F.sum(F.octet_length("words") + F.octet_length("item"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    kept = docs.columns if keep is None else keep
    n_words, spans, items = (fresh(n, docs.columns) for n in ("n_words", "spans", "items"))
    added = f"{n_words} long, {spans} {SPANS}, {items} array<string>"

    def scanned(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
        own = bench.filter(F.pmod(F.xxhash64("item", "words"), F.lit(shards)) == k) if shards > 1 else bench
        shipped = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # about shard_bytes at most
        key = uuid.uuid4().hex  # of the automaton in a worker's memory

        def scan_all(batches):
            import pyarrow as pa
            if key not in _BUILT:
                _BUILT.clear()
                _BUILT[key] = build_automaton(shipped.value, window)
            for b in batches:
                found = [scan(_BUILT[key], t) for t in b.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in columns] + [
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.list_(pa.struct([(x, pa.int64()) for x in (
                            "word_start", "word_end", "char_start", "char_end")]))),
                        pa.array([sorted({shipped.value[j][0] for j in f[2]}) for f in found], pa.list_(pa.string()))],
                    names=[*columns, n_words, spans, items])

        return rows.mapInArrow(scan_all, ", ".join([*schema_of(rows, columns), added]))

    if shards == 1:
        return scanned(docs.select(*dict.fromkeys([*kept, text])), kept, 0)
    row = fresh("row", [*docs.columns, n_words, spans, items])
    base = materialize(docs.select(*dict.fromkeys([*kept, text])).withColumn(row, F.expr("uuid()")), "decontaminate")
    hits = [scanned(base, [row], k) for k in range(shards)]
    merged = (reduce(DataFrame.unionByName, hits).groupBy(row)
              .agg(F.max(n_words).alias(n_words), F.flatten(F.collect_list(spans)).alias(spans),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))
              .withColumn(spans, merge_spans(spans)))
    return base.join(merged, row).select(*kept, n_words, spans, items)


def merge_spans(spans: str):
    """Union of the hit runs that several shards found in a document."""

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["word_start"].alias("word_start"),
                          F.greatest(last["word_end"], x["word_end"]).alias("word_end"),
                          last["char_start"].alias("char_start"),
                          F.greatest(last["char_end"], x["char_end"]).alias("char_end"))
        return F.when(last["word_end"] >= x["word_start"],
                      F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))
                      ).otherwise(F.concat(acc, F.array(x)))

    runs = F.array_sort(F.col(spans))
    return F.aggregate(runs, F.slice(runs, 1, 0), add)
