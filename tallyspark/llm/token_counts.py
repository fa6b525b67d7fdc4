"""Operator 4: token counts through a digest cache.

Rows are keyed by the digest of their normalised content - what the piece model's own
normaliser makes of a text, which is all that its count depends on; the text itself where
a tokenizer has no normaliser to ask - and by a digest of the
tokenizer (file bytes and library version). Counts that the cache holds are
joined; only distinct contents that it lacks are encoded, once each, and their
counts are appended to it. The cache is a Parquet folder, so a count survives
the session and a lost executor repeats only uncommitted tasks.

Null texts count as empty, repeated texts are encoded once, an empty table
gives an empty result. Extra columns of the input pass through.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.utils import AnalysisException

from ..session import scratch_path
from .common import collect_garbage, fresh, give_back, lean, tokenizer_path

_LOADED: dict[str, object] = {}
DIGEST_BYTES, BROADCAST_BYTES = 100, 64 << 20  # digests that are broadcast at most


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    h.update(f"{lib.__name__} {lib.__version__}".encode())
    return h.hexdigest()


def _counter(path: str):
    """texts -> counts, by the library of the file's kind; loaded once per worker."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece
            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer
            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _LOADED[path] = t
    t = _LOADED[path]
    if path.endswith(".model"):
        return lambda texts: [len(ids) for ids in t.encode(texts, num_threads=1)]
    return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def content_digests(path: str):
    """texts -> digests of their normalised content."""
    normalise = None
    if path.endswith(".model"):
        _counter(path)
        normalise = _LOADED[path].normalize

    def digest(t: str | None) -> str:
        t = t or ""
        return hashlib.sha256((normalise(t) if normalise and t else t).encode()).hexdigest()

    return lambda texts: [digest(t) for t in texts]


def _chunks(texts: list[str], limit: int = 1 << 20):
    """Runs of texts of about ``limit`` characters, so that the ids of few texts are held at once."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


CACHE = "digest string, n_tokens long, tokenizer string, run string"


def read_cache(spark, cache: str, version: str, run: str = "") -> DataFrame | None:
    """Counts stored for this tokenizer, one row per digest (two runs may have appended the same one), and whether some other
    run than ``run`` stored it."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException:  # nothing stored yet
        return None
    return (stored.filter(F.col("tokenizer") == version).groupBy("digest")
            .agg(F.max("n_tokens").alias("n_tokens"), F.bool_or(~F.col("run").eqNullSafe(run)).alias("known")))


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", cache: str | None = None,
                 out: str = "n_tokens", known: str | None = None) -> DataFrame:
    """``docs`` plus column ``out``: the number of tokens of ``text`` without added tokens; and ``known``, if named: whether the
    cache had the count before this call.

    ``tokenizer``: a file of the public tokenizers or a path that every
    executor has. ``cache``: the cache's folder; by default a new one.
    """
    spark = docs.sparkSession
    path = tokenizer_path(tokenizer)
    version, run = tokenizer_digest(path), uuid.uuid4().hex
    cache = cache or scratch_path(spark, "token-count-cache")
    key = fresh("digest", docs.columns)

    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        digests = content_digests(path)
        for texts in batches:
            yield pd.Series(digests(texts))
        give_back()

    if path.endswith(".model"):
        name = digest(F.col(text))
    else:  # no normaliser to ask
        name = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    keyed = docs.withColumn(key, name)

    texts = docs.select(name.alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    stored = read_cache(spark, cache, version)
    if stored is not None:
        stored = stored.select("digest")
        if stored.count() * DIGEST_BYTES <= BROADCAST_BYTES:  # known texts are not shuffled at all
            texts, stored = texts.join(F.broadcast(stored), "digest", "left_anti"), None
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct if stored is None else distinct.join(stored, "digest", "left_anti")

    def encode(batches):
        count = _counter(path)
        for b in batches:
            n = [c for run in _chunks(list(b["text"])) for c in count(run)]
            yield pd.DataFrame({"digest": b["digest"], "n_tokens": pd.Series(n, dtype="int64")})

    (misses.mapInPandas(lean(encode), "digest string, n_tokens long")
     .withColumn("tokenizer", F.lit(version)).withColumn("run", F.lit(run)).write.mode("append").parquet(cache))
    collect_garbage(spark)  # the shuffle of the texts is done with
    found = fresh("found", [*docs.columns, key])
    counts = read_cache(spark, cache, version, run).select(F.col("digest").alias(key), F.struct("n_tokens", "known").alias(found))
    joined = keyed.join(counts, key, "left")
    added = [F.col(f"{found}.n_tokens").alias(out)] + ([F.col(f"{found}.known").alias(known)] if known else [])
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (out, known)], *added)
