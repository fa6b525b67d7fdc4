"""Operator 6: toxicity by compression distance.

Separate Zstandard dictionaries are trained on toxic and on ordinary text.
Both stand before the same large ordinary dictionary, so that ordinary words
cost the same with either, and a window of words that compresses better with
the toxic one holds what toxic texts share. A document's statistics of these
differences go through a logistic calibration fitted on labelled documents
that no dictionary has seen.

Training reads a bounded sample of the labelled rows (``max_toxic`` and
``max_ordinary`` documents, the smallest by a hash of their id, as far as ``max_bytes`` of text hold them: one
that does not fit is passed over); dictionaries
and weights, whose size is a parameter, are broadcast. Scoring reads every
text whole. A null or empty text has no windows and gets the score of
statistics that are all zero. Rows with null labels are not trained on. With
no labelled document of one class every score is the share of toxic ones. Repeated rows
are scored alike; an empty table gives no rows; texts of any length are scored window by window.
"""

from __future__ import annotations

import random
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import fresh, schema_of, words

WINDOW = 16


@dataclass(frozen=True)
class Model:
    toxic: bytes  # contents of the two dictionaries, each with the ordinary one behind it
    ordinary: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept


def windows(text: str | None) -> list[bytes]:
    w = words(text)
    return [b" " + b" ".join(w[i:i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)]


def _content(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on samples: the part behind its entropy tables, which depend on too little here."""
    import zstandard as zstd
    total = sum(map(len, samples))
    if total <= size or len(samples) < 10:
        return b"".join(samples)[:size]
    try:
        d = zstd.train_dictionary(size, samples, k=48, d=6, f=20, accel=1).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:size]
    return d[min(1024, len(d) // 10):]


def _compressor(content: bytes):
    """Short matches and a plain search: windows are short, and only matches in the dictionary matter.

    The search gives up after a few candidates, nearest first, so the toxic
    part in front is reached for what the ordinary part behind it lacks.
    """
    import zstandard as zstd
    p = zstd.ZstdCompressionParameters(window_log=22, chain_log=18, hash_log=19, search_log=3, min_match=4,
                                       target_length=8, strategy=zstd.STRATEGY_GREEDY, write_content_size=False)
    if len(content) < 8:
        return zstd.ZstdCompressor(compression_params=p).compress
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstd.ZstdCompressor(dict_data=d, compression_params=p).compress


def statistics(text: str | None, toxic, ordinary) -> list[float]:
    """Statistics of how much shorter a document's windows are with the toxic dictionary than with the ordinary one."""
    ws = windows(text)
    if not ws:
        return [0.0] * 7
    d = np.array([len(ordinary(w)) - len(toxic(w)) for w in ws], float)
    top = np.sort(d)[::-1][:max(1, len(d) // 5)].mean()
    n = np.log1p(len(d))
    return [top, d.mean(), d.max(), (d >= 2).mean(), (d >= 4).mean(), n, top * n]


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a ridge on all weights but the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + keep, x.T @ (weight * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          max_toxic: int = 3000, max_ordinary: int = 6000, max_bytes: int = 64 << 20, **options) -> Model:
    """A model from a bounded sample of the documents that ``labels`` (columns ``key``, ``label``) covers.

    The sample is drawn from the labels; only its ids, so many at most, meet
    the documents, and the texts are read where they are. Their lengths are looked at before any text is fetched: at most
    ``max_bytes`` of text reach the driver, and of each class no more than half of that.
    """
    order = [F.xxhash64(F.col(key).cast("string")), F.col(key)]
    drawn = [labels.filter((F.col(label) == value) & F.col(key).isNotNull()).select(key, F.col(label).alias("_label"))
             .distinct().orderBy(*order).limit(most) for value, most in ((1, max_toxic), (0, max_ordinary))]
    found = docs.select(key, text).join(F.broadcast(drawn[0].unionByName(drawn[1])), key)
    sizes = found.groupBy(key, "_label").agg(F.sum(F.octet_length(text)).alias("size"), F.count("*").alias("n")).orderBy(*order)
    chosen, left, rows_left = [], {0: max_bytes // 2, 1: max_bytes // 2}, max_toxic + max_ordinary
    for r in sizes.collect():  # a few numbers for every drawn id
        if (r["size"] or 0) <= left[r["_label"]] and r["n"] <= rows_left:
            left[r["_label"]] -= r["size"] or 0
            rows_left -= r["n"]
            chosen.append((r[key], r["_label"]))
    ids = docs.sparkSession.createDataFrame(chosen, sizes.select(key, "_label").schema)
    rows = found.join(F.broadcast(ids), [key, "_label"], "left_semi").orderBy(*order, text).collect()
    return train_on([r[text] for r in rows if r["_label"] == 1], [r[text] for r in rows if r["_label"] == 0], **options)


def train_on(tox: list[str], plain: list[str], shared_bytes: int = 1 << 19, own_bytes: int = 1 << 16,
             max_windows: int = 100_000, ordinary_weight: float = 1.25, seed: int = 0) -> Model:
    """A model from toxic and ordinary texts; a third of them is set aside for the calibration.

    ``ordinary_weight``: of an ordinary text in the calibration; the sample holds more toxic texts than a corpus.
    """
    rng = random.Random(seed)

    def pick(texts):
        ws = [w for t in texts for w in windows(t)]
        rng.shuffle(ws)
        return ws[:max_windows]

    t, own, shared = tox[:len(tox) * 2 // 3], plain[:len(plain) // 4], plain[len(plain) // 4:len(plain) * 2 // 3]
    behind = _content(pick(shared), shared_bytes)
    toxic, other = pick(t), pick(own)
    n = min(len(toxic), len(other))  # as much text for one as for the other
    model = [_content(toxic[:n], own_bytes) + behind, _content(other[:n], own_bytes) + behind]
    held = [(x, 1.0) for x in tox[len(tox) * 2 // 3:]] + [(x, 0.0) for x in plain[len(plain) * 2 // 3:]]
    y = np.array([v for _, v in held])
    c = [_compressor(m) for m in model]
    x = np.array([statistics(s, *c) for s, _ in held]).reshape(len(held), 7)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        share = len(tox) / max(1, len(tox) + len(plain))
        odds = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Model(*model, np.zeros(7), np.ones(7), np.array([0.0] * 7 + [odds]))
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    return Model(*model, centre, scale, _fit((x - centre) / scale, y, np.where(y == 1, 1.0, ordinary_weight)))


_LOADED: dict = {}


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) plus the score of every text."""
    kept = docs.columns if keep is None else keep
    name = fresh(out, docs.columns)
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex  # of the model in a worker's memory

    def run(batches):
        import pyarrow as pa
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = _compressor(shipped.value.toxic), _compressor(shipped.value.ordinary)
        m, c = shipped.value, _LOADED[key]
        for b in batches:
            x = np.array([statistics(t, *c) for t in b.column(text).to_pylist()]).reshape(-1, 7)
            z = ((x - m.centre) / m.scale) @ m.weights[:-1] + m.weights[-1]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                             names=[*kept, name])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, ", ".join([*schema_of(docs, kept), f"{name} double"]))
