"""Operator 2: packing documents into sequences by a configuration linear program.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Only the histogram of piece lengths (at most ``capacity`` numbers, whatever
the corpus) reaches the driver. There, the configuration LP - how many
sequences of each combination of lengths - is solved by multiplicative
weights: every length has a price that grows while it is covered less than its
demand, and a knapsack dynamic program over the capacity finds the
combinations worth most at these prices. The LP's solution is a flow through
that program's states; rounding takes whole paths from the flow, and the
remainder is packed at the final prices, the last few pieces by best fit.

Pieces take their places by their rank among the pieces of their length. Ranks
come from counts per task and length, so no task ever holds a length's pieces
together, and the plan that maps ranks to places is bounded by the capacity.

Null texts are empty documents (one token: the end). Repeated rows are packed
as often as they occur, an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections import namedtuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Bounded, fresh, lean, materialize, schema_of, tokenizer_path

# -- tokenising ---------------------------------------------------------------------------------------------------

#: white space of the byte-level pre-tokeniser (fixed value: Unicode White_Space)
_SPACE = "\t-\r \x85\xa0  -     　"
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ˁ"
_ASCII_MARK = "!-/:-@\\[-`{-~"
#: Parts of a text between which the pre-tokeniser always cuts, so that they can be encoded one by one:
#: a run of letters before white space, an ASCII mark or the end; commas and stops before white space or the end;
#: any other run without white space; white space, without its last character if something follows.
_PART = re.compile(f" ?[{_LETTER}]+(?=[{_SPACE}{_ASCII_MARK}]|\\Z)| ?[.,]+(?=[{_SPACE}]|\\Z)| ?[^{_SPACE}]+"
                   f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _byte_letters() -> dict[int, str]:
    """The letter of every byte in a byte-level vocabulary: itself if it is visible in Latin-1, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


class _Blank(Exception):
    """What follows a space begins with white space, so both may belong to a run that began before them."""


class ByteLevelEncoder:
    """ids of texts by a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    Texts are cut where the pre-tokeniser always cuts, and each distinct part
    is encoded by the library once while it is in a cache of bounded size.
    Texts with a special token's string go to the library whole; so do all
    texts of a file that is not a plain byte-level BPE.
    """

    def __init__(self, path: str, cache_parts: int = 1_000_000):
        import json

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = (spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
                 and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.whole = re.compile("|".join(map(re.escape, special)) if plain and special else "" if not plain else r"(?!)")
        model, letters = self.tokenizer.model, _byte_letters()
        space, table = letters[ord(" ")], str.maketrans(letters)
        word = re.compile(f" ?[{_LETTER}]+")
        usual = re.compile(f"([{_LETTER}]+)([.,]*)")
        blank = re.compile(f"[{_SPACE}]")

        def packed(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        def run(p: str) -> bytes:  # a run of letters is one pre-token, so the model can take it at once
            return packed([t.id for t in model.tokenize(p)])

        def part(p: str) -> bytes:
            if word.fullmatch(p):
                return run(p.encode().decode("latin-1").translate(table))
            return packed(self.tokenizer.encode(p, add_special_tokens=False).ids)

        def chunk(c: str) -> bytes:
            m = usual.fullmatch(c)
            if not m:
                if blank.match(c):
                    raise _Blank
                return self._join(" " + c)
            w, marks = m.groups()
            if marks:
                return self.chunks[w] + self.parts[marks]
            return run(space + (c if c.isascii() else c.encode().decode("latin-1").translate(table)))

        self.parts = Bounded(part, cache_parts // 5)
        #: what stands between two spaces, with the first of them; most are a run of letters, with stops or commas or without
        self.chunks = Bounded(chunk, cache_parts)

    def _join(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PART.findall(text)))

    def __call__(self, text: str) -> bytes:
        if self.whole.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = text.split(" ")
        if "" in chunks:  # spaces in a row, at the begin or the end
            return self._join(text)
        try:
            return self._join(chunks[0]) + b"".join(map(self.chunks.__getitem__, chunks[1:]))
        except _Blank:
            return self._join(text)


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def tokenize_pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = 2048, end_id: int = 0,
                    keep: list[str] | None = None) -> DataFrame:
    """One row per piece: columns ``keep``, ``piece``, ``start``, ``length``, ``ids`` (little-endian 32-bit),
    ``task`` and ``rank``: the piece's number among the task's pieces of its length.

    Only documents longer than ``capacity`` are cut; their first piece takes
    what does not fill a whole one.
    """
    path = tokenizer_path(tokenizer)
    kept = docs.columns if keep is None else keep
    piece, start, length, ids, task, rank = names = [
        fresh(n, docs.columns) for n in ("piece", "start", "length", "ids", "task", "rank")]

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        if path not in _ENCODERS:
            _ENCODERS[path] = ByteLevelEncoder(path)
        encoder, end, this = _ENCODERS[path], struct.pack("<I", end_id), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            for lo, hi in _runs(texts):
                rows, owner = [], []
                for k in range(lo, hi):
                    data = encoder(texts[k]) + end
                    n = len(data) // 4
                    first = n % capacity or capacity
                    for j, a in enumerate([0, *range(first, n, capacity)]):
                        size = first if j == 0 else capacity
                        rows.append((j, a, size, data[4 * a:4 * (a + size)], int(seen[size])))
                        owner.append(k)
                        seen[size] += 1
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).take(pa.array(owner)) for c in kept]
                    + [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                       pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()),
                       pa.array([this] * len(rows), pa.int32()), pa.array(columns[4], pa.int64())],
                    names=[*kept, *names])

    schema = [*schema_of(docs, kept), f"{piece} int", f"{start} long", f"{length} long", f"{ids} binary",
              f"{task} int", f"{rank} long"]
    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(lean(encode), ", ".join(schema))


def _runs(texts: list[str], limit: int = 1 << 22):
    """Ranges of texts of about ``limit`` characters."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


# -- the configuration program ------------------------------------------------------------------------------------

def price_states(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack program: the best value within each capacity, and the length taken there (0: one unit is left empty).

    ``price[l]``: of a piece of length l, below 0 for lengths that are not wanted.
    """
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    want = np.flatnonzero(price > 0)
    worth = price[want]
    for c in range(1, capacity + 1):
        n = np.searchsorted(want, c, "right")
        best[c] = best[c - 1]
        if n:
            v = best[c - want[:n]] + worth[:n]
            k = int(v.argmax())
            if v[k] > best[c]:
                best[c], take[c] = v[k], want[k]
    return best, take


def path_of(take: np.ndarray, c: int) -> dict[int, int]:
    """Lengths and how often the program takes them from capacity ``c``."""
    out: dict[int, int] = {}
    while c > 0:
        k = int(take[c])
        if k:
            out[k] = out.get(k, 0) + 1
        c -= k or 1
    return out


def _answers(price: np.ndarray, demand: np.ndarray, capacity: int, sharp: float):
    """For every demanded length the best configuration that holds it, with weights that fall with its reduced cost,
    and the lower bound that the prices prove: the sum of demand times price, no configuration being worth more than 1."""
    have = np.flatnonzero(demand > 0)
    best, take = price_states(np.where(demand > 0, price, -1.0), capacity)
    value = (price[have] + best[capacity - have]) / best[capacity]
    weight = demand[have] * price[have] * np.exp((value - 1) * sharp)
    found = []
    for k, w in zip(have, weight):
        if w > 1e-12 * weight.max():
            c = path_of(take, capacity - int(k))
            c[int(k)] = c.get(int(k), 0) + 1
            found.append((c, float(w)))
    return found, float((demand[have] * price[have]).sum() / best[capacity])


def learn_prices(demand: np.ndarray, capacity: int, rounds: int) -> tuple[np.ndarray, float]:
    """Multiplicative weights on the dual of the configuration LP: the prices that prove the largest bound, and it.

    A length's price grows by a factor while the answers to the prices cover
    less than its demand and shrinks while they cover more; the factors and the
    softness of the answers go down with the rounds. The first prices are the
    best of some that fit large pieces: the length itself, but all of a sequence
    for what leaves no room for a piece of k, and nothing for less than k.
    """
    length = np.arange(capacity + 1)
    starts = [np.where(length > capacity - k, 1.0, np.where(length >= k, length / capacity, 0.0))
              for k in [0, *(capacity * j // 32 for j in range(1, 17))]]
    starts.append(np.where(2 * length > capacity, 1.0, np.where(2 * length == capacity, 0.5, 0.0)))
    proofs = [_answers(s, demand, capacity, 20)[1] if (s * demand).any() else 0.0 for s in starts]
    price = starts[int(np.argmax(proofs))] + 1e-6 * length / capacity
    top, bound = price.copy(), 0.0
    for r in range(rounds):
        found, proved = _answers(price, demand, capacity, 20 * 1.25 ** r)
        if proved > bound:
            bound, top = proved, price.copy()
        cover = np.zeros(capacity + 1)
        amount = proved / sum(w for _, w in found)
        for c, w in found:
            for k, n in c.items():
                cover[k] += n * w * amount
        have = np.flatnonzero(demand > 0)
        price[have] *= np.exp(0.25 * 0.9 ** r * np.clip(1 - cover[have] / demand[have], -1, 1))
    return top, bound


def plan_bins(demand: np.ndarray, capacity: int, rounds: int = 40, share: float = 0.08):
    """Whole sequences for ``demand[l]`` pieces of each length: ``[(configuration, how many)]`` and the lower bound.

    At the learnt prices, each round takes ``share`` of what is left: the LP's
    amounts of near-optimal configurations, rounded; weights on the lengths
    that lag behind decide between configurations of equal worth. What the
    rounding leaves is packed by best fit, and the round after which the two
    together need the fewest sequences is where the rounding stops. Work
    depends on the capacity, not on the number of pieces.
    """
    left = demand.astype(np.int64).copy()
    bins: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        bins.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    if not left.any():
        return bins, int(demand[capacity])
    need = np.maximum(left, 1).astype(float)
    price, bound = learn_prices(left.astype(float), capacity, rounds)
    count, best = int(demand[capacity]), None
    for _ in range(rounds):
        lag = left / need
        mean = left.sum() / need[left > 0].sum()
        now = price * (1 + np.tanh(8 * (lag - mean)) / (4 * capacity))
        found, worth = _answers(now, left, capacity, 8.0 * capacity)
        amount = share * worth / sum(w for _, w in found)
        placed = 0
        for config, w in sorted(found, key=lambda x: -x[1]):
            times = min([int(w * amount + 0.5), *(int(left[k]) // n for k, n in config.items())])
            if times > 0:
                for k, n in config.items():
                    left[k] -= n * times
                bins.append((config, times))
                placed += times
        count += placed
        rest = best_fit(left, capacity)
        total = count + sum(t for _, t in rest)
        if best is None or total < best[0]:
            best = total, len(bins), rest
        if not placed or not left.any() or total > best[0] * 1.02:
            break
    return bins[:best[1]] + best[2], int(demand[capacity] + np.ceil(bound - 1e-6))


def best_fit(demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on counts: equal sequences are filled together, so the work does not grow with them."""
    rooms: dict[int, list[list]] = {capacity: []}
    for k in np.flatnonzero(demand)[::-1].tolist():
        n = int(demand[k])
        for room in sorted(r for r in rooms if r >= k):
            groups = rooms[room]
            while groups and n:
                config, times = groups.pop()
                per = min(room // k, n)
                use = min(times, n // per)
                if use < times:
                    groups.append([config, times - use])
                rooms.setdefault(room - per * k, []).append([{**config, k: per}, use])
                n -= per * use
            if not n:
                break
        while n:
            per = min(capacity // k, n)
            use = n // per
            rooms.setdefault(capacity - per * k, []).append([{k: per}, use])
            n -= per * use
    return [(c, t) for groups in rooms.values() for c, t in groups]


Places = namedtuple("Places", "start first per at")


def places_by_length(bins, capacity: int) -> dict[int, Places]:
    """For each length, arrays by rank: from which rank on, the first sequence, pieces per sequence, offset there."""
    rows: dict[int, list] = {}
    given = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for config, times in bins:
        at = 0
        for k, n in sorted(config.items(), reverse=True):
            rows.setdefault(k, []).append((int(given[k]), sequence, n, at))
            given[k] += n * times
            at += k * n
        sequence += times
    return {k: Places(*(np.array(x, np.int64) for x in zip(*v))) for k, v in rows.items()}


# -- the operator -------------------------------------------------------------------------------------------------

def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = 2048, end_id: int = 0,
         keep: list[str] | None = None, derive: dict[str, Column] | None = None, rounds: int = 40) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset``.

    Columns: ``keep`` (all of ``docs`` by default), ``piece``, ``start``,
    ``length``, ``sequence_id``, ``offset``, and ``ids``, or instead of it the
    columns ``derive`` computed from it where the ids are made.
    """
    spark = docs.sparkSession
    pieces = tokenize_pieces(docs, tokenizer, text, capacity, end_id, keep)
    kept = docs.columns if keep is None else keep
    piece, start, length, ids, task, rank = pieces.columns[len(kept):]
    more = {ids: F.col(ids)} if derive is None else derive
    pieces = materialize(pieces.select(*kept, piece, start, length, task, rank,
                                       *(c.alias(n) for n, c in more.items())), "pieces")
    counts = pieces.groupBy(task, length).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(length).orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.withColumn("_before", F.coalesce(before, F.lit(0))), "piece-ranks")
    demand = np.zeros(capacity + 1, np.int64)
    for k, n in counts.groupBy(length).agg(F.sum("_n")).collect():  # at most one row per length
        demand[k] = n
    bins, _ = plan_bins(demand, capacity, rounds)
    places = spark.sparkContext.broadcast(places_by_length(bins, capacity))  # bounded by the capacity
    seq, off = fresh("sequence_id", pieces.columns), fresh("offset", pieces.columns)
    ranked = pieces.join(counts.drop("_n"), [task, length]).withColumn(rank, F.col(rank) + F.col("_before"))
    out = [*kept, piece, start, length, *more]

    def place(batches):
        import pyarrow as pa
        for b in batches:
            size, r = (np.asarray(b.column(c)) for c in (length, rank))
            sequence, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if not len(part):
                    continue
                k = int(size[part[0]])
                p = places.value[k]
                j = np.searchsorted(p.start, r[part], "right") - 1
                nth = r[part] - p.start[j]
                sequence[part] = p.first[j] + nth // p.per[j]
                at[part] = p.at[j] + nth % p.per[j] * k
            yield pa.RecordBatch.from_arrays([b.column(c) for c in out] + [pa.array(sequence), pa.array(at)],
                                             names=[*out, seq, off])

    return ranked.select(*out, rank).mapInArrow(lean(place), ", ".join([*schema_of(ranked, out), f"{seq} long", f"{off} long"]))


def sequences(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``n_tokens`` and ``ids`` joined in order (at most ``capacity``)."""
    s = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (packed.groupBy("sequence_id").agg(s.alias("s"))
            .select("sequence_id", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
                    F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))
