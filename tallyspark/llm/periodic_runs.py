"""Operator 11: periodic runs of words, by descending-LCP Kruskal over suffix classes.

A run of a text is a stretch of consecutive words with smallest period q (words q
apart are the same) and at least ``min_length`` and 2 * q words that no neighbouring
word extends. Two positions i < j of a text belong to one class of level l when their
suffixes share l words. Going down from the largest shared length (LCP), the classes
are united as Kruskal's algorithm unites trees: the links are the neighbours in suffix order,
a union-find structure knows the classes, and each class keeps its positions in order.
When two classes meet at level l, positions that become neighbours share exactly
l words. At a distance d <= l they seed the run with period d that ends at j + l; it
begins at i if the words before i and j differ. Each run is seeded by its first position and
the one a period later: nothing of their class stands between them, since it would give a shorter period.

A run of smallest period q has such a pair with l >= max(min_length - q, q), so levels
below half of ``min_length`` seed nothing and are left out; texts in which no ``min_length / 2``
words occur twice end there. Texts are rows: no shuffle, and a task holds
a batch of texts of about ``batch_words`` words, or one longer text.

Words are compared as they are. Null and empty texts have no words, no runs and an empty collapsed text.
Ties: runs that share a start are told apart by their period. Repeated rows are judged each by itself; an empty
table gives no rows; columns of other names that clash with inner ones do not matter.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import fresh, lean, schema_of

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
RUNS = "array<struct<start: long, length: long, period: long>>"


def _repeated(ids: np.ndarray, width: int) -> np.ndarray:
    """Where ``width`` words stand that also stand elsewhere (and perhaps some more places: by hash)."""
    if len(ids) < width:
        return np.zeros(0, np.int64)
    m = len(ids) - width + 1
    h = np.zeros(m, np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(29))) * _A + ids[k:k + m].astype(np.uint64) * _B
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(m, bool)
    hit[order[1:]] = same
    hit[order[:-1]] |= same
    return np.flatnonzero(hit)


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``ids`` by doubling, and the LCP of every suffix with the one before it."""
    n = len(ids)
    _, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse].astype(np.int32)  # the first place of the suffixes that are alike so far
    ranks, k = [rank], 1
    while len(active := np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)):
        after = active + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1).astype(np.int64)
        key = rank[active].astype(np.int64) * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        first = np.ones(len(active), bool)
        first[1:] = rank[active[1:]] != rank[active[:-1]]
        place = np.arange(len(active))
        slot = rank[active] + place - np.maximum.accumulate(np.where(first, place, 0))
        head = np.ones(len(active), bool)
        head[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(head, slot, 0))
        ranks.append(rank)
        k *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    i, j = sa[:-1].copy(), sa[1:].copy()
    for r in reversed(ranks):
        k = 1 << (len(ranks) - 1)
        ranks.pop()
        same = np.flatnonzero((i < n) & (j < n))
        same = same[r[i[same]] == r[j[same]]]
        lcp[1:][same] += k
        i[same] += k
        j[same] += k
    return sa, lcp


def _seeds(x: list[int], y: list[int], level: list[int]) -> tuple[list, list, list]:
    """Unite the classes of x[k] and y[k] at ``level`` (descending); (i, d, l) of new neighbours i, i + d with d <= l."""
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}  # of classes of two and more, in order
    starts, distances, lengths = [], [], []

    def find(a):
        root = a
        while (up := parent.get(root, root)) != root:
            root = up
        while a != root:
            parent[a], a = root, parent.get(a, a)
        return root

    def seed(i, j, lv):
        if j - i <= lv:
            starts.append(i)
            distances.append(j - i)
            lengths.append(lv)

    for a, b, lv in zip(x, y, level):
        a, b = find(a), find(b)
        large, small = members.get(a) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
            members.pop(b, None)
        parent[b] = a
        if len(small) * 64 > len(large) > 256:  # one merge instead of many insertions
            both, inside = sorted(large + small), set(small)
            for i, j in zip(both, both[1:]):
                if (i in inside) != (j in inside):
                    seed(i, j, lv)
            large = both
        else:
            last = -1
            for p in small:
                k = bisect_left(large, p)
                if k and large[k - 1] != last:
                    seed(large[k - 1], p, lv)
                if k < len(large):
                    seed(p, large[k], lv)
                if k == len(large):
                    large.append(p)
                else:
                    insort(large, p, k, k)
                last = p
        members[a] = large
    return starts, distances, lengths


def find_in(ids: np.ndarray, min_length: int) -> np.ndarray:
    """Rows (start, end, period) of the runs of ``ids``, by start, then period."""
    sa, lcp = suffix_order(ids)
    at = np.flatnonzero(lcp >= -(-min_length // 2))
    at = at[np.argsort(-lcp[at], kind="stable")]
    s, d, lv = (np.array(v, np.int64) for v in _seeds(sa[at - 1].tolist(), sa[at].tolist(), lcp[at].tolist()))
    first = (s == 0) | (ids[s - 1] != ids[s + d - 1])  # nothing before it has the period
    s, d, e = s[first], d[first], (s + d + lv)[first]
    long = e - s >= min_length
    s, d, e = s[long], d[long], e[long]
    order = np.lexsort((d, e, s))
    s, d, e = s[order], d[order], e[order]
    least = np.ones(len(s), bool)  # the same stretch with a multiple of its period
    least[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, d, e = s[least], d[least], e[least]
    order = np.lexsort((d, s))
    return np.stack([s, e, d], 1)[order]


class _Numbers(dict):
    def __init__(self, first):
        super().__init__()
        self.first = first

    def __missing__(self, word):
        n = self[word] = self.first + len(self)
        return n


def runs_of(texts: list[str | None], min_length: int) -> list[tuple[list[bytes], np.ndarray]]:
    """Per text its words and its runs; texts are searched together, with word numbers of their own."""
    words, ids, used = [], [], 0
    for t in texts:
        w = t.encode().split() if t else []  # bytes.split: between ASCII white space
        numbers = _Numbers(used)
        words.append(w)
        ids.append(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)))
        used += len(numbers)
    sizes = np.array([len(w) for w in words], np.int64)
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(words)
    if sizes.sum():
        text = np.repeat(np.arange(len(words)), sizes)
        searched = np.unique(text[_repeated(np.concatenate(ids), -(-min_length // 2))]).tolist()
        if searched:
            found = find_in(np.concatenate([ids[k] for k in searched]), min_length)
            starts = np.concatenate([[0], np.cumsum(sizes[searched])])
            at = np.searchsorted(found[:, 0], starts)
            for k, a, z, start in zip(searched, at, at[1:], starts):
                out[k] = found[a:z] - [start, start, 0]
    return list(zip(words, out))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, min_length: int = 12,
              batch_words: int = 1 << 17) -> DataFrame:
    """``keep`` (by default all columns), ``n_words``, ``runs`` by start and period, and ``collapsed``: the words without those that
    a run holds after its first period."""
    if min_length < 2:
        raise ValueError("min_length must be at least 2")
    keep = docs.columns if keep is None else keep
    names = []
    for c in ("n_words", "runs", "collapsed"):
        names.append(fresh(c, [*keep, *names]))
    body = fresh("body", keep)

    def search(batches):
        import pyarrow as pa
        runs_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for b in batches:
            texts = b.column(body).to_pylist()
            sizes = np.cumsum([len(t or "") // 6 for t in texts])  # about six characters a word
            cuts = np.unique(np.searchsorted(sizes, np.arange(0, sizes[-1] + batch_words, batch_words))) if len(texts) else []
            for a, z in zip(cuts, [*cuts[1:], len(texts)]):
                if a == z:
                    continue
                found = runs_of(texts[a:z], min_length)
                rows = [[{"start": s, "length": e - s, "period": p} for s, e, p in r.tolist()] for _, r in found]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(a, z - a) for c in keep), pa.array([len(w) for w, _ in found], pa.int64()),
                     pa.array(rows, runs_type), pa.array([collapsed(w, r) for w, r in found], pa.binary()).cast(pa.string())],
                    names=[*keep, *names])

    schema = [*schema_of(docs, keep), f"`{names[0]}` long", f"`{names[1]}` {RUNS}", f"`{names[2]}` string"]
    return docs.select(*keep, F.col(text).alias(body)).mapInArrow(lean(search), ", ".join(schema))
