"""A run-length index over a collection of byte strings, and the matching statistics it gives.

The strings' suffixes are sorted by prefix doubling. Where the byte before a
suffix differs from the byte before its neighbour, a run of the Burrows-Wheeler
transform ends; only there, the place of the suffix and the length of its match
with the neighbour are sampled. Everywhere else a match is one byte shorter
than the match of the suffix one byte before, so the lengths of all matches
are streamed from the samples in text order.
"""

from __future__ import annotations

import numpy as np

FIRST = 7  # bytes of the first keys; the eighth byte tells how many are left, up to one more


def _words(data: bytes) -> np.ndarray:
    """The eight bytes from every position on as little-endian numbers (zeros follow the end)."""
    padded = data + bytes(8)
    return np.ndarray((len(data),), "<u8", padded, 0, (1,)).astype(np.uint64)


def suffix_order(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions in the order of what follows them up to the end of their string; equal ones in order of position."""
    n = len(words)
    key = words.byteswap()
    short = np.minimum(left, FIRST)
    key &= ~((np.uint64(1) << ((np.uint64(8) - short.astype(np.uint64)) * np.uint64(8))) - np.uint64(1))
    key |= np.minimum(left, FIRST + 1).astype(np.uint64)
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = FIRST
    todo = _unresolved(order, new, left, size)
    while len(todo):
        at = todo + size
        inside = left[todo] > size
        follow = np.zeros(len(todo), np.int64)
        follow[inside] = rank[at[inside]] + 1
        old = rank[todo]
        key = (old << 32) | follow
        by = np.argsort(key)
        todo, key, old = todo[by], key[by], old[by]
        place = np.arange(len(todo))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.concatenate(([True], old[1:] != old[:-1]))
        rank[todo] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        size *= 2
        todo = _unresolved(todo, new, left, size)
    return np.argsort(rank, kind="stable")


def _unresolved(order, new, left, size):
    """Of positions in order, those that equal a neighbour so far and have more to compare."""
    alone = new & np.concatenate((new[1:], [True]))
    rest = order[~alone]
    return rest[left[rest] > size]


def match_lengths(words: np.ndarray, left: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the suffixes at p and q, within their strings."""
    most = np.minimum(left[p], left[q]).astype(np.int64)
    length = np.zeros(len(p), np.int64)
    at = np.flatnonzero(most > 0)
    done = 0
    while len(at):
        x = words[p[at] + done] ^ words[q[at] + done]
        same = x == 0
        low = x[~same] & (~x[~same] + np.uint64(1))  # the lowest bit that differs lies in the first byte that differs
        length[at[~same]] = done + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
        length[at[same]] = done + 8
        done += 8
        at = at[same]
        at = at[most[at] > done]
    return np.minimum(length, most)


class RunIndex:
    """Samples at the run ends of the Burrows-Wheeler transform of ``strings``."""

    def __init__(self, strings: list[bytes]):
        data = b"".join(strings)
        sizes = np.array([len(s) for s in strings], np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.size = n = len(data)
        if not n:
            return
        left = np.repeat(self.start[1:], sizes) - np.arange(n)
        words = _words(data)
        order = suffix_order(words, left)
        before = np.empty(n, np.int16)
        before[1:] = np.frombuffer(data, np.uint8)[:-1]
        before[self.start[:-1][sizes > 0]] = -1  # nothing: every string begins a run
        b = before[order]
        ends = np.flatnonzero((b[1:] != b[:-1]) | (b[1:] < 0) | (b[:-1] < 0)) + 1
        self.runs = len(ends) + 1
        length = match_lengths(words, left, order[ends], order[ends - 1])
        #: text positions of the first and last suffix of each run, and their matches with the run before and after
        self.head, self.head_match = np.append(order[ends], order[:1]), np.append(length, 0)
        self.tail, self.tail_match = np.append(order[ends - 1], order[-1:]), np.append(length, 0)

    def _stream(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        last = np.zeros(self.size, np.int64)
        match = np.zeros(self.size, np.int64)
        last[places], match[places] = places, values
        last = np.maximum.accumulate(last)
        return match[last] + last - np.arange(self.size)

    def statistics(self) -> np.ndarray:
        """For every position, the length of its longest match that starts at another position."""
        if not self.size:
            return np.zeros(0, np.int64)
        return np.maximum(self._stream(self.head, self.head_match), self._stream(self.tail, self.tail_match))
