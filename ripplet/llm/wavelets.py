"""Words that share a prefix and a suffix, by range reporting on a wavelet tree; numpy inside one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class WaveletTree:
    """The points (place, value) of a permutation, as one row of bits for each binary digit of the values, highest first.
    At each level the values with a 0 come before those with a 1, in their order; ranks of zeros lead from level to level."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.levels = max(1, int(self.n - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        now = values.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all points with left <= place < right and low <= value < high, for many queries at once. A
        node of the tree is left as soon as no point of it or no value of the range is in it."""
        query, node = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level in range(self.levels):
            zeros, width = self.zeros[level], 1 << (self.levels - 1 - level)
            ones, a, b = zeros[-1], zeros[left], zeros[right]
            query = np.concatenate([query, query])
            node = np.concatenate([node, node + width])
            left, right = np.concatenate([a, ones + left - a]), np.concatenate([b, ones + right - b])
            open_ = (left < right) & (node < high[query]) & (node + width > low[query])
            query, node, left, right = query[open_], node[open_], left[open_], right[open_]
        return query, node


def _shared(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows, and how many columns each row in that order shares with the one before it."""
    order = np.argsort(np.ascontiguousarray(codes.astype(">u4")).view(f"V{4 * codes.shape[1]}").ravel().view(f"S{4 * codes.shape[1]}"), kind="stable")
    rows = codes[order]
    same = np.ones((len(rows), codes.shape[1]), bool)
    same[0] = False
    same[1:] = rows[1:] == rows[:-1]
    return order, np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _span(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an order, the span of rows about it that share `depth` columns with it."""
    cut = np.flatnonzero(shared < depth)
    at = np.searchsorted(cut, np.arange(len(shared)), "right") - 1
    return cut[at], np.append(cut[1:], len(shared))[at]


class Context:
    """Words (as rows of code points, padded with 0) of several groups, in forward and in reverse order: the points
    (forward place, reverse place) stand in a wavelet tree."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> None:
        width = codes.shape[1]
        at = lengths[:, None] - 1 - np.arange(width)[None, :]
        mirror = np.where(at >= 0, np.take_along_axis(codes, np.maximum(at, 0), 1), 0)
        # Rows are padded with 0, which no word holds, and so are ordered as their words are.
        head = (group + 1)[:, None].astype(np.uint32)
        self.order, self.ahead = _shared(np.hstack([head, codes]))
        self.back, self.behind = _shared(np.hstack([head, mirror]))
        self.place, self.mirrored = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        self.place[self.order] = np.arange(len(group))
        self.mirrored[self.back] = np.arange(len(group))
        self.tree = WaveletTree(self.mirrored[self.order])
        self.spans: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray]] = {}

    def _of(self, forward: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
        if (forward, depth) not in self.spans:
            self.spans[forward, depth] = _span(self.ahead if forward else self.behind, depth + 1)
        return self.spans[forward, depth]

    def sharing(self, rows: np.ndarray, prefix: int, suffix: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, other): all other words of a row's group that share so many first and last code points with it."""
        f, r = self.place[rows], self.mirrored[rows]
        (a, b), (c, d) = ([x[at] for x in self._of(way, n)] for way, n, at in ((True, prefix, f), (False, suffix, r)))
        some = np.flatnonzero((b - a > 1) & (d - c > 1))
        query, value = self.tree.report(a[some], b[some], c[some], d[some])
        row, other = rows[some[query]], self.back[value]
        return row[row != other], other[row != other]


def near(group: np.ndarray, words: list[str], short: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, other) of one group whose words differ by exactly one replaced code point, both ways, or by one code point
    that other has more. short: a group's shorter words, those for which edits are tried; all others are one longer."""
    lengths = np.array([len(w) for w in words])
    width = max(1, int(lengths.max(initial=0)))
    codes = np.array(words, f"<U{width}").view("<u4").reshape(len(words), width)
    for more in (0, 1):
        rows = np.flatnonzero(short) if not more else np.arange(len(words))
        if not len(rows):
            continue
        held = Context(group[rows], codes[rows], lengths[rows])
        own = np.flatnonzero(short[rows])
        long = lengths[rows][own]
        for n in np.unique(long):
            these = own[long == n]
            for at in range(n + more):
                a, b = held.sharing(these, at, n - at - 1 + more)
                fits = lengths[rows[b]] == lengths[rows[a]] + more
                yield rows[a[fits]], rows[b[fits]]
