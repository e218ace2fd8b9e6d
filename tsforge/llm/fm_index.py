"""A bidirectional FM-index over a delimited vocabulary, and the search scheme for one error, in numpy.

The text is ``$w0$w1...$wk``, read as a circle, of sorted distinct words. Suffixes are compared up to their next
``$``; delimiters are ordered by the word behind them, so the row of ``$wi...`` is i. A match is a pair of intervals of
equal size: the suffix ranks of the pattern in the text and of its mirror image in the mirrored text. Adding a symbol on
either side narrows the interval of that side by its wavelet matrix and moves the other by the count of smaller
symbols there, so both stay in step. All queries of a batch move together, one symbol at a time.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Ranks of symbols in the last column of a sorted circle, and of all symbols smaller than one."""

    def __init__(self, last: np.ndarray, sigma: int):
        self.levels = []
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(last, minlength=sigma), out=self.first[1:])
        now = last
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (now >> bit) & 1
            rank = np.zeros(len(now) + 1, np.int32)
            np.cumsum(ones, out=rank[1:])
            self.levels.append((bit, rank, len(now) - int(rank[-1])))
            now = np.concatenate([now[ones == 0], now[ones == 1]])
        place = np.zeros(sigma, np.int64)  # where a symbol's rows begin in the matrix's last order
        head = np.flatnonzero(np.append(True, now[1:] != now[:-1])) if len(now) else np.zeros(0, np.int64)
        place[now[head]] = head
        self.shift = self.first[:-1] - place

    def add(self, lo, size, symbol):
        """(lo, size, smaller) of each interval with its ``symbol`` added."""
        left, right, smaller = lo, lo + size, np.zeros(len(lo), np.int64)
        for bit, rank, zeros in self.levels:
            a, b = rank[left].astype(np.int64), rank[right].astype(np.int64)
            one = (symbol >> bit) & 1 == 1
            smaller += np.where(one, (right - b) - (left - a), 0)
            left, right = np.where(one, zeros + a, left - a), np.where(one, zeros + b, right - b)
        return left + self.shift[symbol], right - left, smaller

    def add_any(self, lo, size):
        """(interval, symbol, lo, size, smaller) of every symbol that occurs next to each interval."""
        which, symbol = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        left, right, smaller = lo, lo + size, np.zeros(len(lo), np.int64)
        for bit, rank, zeros in self.levels:
            a, b = rank[left].astype(np.int64), rank[right].astype(np.int64)
            none = (right - b) - (left - a)
            z, o = np.flatnonzero(none > 0), np.flatnonzero(b > a)
            smaller = np.concatenate([smaller[z], smaller[o] + none[o]])
            which, symbol = np.concatenate([which[z], which[o]]), np.concatenate([symbol[z], symbol[o] | 1 << bit])
            left, right = np.concatenate([(left - a)[z], (zeros + a)[o]]), np.concatenate([(right - b)[z], (zeros + b)[o]])
        return which, symbol, left + self.shift[symbol], right - left, smaller


def _sorted_circle(text: np.ndarray, delimiter_rank: np.ndarray) -> np.ndarray:
    """Start positions in order; delimiters (0) rank by ``delimiter_rank``, so no comparison goes past one."""
    n = len(text)
    rank = text.astype(np.int64) + len(delimiter_rank)
    rank[text == 0] = delimiter_rank
    width = 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        width *= 2


class Index:
    """``words``: sorted, distinct, not empty, as arrays of code points in one array cut at ``bounds``."""

    def __init__(self, points: np.ndarray, bounds: np.ndarray):
        k = len(bounds) - 1
        self.alphabet, symbol = np.unique(points, return_inverse=True)
        sigma = len(self.alphabet) + 1
        n = len(points) + k
        self.start = bounds[:-1] + np.arange(k) + 1  # first symbol of each word in the text
        self.length = np.diff(bounds)
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.start - 1] = False
        text[inside] = symbol + 1
        self.text, self.size = text, n
        order = _sorted_circle(text, np.arange(k))
        self.before = Wavelet(text[order - 1], sigma)  # symbols added on the left
        # the mirrored text: behind a word's delimiter comes the word before it, last letter first
        mirror = text[::-1]
        ends_with = self._mirrored_order(k)
        marks = np.roll(ends_with, 1)[::-1]
        order = _sorted_circle(mirror, marks)
        self.behind = Wavelet(mirror[order - 1], sigma)  # symbols added on the right

    def _mirrored_order(self, k: int) -> np.ndarray:
        """The rank of each word among all words read backwards."""
        raw = self.text.astype("<u4")
        keys = [raw[s:s + n][::-1].astype(">u4").tobytes() for s, n in zip(self.start.tolist(), self.length.tolist(), strict=True)]
        rank = np.empty(k, np.int64)
        rank[np.array(sorted(range(k), key=keys.__getitem__), np.int64)] = np.arange(k)
        return rank

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Code points as symbols; -1 where the vocabulary has none."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1)

    def one_error_behind(self, queries: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (query, word) pairs: words that begin with a query's first ``exact`` symbols and differ from it by one
        inserted, deleted or replaced symbol behind them. ``queries`` has a row of symbols for each query, all of one length."""
        m, length = queries.shape
        who = np.arange(m)
        lo, size, mirrored = np.zeros(m, np.int64), np.full(m, self.size, np.int64), np.zeros(m, np.int64)
        for step in range(exact, -1, -1):  # the exact part leftwards, then its delimiter
            symbol = queries[who, step - 1] if step else np.zeros(len(who), np.int64)
            keep = symbol >= 0
            who, lo, size, mirrored, symbol = (x[keep] for x in (who, lo, size, mirrored, symbol))
            lo, size, smaller = self.before.add(lo, size, symbol)
            mirrored = mirrored + smaller
            keep = size > 0
            who, lo, size, mirrored = (x[keep] for x in (who, lo, size, mirrored))
        clean = (who, mirrored, size, lo)  # no error yet
        none = tuple(x[:0] for x in clean)
        wrong, late = none, []  # one error; and those that wait for the next position
        for step in range(exact, length + 1):
            which, symbol, to, count, smaller = self.behind.add_any(clean[1], clean[2])
            more = (clean[0][which], to, count, clean[3][which] + smaller)
            real = symbol > 0
            inserted = tuple(x[real] for x in more)
            wrong = tuple(np.concatenate(x) for x in zip(wrong, *late, inserted, strict=True))
            if step == length:
                break
            wanted = queries[:, step]
            same = symbol == wanted[more[0]]
            replaced = tuple(x[real & ~same] for x in more)
            late = [replaced, clean]  # a symbol of the query replaced, or missing in the word
            clean = tuple(x[same] for x in more)
            wrong = self._go_on(wrong, wanted[wrong[0]])
        who, _, _, row = self._go_on(wrong, np.zeros(len(wrong[0]), np.int64))
        pairs = np.unique(who * len(self.length) + row)
        return pairs // len(self.length), pairs % len(self.length)

    def _go_on(self, state, symbol):
        keep = symbol >= 0
        who, mirrored, size, lo = (x[keep] for x in state)
        mirrored, size, smaller = self.behind.add(mirrored, size, symbol[keep])
        keep = size > 0
        return who[keep], mirrored[keep], size[keep], (lo + smaller)[keep]

    def ends_alike(self, queries: np.ndarray, who: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """Whether the last ``n`` symbols of each query and of the word paired with it are the same."""
        end = self.start[word] + self.length[word]
        same = self.length[word] >= n
        for k in range(1, n + 1):
            left = np.flatnonzero(same)
            same[left] = self.text[end[left] - k] == queries[who[left], queries.shape[1] - k]
        return same
