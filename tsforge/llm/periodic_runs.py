"""Runs of words that repeat with a period, by a dictionary of basic factors.

The basic factors of a text are its stretches of 1, 2, 4, 8 ... words. Equal factors of a length share a
name; the names of one length are the names of neighbouring pairs of the length before. Occurrences of a factor
that follow each other within twice its length form arithmetic progressions whose difference is a period of the
words between them. A run of period q is looked for at the least power of two k >= q: there each factor's next
occurrence is exactly q words on, since no closer one can exist in a run whose smallest period is q. Progressions
with the same difference that start at neighbouring words belong to one run; joining them extends it word by
word to both of its ends, and it arises once, at one k.

A factor that occurs once in its document is in no progression, nor is any longer factor that holds it: such words
leave the dictionary, so ordinary text costs a few short sorts. All texts of a slab are worked on together, no row
leaves its task, and nothing is shuffled: memory follows the longest text.

Words are compared by 64-bit hashes. Results in every case: null, empty and blank texts have no words and no runs;
copies, rows that share an id and ties are each treated alone; rows without an id are left out; an empty table gives
an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tsforge.llm.substring_dedup import word_codes
from tsforge.llm.tables import id_and_text, tidy
from tsforge.llm.textcodes import slabs

#: A run has at least this many words and this many periods. The method needs three periods or more.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, names): the stable order by key, and each item's name - equal for equal keys."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(new) - 1
    return order, names


def find_runs(codes: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS,
              least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs, by start, then period; texts lie between ``bounds`` of ``codes``."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    last = bounds[1:][doc] if len(doc) else doc
    at, keys, width = np.arange(len(codes)), codes, 1
    found = []
    while len(at):
        order, names = named(keys)
        place = at[order]
        follows = (names[order[1:]] == names[order[:-1]]) & (doc[place[1:]] == doc[place[:-1]])
        gap = np.zeros(len(at), np.int64)  # to the next occurrence in the same text
        gap[order[:-1]] = np.where(follows, place[1:] - place[:-1], 0)
        near = np.flatnonzero((gap > width // 2) & (gap <= width))
        if len(near):
            head, step = at[near], gap[near]
            new = np.ones(len(near), bool)
            new[1:] = (head[1:] != head[:-1] + 1) | (step[1:] != step[:-1])
            first = np.flatnonzero(new)
            final = np.append(first[1:], len(near)) - 1
            start, period = head[first], step[first]
            length = head[final] + period + width - start
            good = (length >= least_words) & (length >= least_periods * period)
            found.append((start[good], length[good], period[good]))
        # longer factors: pairs of neighbours that both occur again in their text
        again = np.zeros(len(at), bool)
        again[order[:-1]] |= follows
        again[order[1:]] |= follows
        at, names = at[again], names[again]
        after = np.searchsorted(at, at + width)
        after[after == len(at)] = 0
        pair = np.flatnonzero((at[after] == at + width) & (at + 2 * width <= last[at])) if len(at) else at
        keys = names[pair] * (len(codes) + 1) + names[after[pair]]
        at, width = at[pair], 2 * width
    if not found:
        return at[:0], at[:0], at[:0]
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def echo(doc_id: int, n: int) -> tuple[int, int] | None:
    """(from, period): where the text of a document whose crc32 ends in 0 starts to repeat itself, for a table with known runs."""
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def periodic(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
             least_periods: int = LEAST_PERIODS, plant: Callable[[int, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs array of (start, length, period), collapsed): the runs of every whole text in words, by start,
    then period, and its words without what follows a run's first period, joined by one space.

    ``plant`` may name a word from which a text of so many words goes on by repeating the words before, with a period.
    """
    if least_periods < 3:
        raise ValueError("runs of fewer than three periods are not proposed")

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for s in slabs(b.column("text")):
                codes, start, end, bounds = word_codes(s)
                n = np.diff(bounds)
                planted = np.zeros(len(s), bool)
                if plant is not None:
                    source = np.arange(len(codes))
                    for i, doc_id in enumerate(ids[s.first:s.first + len(s)].tolist()):
                        where = plant(doc_id, int(n[i]))
                        if where is not None:
                            planted[i] = True
                            lo = int(bounds[i]) + where[0]
                            source[lo:bounds[i + 1]] = lo + np.arange(bounds[i + 1] - lo) % where[1]
                    codes, start, end = codes[source], start[source], end[source]
                first, length, period = find_runs(codes, bounds, least_words, least_periods)
                owner = np.searchsorted(bounds, first, "right") - 1
                edge = np.zeros(len(codes) + 1, np.int64)
                np.add.at(edge, first + period, 1)
                np.add.at(edge, first + length, -1)
                stays = np.cumsum(edge[:-1]) == 0
                raw = s.data.tobytes()
                changed = planted.copy()
                changed[owner] = True
                out = []
                for i, odd in enumerate(changed.tolist()):
                    if not odd:
                        out.append(b" ".join(raw[s.at[i]:s.at[i + 1]].split()))
                        continue
                    k = bounds[i] + np.flatnonzero(stays[bounds[i]:bounds[i + 1]])
                    out.append(b" ".join([raw[x:y] for x, y in zip(start[k].tolist(), end[k].tolist(), strict=True)]))
                cuts = np.searchsorted(owner, np.arange(len(s) + 1)).astype(np.int32)
                own = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (first - bounds[owner], length, period)],
                                                 names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s.first, len(s)), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(cuts), own), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(df, id_col, text_col).mapInArrow(
        tidy(run), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
