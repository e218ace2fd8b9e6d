"""Quality rules learned as gradient-boosted trees over document statistics.

Statistics of whole texts come from byte arrays of a batch at once. Trees are fitted on at most
``SAMPLE`` labelled documents, with the score bound to fall with repetition, symbols, capitals and
exclamation marks, flattened into node arrays (``boosting.py``) and sent to the tasks.

Results in every case: a null or empty text has zero statistics and fails the base rules; equal texts
get equal verdicts; without labels of both kinds only the base rules decide; rows without an id are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm import boosting
from tsforge.llm.tables import draw, id_and_text, threshold, tidy
from tsforge.llm.textcodes import BYTE_CODES, SPACE, Ranges, mix, run_starts, slabs

#: Labelled documents to fit on, on average (a hash of the id picks them).
SAMPLE = 16_000
#: A document stays if its probability of good quality reaches this.
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: The characters that count as symbols, fixed by the contract.
SYMBOLS = b"#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the direction in which each may move the score (0: free).
FEATURES = {"log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
            "distinct_share": 0, "upper_share": -1, "exclaim_per_word": -1, "digit_share": 0, "stop_per_word": 0,
            "words_per_line": 0, "letter_share": 0}


def _lut(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _lut(SYMBOLS), _lut(range(65, 91)), _lut(range(48, 58))
_LETTER = _lut([*range(65, 91), *range(97, 123), *range(128, 256)])


def _per_text(slab, flags: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return total[slab.at[1:]] - total[slab.at[:-1]]


def _repeats(text: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Flags: rows that share (text, code) with another row. The 64-bit key joins both."""
    key = mix(codes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    flags = np.zeros(len(key), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def _distinct(text: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    key, first = np.unique(mix(codes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(text[first], minlength=n)


def statistics(slab) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(base statistics, feature rows) of the texts of a slab."""
    n, data = len(slab), slab.data
    s, e, bounds = slab.words()
    codes = mix(Ranges(BYTE_CODES[data]).of(s, e) + (e - s).astype(np.uint64))
    n_words = np.diff(bounds)
    word_text = np.repeat(np.arange(n), n_words)
    inside = ~SPACE[data]
    chars = (data & 0xC0) != 0x80
    word_chars = _per_text(slab, inside & chars)
    n_symbols = _per_text(slab, _SYMBOL[data])
    # lines: they begin with the text and behind every \n
    breaks = np.flatnonzero(data == 10)
    text_of = np.searchsorted(slab.at, breaks, "right") - 1
    begin = np.concatenate([slab.at[:-1], breaks + 1])
    line_text = np.concatenate([np.arange(n), text_of])
    order = np.lexsort((begin, line_text))
    begin, line_text = begin[order], line_text[order]
    last = np.append(line_text[1:] != line_text[:-1], True) if n else np.zeros(0, bool)
    end = np.where(last, slab.at[line_text + 1], np.append(begin[1:], 0) - 1) if n else begin
    filled = np.append(0, np.cumsum(inside))
    has_word = filled[end] > filled[begin]
    line_codes = mix(Ranges(BYTE_CODES[data]).of(begin, end) + (end - begin).astype(np.uint64))[has_word]
    lines = np.bincount(line_text[has_word], minlength=n)
    n_dup_lines = lines - _distinct(line_text[has_word], line_codes, n)
    # words inside windows that occur twice or more in the text
    starts = np.flatnonzero(run_starts(bounds, REPEAT_WINDOW, len(codes)))
    covered = np.zeros(len(codes) + 1, np.int32)
    if len(starts):
        windows = Ranges(codes).of(starts, starts + REPEAT_WINDOW)
        again = starts[_repeats(word_text[starts], windows)]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + REPEAT_WINDOW, -1)
    total = np.append(0, np.cumsum(np.cumsum(covered[:-1]) > 0))
    n_repeat = total[bounds[1:]] - total[bounds[:-1]]
    base = dict(zip(BASE, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat), strict=True))
    per_word, per_char = 1 / np.maximum(n_words, 1), 1 / np.maximum(word_chars, 1)
    letters = _per_text(slab, _LETTER[data] & chars)
    features = (np.log1p(n_words), word_chars * per_word, n_symbols * per_word, n_dup_lines / np.maximum(lines, 1),
                n_repeat * per_word, _distinct(word_text, codes, n) * per_word, _per_text(slab, _UPPER[data]) * per_char,
                _per_text(slab, data == 33) * per_word, _per_text(slab, _DIGIT[data]) * per_char,
                _per_text(slab, data == 46) * per_word, n_words / np.maximum(lines, 1), letters * per_char)
    return base, np.stack(features, 1).astype(float) if n else np.zeros((0, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Trees | None:
    """Trees for P(quality = 1) from a bounded sample of the labelled documents among ``docs`` (doc_id, text)."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(quality AS int) AS quality")
    n = known.count()
    if not n:
        return None
    few = known.where(draw("doc_id") <= threshold(sample, n))

    def run(batches):
        for b in batches:
            for s in slabs(b.column("text")):
                x = statistics(s)[1]
                yield pa.RecordBatch.from_arrays([b.column("quality").slice(s.first, len(s)), pa.array(list(x), pa.list_(pa.float64()))],
                                                 names=["quality", "x"])

    # the labels' sample is bounded by ``sample``, hence broadcast
    rows = docs.join(F.broadcast(few), "doc_id").select("quality", "text").mapInArrow(tidy(run), "quality int, x array<double>").toArrow()
    y = rows["quality"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(rows["x"].to_pylist())
    order = np.lexsort((*x.T, y))  # the same trees in whatever order the rows come
    return boosting.fit(x[order], y[order], list(FEATURES.values()))


def verdict(slab, trees: boosting.Trees | None, threshold: float) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """(base statistics, base rules failed, kept, score) of the texts of a slab."""
    base, x = statistics(slab)
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
    p = trees.probability(x) if trees is not None else np.ones(len(slab))
    return base, failed, ~failed & (p >= threshold), p


def good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, whose text passes; no shuffle."""
    trees = df.sparkSession.sparkContext.broadcast(fit(id_and_text(df, id_col, text_col), labels, sample))

    def run(batches):
        for b in batches:
            keep = [verdict(s, trees.value, threshold)[2] for s in slabs(b.column(text_col))]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return df.where(F.col(id_col).isNotNull()).mapInArrow(tidy(run), df.schema)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
          threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of every whole text."""
    docs = id_and_text(df, id_col, text_col)
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        for b in batches:
            for s in slabs(b.column("text")):
                base, failed, kept, p = verdict(s, trees.value, threshold)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s.first, len(s)), *(pa.array(base[c], pa.int64()) for c in BASE), pa.array(failed),
                     pa.array(kept), pa.array(p)], names=["doc_id", *BASE, "base_failed", "kept", "score"])

    return docs.mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double")
