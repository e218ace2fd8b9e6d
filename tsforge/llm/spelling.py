"""Spelling variants of a corpus: words one edit apart, found by search schemes on bidirectional FM-indexes.

1. Words are counted over all whole texts, in each task first.
2. Two words are one edit apart exactly if one agrees with the first half of the other from its beginning, or with the
   second half to its end, and the edit lies in the other half. The vocabulary is dealt out twice in ranges that sampled
   splitters cut, by the words and by the words read backwards; a word asks in every range that its exact half reaches
   into, and where that are many, only in those that one of its edits falls in. So no range follows a common beginning.
3. A range is indexed (``fm_index.py``) and all words that ask there search it together: the exact half leftwards to the
   delimiter, then the other half rightwards with one error. Each word gets back how many words are near and the
   commonest of them; pairs are never sent. What the second search finds again is left out by comparing the first half.
4. A word's form is its commonest near word if that is common enough. Chains of forms end at roots: words without a form
   pass their name on to the words whose form they are, level by level, at most log2 of the largest count of times.

Results in every case: null, empty and letterless texts have no words; rows that share an id count each; rows without
an id are left out; of equally common near words the first in code-point order is the form; an empty table gives an
empty result; a text of any length is read whole; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.fm_index import Index
from tsforge.llm.tables import id_and_text, staged, tidy

LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: Words of a range on average, splitters' sample for each range, queries that move together.
RANGE, SAMPLED, BATCH = 40_000, 40, 8_000
#: Ranges that a word asks without looking at its edits.
ASKED = 4
_HOLD = 200_000
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
_LAST = chr(0x10FFFF)


def crc_typo(doc_id: int, run: str) -> str:
    """``run``, or where 97 divides the crc32 of ``doc_id:run``, without one of its code points."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % 97:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, typo: Callable[[int, str], str] | None = None) -> DataFrame:
    """(word, n): maximal runs of letters up to U+00FF, A-Z in lower case, of at least ``least_length`` code points. ``typo``
    may write a document's word in another way (shorter by a code point at most), the same at each of its places."""
    find = re.compile(f"[a-z\u00C0-\u00FF]{{{least_length},}}").findall

    def count(batches):
        held = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if not text.is_valid:
                    continue
                own = Counter(find(text.as_buffer().to_pybytes().lower().decode()))
                if typo is None:
                    held.update(own)
                else:
                    for run, n in own.items():
                        word = typo(doc_id, run)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= _HOLD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return docs.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def edits(word: str, exact: int, letters: str = LETTERS):
    """Words one edit away, the edit lying behind the first ``exact`` code points."""
    for k in range(exact, len(word) + 1):
        for x in letters:
            yield word[:k] + x + word[k:]
        if k < len(word):
            yield word[:k] + word[k + 1:]
            for x in letters:
                if x != word[k]:
                    yield word[:k] + x + word[k + 1:]


def asked_ranges(word: str, exact: int, splitters: list[str]) -> list[int]:
    """The ranges that may hold words one edit away that share the first ``exact`` code points."""
    first, last = bisect.bisect_right(splitters, word[:exact]), bisect.bisect_right(splitters, word[:exact] + _LAST)
    if last - first < ASKED:
        return list(range(first, last + 1))
    return sorted({bisect.bisect_right(splitters, x) for x in edits(word, exact)})


def _splitters(words: DataFrame, n: int, backwards: bool, ranges: int) -> list[str]:
    """Cuts between ranges, from about SAMPLED words a range - a sample whose size follows the number of ranges only."""
    if ranges == 1:
        return []
    key = F.reverse("word") if backwards else F.col("word")
    share = min(1.0, ranges * SAMPLED / n)
    got = sorted(r[0] for r in words.where(F.abs(F.xxhash64(F.lit(7), "word") % F.lit(1 << 40)) < int(share * (1 << 40))).select(key).toLocalIterator())
    return sorted({got[len(got) * k // ranges] for k in range(1, ranges)}) if got else []


def _exact(length: int, backwards: bool) -> int:
    return length - length // 2 if backwards else length // 2


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near struct(less, word)): for each row of (word, n) - distinct words of LETTERS - how many of the other
    words are one edit away, and of them the one with the largest n (``less`` is -n), ties in code-point order."""
    spark = words.sparkSession
    total = words.count()
    ranges = max(1, math.ceil(total / RANGE))
    cuts = [_splitters(words, max(1, total), back, ranges) for back in (False, True)]
    shared = spark.sparkContext.broadcast(cuts)  # ranges of them, a few dozen bytes each

    def deal(batches):
        for b in batches:
            at, key, n, asks = [], [], [], []
            for word, count in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                for side, cut in enumerate(shared.value):
                    k = word[::-1] if side else word
                    own = bisect.bisect_right(cut, k)
                    for r in {own, *asked_ranges(k, _exact(len(k), side == 1), cut)}:
                        at.append(2 * r + side)
                        key.append(k)
                        n.append(count)
                        asks.append(r != own)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(asks, pa.bool_()), pa.array(key, pa.string()), pa.array(n, pa.int64())],
                                             names=["range", "guest", "key", "n"])

    def search(batches):
        now, index, keys, counts, waiting = None, None, [], [], []

        def answers(asking):
            """Rows for (key, n) of words that ask the present range."""
            back = now % 2 == 1
            asking.sort(key=lambda x: len(x[0]))
            i = 0
            while i < len(asking):
                length = len(asking[i][0])
                j = i
                while j < len(asking) and j < i + BATCH and len(asking[j][0]) == length:
                    j += 1
                part = asking[i:j]
                i = j
                points = np.frombuffer("".join(k for k, _ in part).encode("utf-32-le"), "<u4").reshape(len(part), length)
                queries = index.symbols(points)
                who, word = index.one_error_behind(queries, _exact(length, back))
                if back:  # the first search has found those that begin alike
                    fresh = ~index.ends_alike(queries, who, word, length // 2)
                    who, word = who[fresh], word[fresh]
                order = np.lexsort((rank[word], -number[word], who))
                who, word = who[order], word[order]
                near = np.bincount(who, minlength=len(part))
                best = word[np.minimum(np.cumsum(near) - near, max(0, len(word) - 1))].tolist() if len(word) else [0] * len(part)
                some = near > 0
                names = [keys[w] if s else None for w, s in zip(best, some.tolist(), strict=True)]
                turn = (lambda x: x[::-1] if x else x) if back else (lambda x: x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([turn(k) for k, _ in part], pa.string()), pa.array([c for _, c in part], pa.int64()), pa.array(near, pa.int64()),
                     pa.array([-counts[w] if s else None for w, s in zip(best, some.tolist(), strict=True)], pa.int64()),
                     pa.array([turn(x) for x in names], pa.string())], names=["word", "n", "n_near", "less", "near"])

        def build():
            nonlocal index, rank, number
            points = np.frombuffer("".join(keys).encode("utf-32-le"), "<u4")
            index = Index(points, np.append(0, np.cumsum([len(k) for k in keys])))
            number = np.array(counts, np.int64)
            rank = np.empty(len(keys), np.int64)
            back = now % 2 == 1
            rank[np.array(sorted(range(len(keys)), key=(lambda i: keys[i][::-1]) if back else keys.__getitem__), np.int64)] = np.arange(len(keys))

        def ask():
            nonlocal waiting
            if index is None:
                build()
                yield from answers(list(zip(keys, counts, strict=True)))
            if waiting:
                yield from answers(waiting)
            waiting = []

        rank = number = None
        for b in batches:
            for at, guest, key, n in zip(*(b.column(c).to_pylist() for c in ("range", "guest", "key", "n")), strict=True):
                if at != now:
                    if keys:
                        yield from ask()
                    now, index, keys, counts, waiting = at, None, [], [], []
                if not guest:
                    keys.append(key)
                    counts.append(n)
                elif keys:
                    waiting.append((key, n))
                    if len(waiting) >= 4 * BATCH:
                        yield from ask()
        if keys:
            yield from ask()

    n = max(1, min(2 * ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = words.mapInArrow(tidy(deal), "range long, guest boolean, key string, n long") \
        .repartition(n, "range").sortWithinPartitions("range", "guest", "key") \
        .mapInArrow(tidy(search), "word string, n long, n_near long, less long, near string")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct("less", F.col("near").alias("word"))))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``: the word that its chain of forms ends at. Chains have no circles."""
    done = [staged(forms.where("form IS NULL").withColumn("root", F.col("word")), "roots")]
    left = forms.where("form IS NOT NULL")
    while True:
        known = done[-1].select(F.col("word").alias("form"), "root")
        level = staged(left.join(known, "form").select(*forms.columns, "root"), "roots")
        if level.isEmpty():
            break
        done.append(level)
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             factor: float = FACTOR, typo: Callable[[int, str], str] | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least ``least_length`` code points and ``least_count`` occurrences."""
    if factor <= 1:
        raise ValueError("a form must be commoner than its word")
    words = staged(word_counts(id_and_text(df, id_col, text_col), least_length, typo).where(F.col("n") >= least_count), "words")
    common = -F.col("near.less") >= factor * F.col("n")
    forms = near_words(words).select("word", F.when(common, F.col("near.word")).alias("form"), "n", "n_near",
                                     F.when(common, -F.col("near.less")).alias("form_n"))
    return roots(staged(forms, "forms")).select("word", "form", "root", "n", "n_near", "form_n")
