"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon is learned from the labelled training rows: word beginnings (``STEMS`` letters, or the whole
word) that far more toxic than other documents hold. Obfuscated spellings are read as the letters they
stand for. Dense features of a whole text are the lexicon's densities, how often a hit stands near a
second person, and the rates of capitals, punctuation and obfuscation. Trees may only rise with lexicon
features. Lexicon, trees and calibration are learned from different rows.

Learning takes at most ``SAMPLE`` labelled rows on average (picked by a hash of the id); labels, lang,
source and ids are no inputs of a score.

Results in every case: null and empty texts get the score of a text without words; equal texts get equal
scores; without labels of both kinds all scores are 0; rows without an id are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm import boosting
from tsforge.llm.tables import draw, id_and_text, threshold, tidy
from tsforge.llm.textcodes import SPACE, slabs

SAMPLE = 16_000
#: Lengths of word beginnings that may enter the lexicon, beside whole words.
STEMS = (4, 5, 6, 7)
LEXICON_SIZE, LEXICON_MIN_DOCS, LEXICON_MIN_RATIO = 600, 5, 8.0
THRESHOLD = 0.3
NEAR = 5
WORDS_KEPT = 300_000

#: Second persons in the languages of the tables (plain word list).
SECOND_PERSON = frozenset("""you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen
tu te toi ton ta tes vous votre vos tú ti tu tus usted ustedes vosotros os vuestro""".split())
#: Signs that stand for letters in obfuscated words.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"})
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NOT_LETTER = re.compile(r"[\W\d_]+")

FEATURES = {"log_words": 0, "lexicon_per_word": 1, "weight_per_word": 1, "top_weight": 1, "log_hits": 1, "distinct_hits": 1,
            "near_second_person": 1, "second_person_per_word": 0, "upper_share": 0, "punctuation_share": 0,
            "exclaim_per_word": 0, "obfuscated_per_word": 0, "obfuscated_hits": 1}


def plain(word: str) -> tuple[str, bool]:
    """(letters, obfuscated): a word in lower case without signs; signs inside it count as the letters they stand for."""
    core = _EDGES.sub("", unicodedata.normalize("NFC", word).lower())
    if core.isalpha() or not core:
        # a sign at the edge may stand for a letter as well ("$tupid")
        return core, False
    letters = _NOT_LETTER.sub("", core.translate(LOOKALIKE))
    return letters, any(c.isalpha() for c in core) and not re.fullmatch(r"[\d.,:]+", core)


def stems(letters: str) -> list[str]:
    return [letters + "$"] + [letters[:k] for k in STEMS if len(letters) >= k]


class Lexicon:
    """Weights of stems, and what a word means for the features: (weight, second person, obfuscated)."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.memo: dict[bytes, int] = {}
        self.kinds: list[tuple[float, bool, bool]] = [(0.0, False, False)]
        self.kind_of = {self.kinds[0]: 0}

    def __getstate__(self):
        return self.weights

    def __setstate__(self, weights):
        self.__init__(weights)

    def kind(self, word: bytes) -> int:
        letters, odd = plain(word.decode())
        found = max((self.weights.get(s, 0.0) for s in stems(letters)), default=0.0) if letters else 0.0
        key = (found, letters in SECOND_PERSON, odd)
        if key not in self.kind_of:
            self.kind_of[key] = len(self.kinds)
            self.kinds.append(key)
        return self.kind_of[key]

    def codes(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > WORDS_KEPT:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.kind(w)
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def _rates(slab, flags):
    total = np.append(0, np.cumsum(flags))
    return total[slab.at[1:]] - total[slab.at[:-1]]


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def features(slab, lexicon: Lexicon) -> np.ndarray:
    n, data = len(slab), slab.data
    raw = data.tobytes()
    s, e, bounds = slab.words()
    codes = lexicon.codes([raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])
    kinds = np.array(lexicon.kinds, float)
    weight, second, odd = kinds[codes, 0], kinds[codes, 1] > 0, kinds[codes, 2] > 0
    text = np.repeat(np.arange(n), np.diff(bounds))
    hit = weight > 0
    words = np.diff(bounds)
    per_word = 1 / np.maximum(words, 1)
    count = lambda flags: np.bincount(text[flags], minlength=n)
    total = np.bincount(text, weight, n)
    top = np.zeros(n)
    np.maximum.at(top, text[hit], weight[hit])
    # a hit is near a second person when one stands at most NEAR words off in the same text
    people = np.append(0, np.cumsum(second))
    at = np.flatnonzero(hit)
    lo, hi = np.maximum(at - NEAR, bounds[text[at]]), np.minimum(at + NEAR + 1, bounds[text[at] + 1])
    near = np.bincount(text[at], people[hi] > people[lo], n)
    distinct = np.bincount(np.unique(np.stack([text[at], codes[at]], 1), axis=0)[:, 0], minlength=n) if len(at) else np.zeros(n)
    chars = np.maximum(_rates(slab, ~SPACE[data] & ((data & 0xC0) != 0x80)), 1)
    return np.stack([np.log1p(words), count(hit) * per_word, total * per_word, top, np.log1p(count(hit)), distinct, near,
                     count(second) * per_word, _rates(slab, (data >= 65) & (data <= 90)) / chars, _rates(slab, _PUNCTUATION[data]) / chars,
                     _rates(slab, data == 33) * per_word, count(odd) * per_word, count(odd & hit)], 1)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic, fold): a bounded sample of the labelled documents whose crc32 of the id is not 2 modulo 4."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(toxic AS int) AS toxic") \
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    few = known.where(draw("doc_id") <= threshold(sample, known.count())) \
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).cast("int"))
    return docs.join(F.broadcast(few), "doc_id")  # bounded by ``sample``


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Stems by document counts in toxic and other training documents; counted on the cluster."""

    def run(batches):
        seen: dict[tuple[str, int], int] = Counter()
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen.update({(k, y) for w in set((t or "").split()) for k in stems(plain(w)[0])})
            if len(seen) > 1_000_000:
                yield flat(seen)
                seen = Counter()
        yield flat(seen)

    def flat(seen):
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int32()),
                                           pa.array([seen[k] for k in keys], pa.int64())], names=["stem", "toxic", "n"])

    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return Lexicon({})
    rate = F.col("bad") / size[1] / ((F.col("good") + 0.5) / size[0])
    best = rows.select("text", "toxic").mapInArrow(tidy(run), "stem string, toxic int, n long").groupBy("stem").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")) \
        .where((F.col("bad") >= LEXICON_MIN_DOCS) & (rate >= LEXICON_MIN_RATIO)) \
        .withColumn("weight", F.log(rate) * F.log1p("bad")).orderBy(F.desc("weight"), "stem").limit(LEXICON_SIZE).collect()
    return Lexicon({r.stem: float(r.weight) for r in best if r.stem != "$"})


class Model:
    def __init__(self, lexicon, trees, at, p):
        self.lexicon, self.trees, self.at, self.p = lexicon, trees, at, p

    def score(self, slab) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(slab))
        return np.interp(self.trees.probability(features(slab, self.lexicon)), self.at, self.p)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon from half of the training rows, trees from a quarter, calibration from the other quarter."""
    rows = training_rows(docs, labels, sample)
    lexicon = learn_lexicon(rows.where("fold < 2"))

    def run(batches):
        for b in batches:
            for s in slabs(b.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [b.column("toxic").slice(s.first, len(s)), b.column("fold").slice(s.first, len(s)),
                     pa.array(list(features(s, lexicon)), pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    got = rows.where("fold >= 2").select("toxic", "fold", "text").mapInArrow(tidy(run), "toxic int, fold int, x array<double>").toArrow()
    y, fold = got["toxic"].to_numpy().astype(float), got["fold"].to_numpy()
    x = np.array(got["x"].to_pylist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    seen = fold == 2
    if not seen.any() or y[seen].min() == y[seen].max():
        return Model(lexicon, None, None, None)
    trees = boosting.fit(x[seen], y[seen], list(FEATURES.values()))
    return Model(lexicon, trees, *boosting.isotonic(trees.probability(x[~seen]), y[~seen]))


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
          threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    docs = id_and_text(df, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        for b in batches:
            for s in slabs(b.column("text")):
                p = np.clip(model.value.score(s), 0, 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, len(s)), pa.array(p),
                                                  pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.mapInArrow(tidy(run), "doc_id long, score double, predicted int").select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), "score", "predicted")
