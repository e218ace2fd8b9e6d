"""Language identification: a byte convolutional network on fixed-length windows.

Bytes are embedded, filters of several widths run over a window of ``WINDOW`` bytes, the largest response
of each filter over the window goes to a softmax over the learned languages. A text's windows cover all
of its bytes; its prediction is the mean of their probabilities, weighted by their bytes. Training is in numpy on
the driver, on a bounded sample: at most about ``SAMPLE_PER_LANG`` documents of each language (a hash
of the id picks them) and ``WINDOWS_PER_DOC`` windows of each, spread over the whole text.

lang, source and ids are never inputs of a prediction; rows whose crc32 of the id is 0 modulo 5 never train.

Results in every case: null texts and texts without a letter are ``und`` with score 0; without training
rows every text is; equal texts get equal predictions; rows without an id are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.tables import bounded_batches, draw, id_and_text, threshold, tidy
from tsforge.llm.textcodes import slabs

WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 8, 6
SAMPLE_PER_LANG, WINDOWS_PER_DOC = 1200, 4
EPOCHS, BATCH, RATE = 4, 64, 0.004
#: Windows evaluated at once.
TOGETHER = 512
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


class ByteNet:
    """Embedding -> convolutions -> maximum over the window -> softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.widest = max(WIDTHS)
        n = FILTERS * len(WIDTHS)
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = np.zeros((self.widest, EMBEDDING, n), np.float32)
        self.mask = np.zeros_like(self.filters)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS:(k + 1) * FILTERS] = 1
        self.filters = (rng.normal(0, 0.4, self.filters.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.dense = rng.normal(0, 0.3, (n, len(langs))).astype(np.float32)
        self.out = np.zeros(len(langs), np.float32)

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Windows x places x filters. Each window is followed by zero bytes, so narrow texts work too."""
        n, size = windows.shape
        padded = np.zeros((n, size + self.widest - 1), np.uint8)
        padded[:, :size] = windows
        e = self.embedding[padded]
        patches = np.concatenate([e[:, j:j + size] for j in range(self.widest)], 2).reshape(n * size, -1)
        return (patches @ self.filters.reshape(-1, self.filters.shape[2])).reshape(n, size, -1)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(windows).max(1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.dense + self.out
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam on cross-entropy. Only the place of a filter's maximum has a gradient."""
        rng = np.random.default_rng(seed)
        params = [self.embedding, self.filters, self.bias, self.dense, self.out]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                pick = order[i:i + BATCH]
                x, y = windows[pick], labels[pick]
                r = self.responses(x)
                where = r.argmax(1)
                top = np.take_along_axis(r, where[:, None], 1)[:, 0] + self.bias
                h = np.maximum(top, 0)
                z = h @ self.dense + self.out
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                dh = (p @ self.dense.T) * (top > 0)
                padded = np.pad(x, ((0, 0), (0, self.widest - 1)))
                patch = np.take_along_axis(padded, (where[:, :, None] + np.arange(self.widest)).reshape(len(x), -1), 1).reshape(*where.shape, -1)
                e = self.embedding[patch]  # window x filter x place x embedding
                d_filters = np.einsum("nf,nfpe->pef", dh, e) * self.mask
                d_e = np.einsum("nf,pef->nfpe", dh, self.filters)
                d_embedding = np.zeros_like(self.embedding)
                np.add.at(d_embedding, patch.ravel(), d_e.reshape(-1, EMBEDDING))
                step += 1
                for k, g in enumerate((d_embedding, d_filters, dh.sum(0), h.T @ p, p.sum(0))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    params[k] -= (RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def windows_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes from each start, zero behind each end."""
    at = start[:, None] + np.arange(WINDOW)
    out = data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros(at.shape, np.uint8)
    out[at >= end[:, None]] = 0
    return out


def predict(slab, net: ByteNet) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language, its probability) for the texts of a slab; empty texts give probability 0."""
    n_windows = -(-np.diff(slab.at) // WINDOW)
    text = np.repeat(np.arange(len(slab)), n_windows)
    start = slab.at[text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows))
    end = np.minimum(start + WINDOW, slab.at[text + 1])
    total = np.zeros((len(slab), len(net.langs)))
    for i in range(0, len(text), TOGETHER):
        part = slice(i, i + TOGETHER)
        p = net.probabilities(windows_of(slab.data, start[part], end[part])) * (end[part] - start[part])[:, None]
        np.add.at(total, text[part], p)
    total /= np.maximum(np.diff(slab.at), 1)[:, None]
    return total.argmax(1), total.max(1)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = SAMPLE_PER_LANG, epochs: int = EPOCHS) -> ByteNet | None:
    """A net trained on a bounded sample of the rows whose crc32 of the id is not 0 modulo 5."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     F.col(lang_col).cast("string").alias("lang")) \
        .where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
               & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(threshold(per_lang, counts[k])))))
    few = rows.where(draw("doc_id") <= share[F.col("lang")])

    def run(batches):
        for b in batches:
            for s in slabs(b.column("text")):
                out, names = [], []
                for i in range(len(s)):
                    lo, hi = int(s.at[i]), int(s.at[i + 1])
                    k = min(WINDOWS_PER_DOC, -(-(hi - lo) // WINDOW))
                    if not k:
                        continue
                    start = np.unique(np.linspace(lo, max(lo, hi - WINDOW), k).astype(np.int64))
                    out += [x.tobytes() for x in windows_of(s.data, start, np.full(len(start), hi))]
                    names += [b.column("lang")[s.first + i].as_py()] * len(start)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(names, pa.string())], names=["window", "lang"])

    got = few.select("text", "lang").mapInArrow(tidy(run), "window binary, lang string").toArrow().to_pydict()
    pairs = sorted(zip(got["lang"], got["window"], strict=True))
    if not pairs:
        return None
    net = ByteNet(langs)
    index = {k: i for i, k in enumerate(langs)}
    net.train(np.stack([np.frombuffer(w, np.uint8) for _, w in pairs]), np.array([index[k] for k, _ in pairs]), epochs)
    return net


def label(slab, net: ByteNet | None) -> tuple[list[str], np.ndarray]:
    """(language, score) of the texts of a slab."""
    lettered = np.array([_LETTER.search(slab.text(i).decode()) is not None for i in range(len(slab))], bool)
    if net is None:
        return [UNKNOWN] * len(slab), np.zeros(len(slab))
    best, p = predict(slab, net)
    return [net.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, np.clip(p, 0, 1), 0.0)


def recognised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows of ``df``, all columns, whose text has a language with a score of at least ``least``; no shuffle.
    Without training rows no language is known, and texts with a letter stay."""
    net = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col, lang_col))

    def run(batches):
        for b in batches:
            keep = []
            for s in slabs(b.column(text_col)):
                if net.value is None:
                    keep += [_LETTER.search(s.text(i).decode()) is not None for i in range(len(s))]
                else:
                    names, p = label(s, net.value)
                    keep += [n != UNKNOWN and x >= least for n, x in zip(names, p.tolist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.where(F.col(id_col).isNotNull()).mapInArrow(tidy(run), df.schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_lang: int = SAMPLE_PER_LANG, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text."""
    net = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col, lang_col, per_lang, epochs))

    def run(batches):
        for b in batches:
            for s in slabs(b.column("text")):
                name, p = label(s, net.value)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, len(s)), pa.array(name, pa.string()), pa.array(p)],
                                                 names=["doc_id", "lang_pred", "score"])

    return id_and_text(df, id_col, text_col).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double").select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "lang_pred", "score")
