"""Removal of word windows that also start in a document with a smaller id.

First pass: a count-min sketch. Each window of ``window`` words is stood for by one *gram* of
``GRAM`` words inside it, the one of least hash (windows of equal content choose the same gram), so
the sketch's count of that gram over-estimates the window's count. Task sketches are merged
(``sketch.py``). Second pass: the windows whose gram is estimated repeated, and no others, are grouped
exactly by a 128-bit hash of their words; the groups' smallest document ids decide. No repeated window
is lost, since the estimate is never below the true count.

Before the shuffle a task keeps one document per distinct window (a window of a later document is
settled on the spot), so a passage that a third of all documents hold costs one row per task.
Windows are dealt out by their gram: neighbours share it, so a removed passage stays a few ranges whatever the
number of buckets. A gram that the sketch counts in so many documents that their windows could fill half a bucket is
hot: its windows are dealt out by their own hash instead, so no bucket follows one gram.
A bucket holds about BUCKET windows and is worked on alone.

Results in every case: null, empty and short texts have no windows and keep all their words; of equal
texts the one with the smallest id keeps its words; rows that share an id count as one document;
rows without an id are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm import sketch
from tsforge.llm.tables import bounded_batches, id_and_text, tidy
from tsforge.llm.textcodes import BYTE_CODES, Ranges, anchors, mix, run_starts, slabs

WINDOW, GRAM = 50, 8
#: Windows of a bucket, on average, if all were estimated repeated.
BUCKET = 1_000_000
_HOLD = 1_000_000


def word_codes(slab, which: int = 0):
    """(codes, start bytes, end bytes, bounds): a 64-bit hash of each word of a slab."""
    s, e, bounds = slab.words()
    return mix(Ranges(BYTE_CODES[slab.data], which).of(s, e) + (e - s).astype(np.uint64)), s, e, bounds


def _grams(codes, bounds, window, gram):
    valid = run_starts(bounds, window, len(codes))
    order = mix(Ranges(codes).windows(gram)) if len(codes) >= gram else codes[:0]
    at, least = anchors(order, window - gram + 1, valid)
    return order, at, least, valid


def _runs(doc, pos, width):
    """Maximal runs of items that windows starting at (doc, pos) cover; ordered input."""
    if not len(doc):
        return doc, pos, pos
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], pos[first], pos[last] + width


def dealt_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, int]:
    """(bucket, doc, pos, h0, h1) of the windows that may be repeated, one row for each bucket and stretch, and how many
    buckets there are. Those below 0 hold ranges that their task has settled."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = size / 4  # an estimate that only sizes the sketch and the buckets
    steps = window - gram + 1

    def keys_of(batch):
        for s in slabs(batch.column("text")):
            codes, _, _, bounds = word_codes(s)
            order, at, _, _ = _grams(codes, bounds, window, gram)
            if len(at):  # once per document
                doc = np.searchsorted(bounds, at, "right")
                yield order[at][np.unique(mix(order[at] + doc.astype(np.uint64)), return_index=True)[1]]

    twice = sketch.build(docs, keys_of, sketch.log2_cells(words * 2 / (steps + 1)), hot=max(2, BUCKET // (2 * steps)))
    shared = docs.sparkSession.sparkContext.broadcast(twice)
    buckets = max(1, math.ceil(words / BUCKET))

    def settle(parts):
        """Windows of a task: rows to send by bucket, and what is settled here."""
        doc, pos, h0, h1, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, doc, h1, h0))
        doc, pos, h0, h1, key = doc[order], pos[order], h0[order], h1[order], key[order]
        repeated = _later(doc, h0, h1)
        yield _settled(doc[repeated], pos[repeated], window, buckets)
        doc, pos, h0, h1, key = (x[~repeated] for x in (doc, pos, h0, h1, key))
        bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        names = bucket[order][np.append(0, cuts)] if len(order) else bucket[:0]
        blobs = [[x.tobytes() for x in np.split(v[order].astype(t), cuts)] if len(order) else []
                 for v, t in ((doc, "<i8"), (pos, "<i4"), (h0, "<u8"), (h1, "<u8"))]
        yield _rows(names, *blobs)

    def windows(batches):
        parts, held = [], 0
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for s in slabs(b.column("text")):
                codes, start, end, bounds = word_codes(s)
                _, _, least, valid = _grams(codes, bounds, window, gram)
                least = least[:len(valid)]
                if not len(least):
                    continue
                new = np.ones(len(least), bool)
                new[1:] = least[1:] != least[:-1]
                first = np.flatnonzero(new)
                span = np.diff(np.append(first, len(least)))
                hit = np.repeat(shared.value.may_repeat(least[first]), span) & valid
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                doc = np.searchsorted(bounds, at, "right") - 1
                second = mix(Ranges(BYTE_CODES[s.data], 1).of(start, end) + (end - start).astype(np.uint64))
                h0, h1 = Ranges(codes).of(at, at + window), Ranges(second, 1).of(at, at + window)
                hot = np.repeat(shared.value.may_be_hot(least[first]), span)[at]
                parts.append((ids[s.first + doc], at - bounds[doc], h0, h1, np.where(hot, h0, least[at])))
                held += len(at)
                if held >= _HOLD:
                    yield from settle(parts)
                    parts, held = [], 0
        if parts:
            yield from settle(parts)

    return docs.mapInArrow(tidy(windows), "bucket long, doc binary, pos binary, h0 binary, h1 binary"), buckets


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                  gram: int = GRAM) -> DataFrame:
    """(doc_id, begin, until): word ranges covered by windows that a smaller document also holds; ranges may overlap."""
    sent, buckets = dealt_windows(id_and_text(df, id_col, text_col), window, gram)

    def group(batches):
        now, parts = None, []

        def done():
            doc, pos, h0, h1 = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((pos, doc, h1, h0))
            doc, pos = doc[order], pos[order].astype(np.int64)
            repeated = _later(doc, h0[order], h1[order])
            yield _ranges(*_ordered_runs(doc[repeated], pos[repeated], window))

        for b in batches:
            for k, bucket in enumerate(b.column("bucket").to_pylist()):
                raw = [b.column(c)[k].as_buffer() for c in ("doc", "pos", "h0", "h1")]
                if bucket < 0:  # settled by the task that read it
                    yield _ranges(*(np.frombuffer(x, t) for x, t in zip(raw[:3], ("<i8", "<i4", "<i8"), strict=True)))
                    continue
                if bucket != now and parts:
                    yield from done()
                    parts = []
                now = bucket
                parts.append(tuple(np.frombuffer(x, t) for x, t in zip(raw, ("<i8", "<i4", "<u8", "<u8"), strict=True)))
        if parts:
            yield from done()

    n = max(1, min(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(group), "doc_id long, begin long, until long")


def _later(doc, h0, h1):
    """Rows of a group of equal hashes whose document is not the group's first; ordered input."""
    if not len(doc):
        return np.zeros(0, bool)
    new = np.ones(len(doc), bool)
    new[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
    return doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]


def _ordered_runs(doc, pos, window):
    order = np.lexsort((pos, doc))
    return _runs(doc[order], pos[order], window)


def _ranges(doc, begin, until):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc, begin, until)],
                                      names=["doc_id", "begin", "until"])


def _rows(bucket, doc, pos, h0, h1):
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *(pa.array(x, pa.binary()) for x in (doc, pos, h0, h1))],
                                      names=["bucket", "doc", "pos", "h0", "h1"])


def _settled(doc, pos, window, buckets):
    doc, begin, until = _ordered_runs(doc, pos, window)
    if not len(doc):
        return _rows([], [], [], [], [])
    spread = -1 - int(mix(doc[:1].astype(np.uint64))[0] % np.uint64(max(64, buckets)))
    return _rows([spread], [doc.astype("<i8").tobytes()], [begin.astype("<i4").tobytes()], [until.astype("<i8").tobytes()], [b""])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept string[, carried columns]): each whole text without its repeated words,
    joined by one space. Carried columns have other names than the first four."""
    runs = repeated_runs(df, id_col, text_col, window, gram).groupBy("doc_id").agg(
        F.collect_list(F.shiftleft("begin", 32) + F.col("until")).alias("runs"))
    held = [f"carried_{k}" for k in range(len(carry))]
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     *(F.col(c).alias(h) for c, h in zip(carry, held, strict=True))).where(F.col("doc_id").isNotNull())
    joined = docs.join(runs, "doc_id", "left").select("doc_id", "text", "runs", *held)
    kinds = "".join(f", {h} {docs.schema[h].dataType.simpleString()}" for h in held)

    def keep(batches):
        for b in batches:
            runs = pc.fill_null(b.column("runs"), [])
            at = runs.offsets.to_numpy()
            packed = runs.flatten().to_numpy(zero_copy_only=False)
            at = at - at[0]
            for s in slabs(b.column("text")):
                start, end, bounds = s.words()
                raw = s.data.tobytes()
                n = np.diff(bounds)
                own = packed[at[s.first]:at[s.first + len(s)]]
                owner = np.repeat(np.arange(len(s)), np.diff(at[s.first:s.first + len(s) + 1]))
                edge = np.zeros(len(start) + 1, np.int64)
                np.add.at(edge, bounds[owner] + np.minimum(own >> 32, n[owner]), 1)  # rows that share an id differ in length
                np.add.at(edge, bounds[owner] + np.minimum(own & 0xFFFFFFFF, n[owner]), -1)
                stays = np.cumsum(edge[:-1]) == 0
                some = np.zeros(len(s), bool)
                some[owner] = True
                gone, kept = np.zeros(len(s), np.int64), []
                for i, cut in enumerate(some.tolist()):
                    if not cut:
                        kept.append(b" ".join(raw[s.at[i]:s.at[i + 1]].split()))
                        continue
                    k = bounds[i] + np.flatnonzero(stays[bounds[i]:bounds[i + 1]])
                    gone[i] = n[i] - len(k)
                    kept.append(b" ".join([raw[x:y] for x, y in zip(start[k].tolist(), end[k].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s.first, len(s)), pa.array(n.astype(np.int64)), pa.array(gone),
                     pa.array(kept, pa.binary()).cast(pa.string()), *(b.column(h).slice(s.first, len(s)) for h in held)],
                    names=["doc_id", "n_words", "n_removed", "kept", *held])

    out = joined.mapInArrow(tidy(keep), "doc_id long, n_words long, n_removed long, kept string" + kinds)
    return out.toDF("doc_id", "n_words", "n_removed", "kept", *carry)
