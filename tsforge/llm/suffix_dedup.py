"""Suffix-array removal of byte strings that also start earlier.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id,
or earlier in its own document. Sorting every suffix of the corpus would move ``length`` bytes for each
byte of text, so the suffix array here is sparse: it holds the suffixes at *anchors*, the places where
the hash of ``GRAM`` bytes is least in some string of ``length`` bytes (about one byte in forty). Equal
strings hold equal anchors at equal places, so every repeated string is found at its anchors.

1. A count-min sketch of the anchors' grams (``sketch.py``) leaves out suffixes that occur once. Its
   estimates are never too low.
2. Sampled splitters cut the order of the suffixes by their leading ``LEAD`` bytes into buckets. An equal
   lead is never cut in two, so a comparison across a bucket's boundary is decided by the splitter itself:
   suffixes on either side differ within the lead, which every string at these anchors includes. Leads so
   frequent that a bucket could not hold them (``hot``) are dealt out by the strings around them instead:
   each string is sent as a suffix of its own, dealt out by a hash of all its bytes, apart from ordinary ones.
3. A bucket sorts its suffixes, and the reversed texts before the anchors, by multikey quicksort on
   8-byte symbols: a round orders by one symbol, and only what ties goes on to the next. With the common
   prefix lengths of neighbours the strings at distance d before an anchor are equal exactly where d bytes
   before and ``length - d`` bytes from the anchor are, for each d.
   What strings at one anchor cover is one stretch around it, from the largest such d to the smallest.
4. The stretches are gathered per document and cut from its bytes.

Before anything is sent, a task settles suffixes whose whole surroundings equal an earlier suffix of
that task, so copies that a third of all documents share cost one row per task.

Results in every case: null and empty texts have no bytes; texts shorter than ``length`` stay whole;
matches never cross documents; rows that share an id are taken as copies of one document; rows without
an id are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm import sketch
from tsforge.llm.tables import id_and_text, tidy
from tsforge.llm.textcodes import BYTE_CODES, Ranges, anchors, mix, run_starts, slabs

LENGTH, GRAM, LEAD = 100, 16, 16
#: Suffixes of a bucket, on average, if all anchors were estimated repeated.
BUCKET = 150_000
#: Documents from which splitters are drawn, on average; they steer the balance, never the result.
SAMPLE_DOCS = 4_000
_HOLD_BYTES = 6 << 20


def multikey_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the order of rows of big-endian 64-bit symbols, and how many leading bytes each
    row of that order has in common with the one before (0 for the first)."""
    n, depth = symbols.shape
    order = np.argsort(symbols[:, 0])
    common = np.zeros(n, np.int32)
    tied = np.arange(n)  # places of the order that still tie with a neighbour
    for level in range(depth):
        col = symbols[order[tied], level]
        if level:
            group = np.cumsum(common[tied] < 8 * level)
            again = np.lexsort((col, group))
            order[tied], col = order[tied][again], col[again]
            same = group[1:] == group[:-1]
        else:
            same = np.ones(max(0, n - 1), bool)
        differs = col[1:] ^ col[:-1]
        # leading equal bytes of two symbols, from the highest bit that differs
        high = np.frexp((differs >> np.uint64(11)).astype(np.float64))[1]
        high = np.where(high > 0, high + 11, np.frexp((differs & np.uint64(0x7FF)).astype(np.float64))[1])
        equal = np.where(differs == 0, 8, (64 - high) // 8)
        at = tied[1:][same]
        common[at] = 8 * level + equal[same]
        going = np.zeros(n + 1, bool)
        full = common >= 8 * (level + 1)
        going[:n] = full
        going[:n] |= np.append(full[1:], False)
        tied = np.flatnonzero(going[:n])
        if not len(tied):
            break
    return order, common


def _symbols(rows: np.ndarray) -> np.ndarray:
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    return padded.view(">u8").astype(np.uint64)


def covered(spot: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int, length: int,
            lead: int) -> tuple[np.ndarray, np.ndarray]:
    """(furthest, nearest): for suffixes in order of (document, place), numbered by ``spot``, the largest and the smallest distance
    d before the anchor at which a string starts that an earlier row also has; -1 where there is none.

    ``context`` has ``reach`` bytes before each anchor and ``length`` from it on, of which ``left`` and
    ``right`` belong to the document.
    """
    n = len(context)
    furthest, nearest = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    if n < 2:
        return furthest, nearest
    order_r, common_r = multikey_order(_symbols(context[:, reach:reach + length]))
    order_l, common_l = multikey_order(_symbols(context[:, :reach][:, ::-1])) if reach else (np.arange(n), np.zeros(n, np.int32))

    def blocks(order, common, depth):
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(common < depth) if depth else 0
        return out

    def paired(order, common, depth):
        near = common >= depth
        near = near | np.append(near[1:], False)
        out = np.empty(n, bool)
        out[order] = near
        return out

    # rows whose whole surroundings equal an earlier row's: every string there is repeated
    whole = np.lexsort((np.arange(n), right, left, blocks(order_l, common_l, reach), blocks(order_r, common_r, length)))
    bl, br = blocks(order_l, common_l, reach)[whole], blocks(order_r, common_r, length)[whole]
    same = np.zeros(n, bool)
    same[1:] = (bl[1:] == bl[:-1]) & (br[1:] == br[:-1]) & (left[whole][1:] == left[whole][:-1]) & (right[whole][1:] == right[whole][:-1])
    same[1:] &= spot[whole][1:] != spot[whole][:-1]
    copy = np.zeros(n, bool)
    copy[whole] = same
    furthest[copy], nearest[copy] = left[copy], length - right[copy]
    rest = ~copy
    bits = max(1, int(n).bit_length())
    if 3 * bits > 64:
        raise ValueError("a bucket holds too many suffixes; lower BUCKET")
    for d in range(reach, -1, -1):
        deep = length - d
        if deep < lead:
            continue
        use = rest & (left >= d) & (right >= deep) & paired(order_r, common_r, deep)
        if d:
            use &= paired(order_l, common_l, d)
        at = np.flatnonzero(use)
        if len(at) < 2:
            continue
        key = (blocks(order_r, common_r, deep)[at].astype(np.uint64) << np.uint64(bits)) | blocks(order_l, common_l, d)[at].astype(np.uint64)
        key = np.sort((key << np.uint64(bits)) | at.astype(np.uint64))
        group, row = key >> np.uint64(bits), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        # a hot string may also be a suffix of its own: the same place is no repeat
        later = spot[row] != np.repeat(spot[row[first]], np.diff(np.append(first, len(row))))
        row = row[later]
        furthest[row] = np.maximum(furthest[row], d)
        nearest[row] = d
    return furthest, nearest


class _Suffixes:
    """Anchors of a slab whose gram may repeat, with their surroundings."""

    def __init__(self, slab, length, gram):
        self.slab = slab
        codes = BYTE_CODES[slab.data]
        self.valid = run_starts(slab.at, length, len(codes))
        self.ranges = Ranges(codes)
        self.order = mix(self.ranges.windows(gram)) if len(codes) >= gram else codes[:0]
        self.at, _ = anchors(self.order, length - gram + 1, self.valid)
        self.keys = self.order[self.at]

    def rows(self, at, reach, length):
        """(text, place, left, right, context) of the suffixes at ``at``; texts too short around them are left out."""
        bounds, data = self.slab.at, self.slab.data
        text = np.searchsorted(bounds, at, "right") - 1
        left = np.minimum(reach, at - bounds[text])
        right = np.minimum(length, bounds[text + 1] - at)
        ok = left + right >= length
        at, text, left, right = at[ok], text[ok], left[ok], right[ok]
        padded = np.zeros(len(data) + reach + length, np.uint8)
        padded[reach:reach + len(data)] = data
        context = np.lib.stride_tricks.sliding_window_view(padded, reach + length)[at]
        cut = np.flatnonzero((left < reach) | (right < length))
        span = np.arange(-reach, length)
        context[cut] *= (span >= -left[cut, None]) & (span < right[cut, None])
        return text, at - bounds[text], left, right, context


def _leads(context, reach, lead):
    return np.ascontiguousarray(context[:, reach:reach + lead]).view(f"S{lead}").ravel()


def _pack(*arrays):
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def _unpack(raw, n, width):
    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=n * (16 + 8 + width) + 1)
    ids = np.frombuffer(raw, "<i8", 2 * n)
    sides = np.frombuffer(raw, "<i4", 2 * n, 16 * n)
    return ids[:n], ids[n:], sides[:n], sides[n:], np.frombuffer(raw, np.uint8, n * width, 24 * n).reshape(n, width)


def _send(bucket, n, blob):
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())],
                                      names=["bucket", "n", "blob"])


def splitters(docs: DataFrame, twice, n_docs: int, buckets: int, reach: int, length: int, gram: int, lead: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(cuts, hot, filled): leads that begin a bucket, from the suffixes of sampled documents; leads that fill more than
    one; how many buckets these fill."""
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))

    def run(batches):
        for b in batches:
            for s in slabs(b.column("text")):
                suffixes = _Suffixes(s, length, gram)
                at = suffixes.at[twice.value.may_repeat(suffixes.keys)] if len(suffixes.at) else suffixes.at
                names = _leads(suffixes.rows(at, reach, length)[4], reach, lead) if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array([x.ljust(lead, b"\0") for x in names], pa.binary())], names=["lead"])

    seen = sorted(bytes(r.lead) for r in docs.sample(False, share, 11).mapInArrow(tidy(run), "lead binary").toLocalIterator())
    if not seen or buckets < 2:
        return np.zeros(0, f"S{lead}"), np.zeros(0, f"S{lead}"), 0
    picked = [seen[i * len(seen) // buckets] for i in range(1, buckets)]
    # with few samples a bucket, two equal cuts are chance; a lead that fills four buckets is hot
    hot = sorted({a for a, b in zip(picked, picked[4:], strict=False) if a == b})
    return np.unique(np.array(picked, f"S{lead}")), np.array(hot, f"S{lead}"), sum(x in set(hot) for x in picked)


def dealt_suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_size: int = BUCKET) -> tuple[DataFrame, int]:
    """(bucket, n, blob) of the suffixes that may be repeated, and how many buckets ordinary ones have. Strings around hot
    leads are in the buckets after those, ranges that are settled in those below 0."""
    spark = docs.sparkSession
    lead = min(LEAD, gram)
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    reach = length - gram
    expected = 2.3 * size / (reach + 2)

    def keys_of(batch):
        for s in slabs(batch.column("text")):
            yield _Suffixes(s, length, gram).keys

    twice = spark.sparkContext.broadcast(sketch.build(docs, keys_of, sketch.log2_cells(expected)))
    buckets = max(1, math.ceil(expected / bucket_size))
    cuts, hot, filled = splitters(docs, twice, n_docs, buckets, reach, length, gram, lead)

    # an anchor has as many strings around it as it has distances
    hot_buckets = 1 + filled * (reach + 1)

    def settle(parts):
        """Suffixes of a stretch of texts: one of each set of equal surroundings goes on."""
        doc, place, left, right, h0, h1, context, own = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, doc, own, h1, h0))
        doc, place, left, right, context, own = doc[order], place[order], left[order], right[order], context[order], own[order]
        same = np.zeros(len(order), bool)
        same[1:] = (h0[order][1:] == h0[order][:-1]) & (h1[order][1:] == h1[order][:-1]) \
            & (own[1:] == own[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (context[1:] == context[:-1]).all(1)
        done = np.flatnonzero(same)
        if len(done):
            # bucket -1 and below: ranges that are settled, spread over the tasks
            d, b, u = _merge(doc[done], place[done] - left[done], place[done] + right[done])
            spread = -1 - int(mix(d[:1].astype(np.uint64))[0] % np.uint64(max(64, buckets)))
            yield _send([spread], [len(d)], [_pack(d.astype("<i8"), b.astype("<i8"), u.astype("<i8"))])
        go = np.flatnonzero(~same)
        # strings around hot leads matter only where all their bytes are equal: their hash deals them out
        bucket = np.where(own[go], buckets + (mix(h0[order][go]) % np.uint64(hot_buckets)).astype(np.int64),
                          np.searchsorted(cuts, _leads(context[go], reach, lead), "right"))
        go, bucket = go[np.argsort(bucket, kind="stable")], np.sort(bucket)
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(go))
        begins = np.append(0, ends[:-1])
        for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
            if j > i:
                at = go[i:j]
                yield _send([int(bucket[i])], [j - i], [_pack(doc[at].astype("<i8"), place[at].astype("<i8"),
                                                              left[at].astype("<i4"), right[at].astype("<i4"), context[at])])

    def find(batches):
        parts, held = [], 0
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for s in slabs(b.column("text")):
                held += len(s.data)
                suffixes = _Suffixes(s, length, gram)
                at = suffixes.at[twice.value.may_repeat(suffixes.keys)] if len(suffixes.at) else suffixes.at
                if len(at):
                    second = Ranges(BYTE_CODES[s.data], 1)
                    text, place, left, right, context = suffixes.rows(at, reach, length)
                    groups = [(text, place, left, right, context, np.zeros(len(text), bool))]
                    if len(hot):
                        # the strings around a hot lead, each as a suffix without anything before it
                        is_hot = np.isin(_leads(context, reach, lead), hot)
                        starts = (s.at[text] + place)[is_hot][:, None] - np.arange(reach + 1)
                        within = text[is_hot][:, None]
                        fits = (starts >= s.at[within]) & (starts + length <= s.at[within + 1])
                        starts = np.unique(starts[fits])
                        groups = [tuple(x[~is_hot] for x in groups[0])]
                        for k in range(0, len(starts), 20_000):
                            own_text, own_place, none, right_, own_context = suffixes.rows(starts[k:k + 20_000], 0, length)
                            groups.append((own_text, own_place, none, right_, np.pad(own_context, ((0, 0), (reach, 0))), np.ones(len(own_text), bool)))
                    for text, place, left, right, context, own in groups:
                        where = s.at[text] + place
                        parts.append((ids[s.first + text], place, left, right, suffixes.ranges.of(where - left, where + right),
                                      second.of(where - left, where + right), context, own))
                if held >= _HOLD_BYTES or sum(len(p[0]) for p in parts) > 200_000:
                    if parts:
                        yield from settle(parts)
                    parts, held = [], 0
        if parts:
            yield from settle(parts)

    return docs.mapInArrow(tidy(find), "bucket long, n long, blob binary"), buckets


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_size: int = BUCKET) -> DataFrame:
    """(doc_id, begin, until): byte ranges of ``docs`` (doc_id, text) covered by strings that start earlier; they may overlap."""
    lead, reach, width = min(LEAD, gram), length - gram, 2 * length - gram
    sent, buckets = dealt_suffixes(docs, length, gram, bucket_size)

    def compare(batches):
        now, parts = None, []

        def done():
            doc, place, left, right, context = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, doc))
            doc, place, left, right, context = doc[order], place[order], left[order], right[order], context[order]
            spot = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])))
            furthest, nearest = covered(spot, context, left, right, reach, length, lead)
            hit = furthest >= 0
            yield _ranges(*_merge(doc[hit], place[hit] - furthest[hit], place[hit] + length - nearest[hit]))

        for b in batches:
            for bucket, n, blob in zip(b.column("bucket").to_pylist(), b.column("n").to_pylist(), b.column("blob"), strict=True):
                if bucket < 0:
                    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_buffer(), max_output_size=24 * n + 1), "<i8")
                    yield _ranges(raw[:n], raw[n:2 * n], raw[2 * n:])
                    continue
                if bucket != now and parts:
                    yield from done()
                    parts = []
                now = bucket
                parts.append(_unpack(blob.as_buffer(), n, width))
        if parts:
            yield from done()

    n = max(1, min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return sent.repartition(n, "bucket") \
        .sortWithinPartitions("bucket").mapInArrow(tidy(compare), "doc_id long, begin long, until long")


def _merge(doc, begin, until):
    """Union of ranges, per document."""
    order = np.lexsort((begin, doc))
    doc, begin, until = doc[order], begin[order], until[order]
    if not len(doc):
        return doc, begin, until
    base = np.cumsum(np.append(0, doc[1:] != doc[:-1])).astype(np.int64) << 40  # documents apart on one line
    reach = np.maximum.accumulate(until + base)
    new = np.append(True, begin[1:] + base[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], begin[first], (reach - base)[np.append(first[1:], len(doc)) - 1]


def _ranges(doc, begin, until):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc, begin, until)],
                                      names=["doc_id", "begin", "until"])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
          bucket_size: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array<struct<begin,until>>, kept binary) of every document."""
    docs = id_and_text(df, id_col, text_col)
    spans = repeated_spans(docs, length, gram, bucket_size)
    # one long per range: a text is shorter than 2**31 bytes
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.shiftleft("begin", 31) + F.col("until")).alias("spans"))
    joined = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,until:long>>, kept binary"
    span_type = pa.struct([("begin", pa.int64()), ("until", pa.int64())])

    def cut(batches):
        for b in batches:
            spans = b.column("spans")
            for s in slabs(b.column("text")):
                gone, found, kept = [], [], []
                for i in range(len(s)):
                    own, raw = spans[s.first + i].values, s.text(i)
                    if own is None or not len(own):
                        gone.append(0)
                        found.append([])
                        kept.append(raw)
                        continue
                    own = own.to_numpy()
                    begin, until = own >> 31, np.minimum(own & ((1 << 31) - 1), len(raw))
                    _, begin, until = _merge(np.zeros(len(own), np.int64), begin, until)
                    gone.append(int((until - begin).sum()))
                    found.append([{"begin": x, "until": y} for x, y in zip(begin.tolist(), until.tolist(), strict=True)])
                    kept.append(b"".join([raw[x:y] for x, y in zip([0, *until.tolist()], [*begin.tolist(), len(raw)], strict=True)]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s.first, len(s)), pa.array(np.diff(s.at)), pa.array(gone, pa.int64()),
                     pa.array(found, pa.list_(span_type)), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(tidy(cut), schema)
