"""Packing token sequences: bounded-space online best-fit.

Documents are tokenised and cut into pieces of at most ``capacity`` ids. Pieces arrive at shards of bounded
size in a fixed order: a hash deals them into stretches of about STRETCH, and a stretch arrives longest piece
first, so its short pieces fill what its long ones left. In a shard a fixed number of bins is open. A
bitset keyed by free space gives the open bin with the least space that still holds a piece; when a
new bin is needed and all are open, the fullest closes. A shard is one task's work and holds only
its open bins and the lengths it reads as a stream.

Results in every case: a null or empty text is the one id ``eos``; an empty table gives no rows;
equal texts are packed as separate pieces; rows without an id are left out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.bpe_chunks import encoder, tokenizer_path
from tsforge.llm.tables import id_and_text, staged, tidy
from tsforge.llm.textcodes import slabs

CAPACITY, EOS = 4096, 1
OPEN_BINS = 4096
#: Pieces in a shard, on average; a shard leaves at most OPEN_BINS bins part empty.
SHARD_PIECES = 1_000_000
#: Pieces of a stretch, on average; fewer than OPEN_BINS, so a stretch's bins stay open for it.
STRETCH = 4000


class BestFit:
    """A fixed number of open bins, found by free space."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f is set when an open bin has f places free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece; 0 < length <= capacity."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            found, free = self.n_bins, self.capacity
            self.n_bins += 1
        left = free - length
        if left:
            if self.n_open == self.open_bins:  # the fullest closes: perhaps this one
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest < left:
                    self._take(fullest)
                else:
                    return found, self.capacity - free
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.n_open += 1
        return found, self.capacity - free


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           capacity: int = CAPACITY, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the ids of each whole text and ``eos``, cut at ``capacity``."""
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([eos], "<u4").tobytes()

    def run(batches):
        enc = encoder(path).words
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for s in slabs(b.column("text")):
                rows = []
                for k, raw in enumerate(enc.slab(s)):
                    raw += end
                    for p, i in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[i:i + 4 * capacity]
                        rows.append((doc_ids[s.first + k], p, i // 4, len(part) // 4, zlib.crc32(part))
                                    + ((np.frombuffer(part, "<u4").astype(np.int32),) if with_ids else ()))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])

    return id_and_text(df, id_col, text_col).mapInArrow(tidy(run), schema)


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length``; ``cut`` is read twice."""
    n = cut.count()
    shards, stretches = max(1, math.ceil(n / shard_pieces)), max(1, math.ceil(n / STRETCH))
    turn = F.xxhash64("doc_id", "piece")
    # a stretch belongs to one shard
    rows = cut.withColumn("stretch", F.pmod(turn, F.lit(stretches))).withColumn("shard", F.pmod("stretch", F.lit(shards))).withColumn("turn", turn)
    names = cut.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def run(batches):
        shard, bins = None, None
        for b in batches:
            seq, off = [], []
            for s, length in zip(b.column("shard").to_pylist(), b.column("length").to_pylist(), strict=True):
                if s != shard:
                    shard, bins = s, BestFit(capacity, open_bins)
                found, at = bins.place(length)
                seq.append(s << 40 | found)
                off.append(at)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                                             names=[*names, "sequence_id", "offset"])

    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "stretch", F.desc("length"), "turn", "doc_id", "piece").mapInArrow(tidy(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from rows that carry ``ids``."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   capacity: int = CAPACITY, eos: int = EOS, open_bins: int = OPEN_BINS,
                   shard_pieces: int = SHARD_PIECES, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; texts are tokenised once (the pieces are staged in the shared folder)."""
    return pack(staged(pieces(df, id_col, text_col, path, capacity, eos, with_ids), "pieces"), capacity, open_bins, shard_pieces)
