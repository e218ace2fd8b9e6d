"""A count-min sketch: which 64-bit keys may occur more than once, and which may occur very often.

Every task sketches its own rows and sends the touched cells by block; a block's sketches are merged
in one place by adding. What goes to the driver and back as a broadcast are only the bits "counted
twice or more" - ``depth * 2**log2_cells / 8`` bytes, at most 2 * 2**30 / 8 = 256 MB by MAX_LOG2,
whatever the input - and the names of cells counted HOT times or more, one for each HOT keys at most.
Counts are over-estimates: a key that occurs twice, or HOT times, is always reported.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tsforge.llm.tables import tidy
from tsforge.llm.textcodes import mix

MIN_LOG2, MAX_LOG2 = 20, 30
DEPTH = 2
#: Cells for each expected key.
ROOM = 4
HOT = 10_000
_BLOCK_LOG2, _COUNT_LOG2 = 20, 12
_FLUSH = 2_000_000
#: Cells whose bits are fetched by one job (32 MB).
_AT_ONCE = 1 << 28


def log2_cells(expected_keys: float) -> int:
    """Cells that keep the load near 1/ROOM, up to the bound; beyond it more keys pass, none is lost."""
    return min(MAX_LOG2, max(MIN_LOG2, math.ceil(math.log2(max(1.0, ROOM * expected_keys)))))


def _cells(keys: np.ndarray, row: int, log2: int) -> np.ndarray:
    return mix(keys + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - log2)


class Twice:
    """The merged sketch."""

    def __init__(self, bits: list[np.ndarray], log2: int, hot: list[np.ndarray]):
        self.bits, self.log2, self.hot = bits, log2, hot

    def may_be_hot(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for row, cells in enumerate(self.hot):
            hit &= np.isin(_cells(keys, row, self.log2), cells)
        return hit

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for row, bits in enumerate(self.bits):
            cell = _cells(keys, row, self.log2)
            hit &= (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 > 0
        return hit


def build(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2: int, depth: int = DEPTH, least: int = 2, hot: int = HOT) -> Twice:
    """Sketch the keys of all rows of ``df``; ``least`` 1 asks which keys occur at all."""
    block_log2 = min(_BLOCK_LOG2, log2)
    most = (1 << _COUNT_LOG2) - 1

    def sketch(parts: list[np.ndarray]):
        keys = np.concatenate(parts)
        for row in range(depth):
            cell, n = np.unique(_cells(keys, row, log2), return_counts=True)
            block = (cell >> np.uint64(block_log2)).astype(np.int64)
            if n.max() > most:  # a count goes in several parts
                parts = -(-n // most)
                cell, block = np.repeat(cell, parts), np.repeat(block, parts)
                last = np.cumsum(parts) - 1
                rest = n - most * (parts - 1)
                n = np.full(len(cell), most)
                n[last] = rest
            packed = ((cell & np.uint64((1 << block_log2) - 1)) << np.uint64(_COUNT_LOG2)).astype("<u4") | n.astype("<u4")
            cuts = np.flatnonzero(np.diff(block)) + 1
            names = block[np.append(0, cuts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * len(names), pa.int32()), pa.array(names, pa.int64()),
                 pa.array([x.tobytes() for x in np.split(packed, cuts)], pa.binary())], names=["r", "block", "cells"])

    def count(batches):
        parts, held = [], 0
        for b in batches:
            for keys in keys_of(b):
                if len(keys):
                    parts.append(keys)
                    held += len(keys)
                if held >= _FLUSH:
                    yield from sketch(parts)
                    parts, held = [], 0
        if parts:
            yield from sketch(parts)

    def merge(batches):
        now, counts = None, None

        def done():
            bits = np.packbits(counts >= least)
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([bits.tobytes()], pa.binary()),
                                                  pa.array([np.flatnonzero(counts >= hot).astype("<u4").tobytes()], pa.binary())], names=["r", "block", "bits", "hot"])

        for b in batches:
            for key, cells in zip(zip(b.column("r").to_pylist(), b.column("block").to_pylist(), strict=True), b.column("cells"), strict=True):
                if key != now:
                    if now is not None:
                        yield from done()
                    now, counts = key, np.zeros(1 << block_log2, np.uint32)
                packed = np.frombuffer(cells.as_buffer(), "<u4")
                if len(packed) > 4096:
                    counts += np.bincount(packed >> _COUNT_LOG2, packed & most, 1 << block_log2).astype(np.uint32)
                else:
                    np.add.at(counts, packed >> _COUNT_LOG2, packed & most)
                np.minimum(counts, 1 << 30, out=counts)
        if now is not None:
            yield from done()

    n = max(1, min(depth << (log2 - block_log2), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    merged = df.mapInArrow(tidy(count), "r int, block long, cells binary").repartition(n, "r", "block") \
        .sortWithinPartitions("r", "block").mapInArrow(tidy(merge), "r int, block long, bits binary, hot binary")
    bits = [np.zeros(max(1, (1 << log2) // 8), np.uint8) for _ in range(depth)]
    often: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(depth)]
    width = (1 << block_log2) // 8
    # a small sketch comes in one job, a large one partition by partition
    for row in merged.collect() if depth << log2 <= _AT_ONCE else merged.toLocalIterator():
        bits[row.r][row.block * width:(row.block + 1) * width] = np.frombuffer(row.bits, np.uint8)
        often[row.r].append(np.frombuffer(row.hot, "<u4").astype(np.uint64) + np.uint64(row.block << block_log2))
    return Twice(bits, log2, [np.sort(np.concatenate(x)) for x in often])
