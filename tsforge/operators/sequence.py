"""Row positions and bounded-size window execution for long series.

``Window.partitionBy(series).orderBy(ts)`` puts a whole series into one task; a
series holding a third of all rows would then run on one core. This module
replaces that with:

1. :func:`with_row_index` - exact 0-based position inside each series: rows are
   range-partitioned and sorted by (series, time, ties), counted per partition, and
   the counts summed up in a table of one row per (partition, series). A hot series,
   minute or stamp is spread over as many partitions as it fills.
2. :func:`chunk_with_halo` - cut each series into chunks of ``chunk_rows``
   positions and copy the last ``halo`` rows of every chunk into the next one,
   so any frame reaching at most ``halo`` rows back is exact inside a chunk.
   Windows then run on ``partitionBy(series, chunk)``: task size is bounded by
   ``chunk_rows + halo`` whatever the length of a series.
3. :func:`neighbours` - unbounded forward/backward look-ups (fills,
   interpolation) resolved inside a chunk and, where a chunk has no value, from
   a chunk-level table (one row per chunk), carried on in levels: inside stretches of
   FAN chunks, then over stretches of stretches.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window

from tsforge import SERIES, TS
from tsforge.session import cut_lineage

IDX = "_idx"
CHUNK = "_chunk"
HALO = "_halo"
DEFAULT_CHUNK_ROWS = 4096
#: Chunks of a stretch, and levels of stretches: a series' last level has one row per 4096**(LEVELS + 1) rows.
FAN, LEVELS = 4096, 1


def _orderable(df: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names if df.schema[c].dataType.typeName() not in ("map", "variant", "interval")]


def with_row_index(df: DataFrame, series: str | list[str] = SERIES, order: str = TS, out: str = IDX,
                   total: str | None = None) -> DataFrame:
    """Add the exact 0-based row position of each row inside its series (and the series' row count as ``total``).

    Ties on ``order`` are broken by all other columns. The sorted partitions are written to the
    shared folder before they are counted, so a lost executor cannot renumber them. Rows whose
    series or ``order`` is NULL keep their place: NULL is a series of its own and sorts first.
    """
    keys = [series] if isinstance(series, str) else list(series)
    by = [F.col(f"`{c}`") for c in (*keys, order)] + _orderable(df, [c for c in df.columns if c not in (*keys, order)])
    rows = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per (partition, series): at most partitions + series rows
    w = Window.partitionBy(*keys)
    offsets = counts.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first",
                            F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
                            F.sum("_n").over(w).alias("_total"))
    same = part == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    extra = [F.col("_total").alias(total)] if total else []
    return rows.join(offsets, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") - F.col("_first") + F.col("_base")).alias(out), *extra)


def chunk_with_halo(df: DataFrame, halo: int, chunk_rows: int = DEFAULT_CHUNK_ROWS, idx: str = IDX) -> DataFrame:
    """Assign ``_chunk`` and copy each row into the following chunks that it lies at most ``halo`` rows before
    (``_halo`` true there); a halo may be longer than a chunk."""
    own = F.floor(F.col(idx) / chunk_rows).cast("long")
    last = F.floor((F.col(idx) + F.lit(halo)) / chunk_rows).cast("long")
    return (df.select("*", F.explode(F.sequence(own, last)).alias(CHUNK))
              .withColumn(HALO, F.col(CHUNK) != own))


def series_window(chunked: bool, series: str = SERIES, order: str = TS) -> WindowSpec:
    """Chunked windows order by the row position itself (unique, so ties cannot reorder)."""
    if chunked:
        return Window.partitionBy(series, CHUNK).orderBy(IDX)
    return Window.partitionBy(series).orderBy(order)


def apply_windows(df: DataFrame, build: Callable[[WindowSpec], list[Column]], halo: int,
                  chunk_rows: int | None = DEFAULT_CHUNK_ROWS, keep_index: bool = False) -> DataFrame:
    """Add the columns returned by ``build(W)`` where ``W`` is the series window.

    ``chunk_rows=None`` uses the plain per-series window (one task per series);
    otherwise chunk+halo (bounded tasks). Both give identical values for frames
    that look back at most ``halo`` rows and forward not past the current row.
    """
    if chunk_rows is None:
        return df.select("*", *build(series_window(False)))
    base = df if IDX in df.columns else with_row_index(df)
    ch = chunk_with_halo(base, halo, chunk_rows)
    out = ch.select("*", *build(series_window(True))).where(~F.col(HALO)).drop(CHUNK, HALO)
    return out if keep_index or IDX in df.columns else out.drop(IDX)


def apply_time_windows(df: DataFrame, build: Callable[[WindowSpec], list[Column]], reach_seconds: int,
                       chunk_seconds: int = DEFAULT_CHUNK_ROWS * 3600) -> DataFrame:
    """Add the columns returned by ``build(W)``, where ``W`` orders a series by epoch seconds for ``rangeBetween`` frames
    that look back at most ``reach_seconds``: hours mean hours, whatever rows are missing. Series are cut into stretches of
    time, each with a copy of the rows it looks back on. Rows without a stamp are in no frame and come back with NULLs."""
    t = F.unix_seconds(TS)
    own = F.floor(t / chunk_seconds).cast("long")
    last = F.floor((t + F.lit(reach_seconds)) / chunk_seconds).cast("long")
    chunks = F.when(t.isNotNull(), F.sequence(own, last)).otherwise(F.array(F.lit(None).cast("long")))
    rows = df.withColumn("_t", t).withColumn(CHUNK, F.explode(chunks))
    w = Window.partitionBy(SERIES, CHUNK).orderBy("_t")
    return rows.select("*", *build(w)).where(F.col(CHUNK).isNull() | (F.col(CHUNK) == own)).drop(CHUNK, "_t")


def _looking(keys: list[str], at: str, end: int) -> tuple[WindowSpec, WindowSpec]:
    """Frames of all rows before and of all rows behind, up to ``end`` rows from the current one; in both the nearest row comes
    last. The second runs in falling order: a frame that ends at the last row is added up anew at every row."""
    return tuple(Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, end) for o in (F.asc(at), F.desc(at)))


def neighbours(df: DataFrame, cols: list[str], chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Nearest non-null entry at-or-before (``_prev_<c>``) and at-or-after (``_next_<c>``)
    each row, as structs ``(p, v)`` of row position and value, for all ``cols`` in one pass.

    Plain mode: a frame of the per-series window in either direction. Chunked mode: the same
    frames inside ``(series, chunk)``, plus a table of one row per chunk holding
    its first/last non-null entries, scanned with a small window (carry) and
    joined back where a chunk has no neighbour of its own. Adds ``_idx``.
    """
    base = df if IDX in df.columns else (
        with_row_index(df) if chunk_rows is not None
        else df.withColumn(IDX, F.row_number().over(series_window(False)) - 1))
    nn = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(IDX).alias("p"), F.col(c).alias("v"))) for c in cols}
    keys = [SERIES] if chunk_rows is None else [SERIES, CHUNK]
    if chunk_rows is not None:
        base = base.withColumn(CHUNK, F.floor(F.col(IDX) / chunk_rows).cast("long"))
    before, after = _looking(keys, IDX, 0)
    # the rising frame last: rows come out in time order, and sums behind this step add them up in that order
    loc = base.select("*", *[F.last(nn[c], ignorenulls=True).over(after).alias("_next_" + c) for c in cols]) \
        .select("*", *[F.last(nn[c], ignorenulls=True).over(before).alias("_prev_" + c) for c in cols])
    if chunk_rows is None:
        return loc
    pos = {c: F.when(F.col(c).isNotNull(), F.col(IDX)) for c in cols}
    per_chunk = base.groupBy(SERIES, CHUNK).agg(
        *[F.max_by(nn[c], pos[c]).alias("_last_" + c) for c in cols],
        *[F.min_by(nn[c], pos[c]).alias("_first_" + c) for c in cols])
    carry = _carried(per_chunk, CHUNK, cols, LEVELS)
    out = [F.col(f"`{x}`") for x in base.columns if x != CHUNK]
    for c in cols:
        out += [F.coalesce("_prev_" + c, "_cp_" + c).alias("_prev_" + c),
                F.coalesce("_next_" + c, "_cn_" + c).alias("_next_" + c)]
    carry = carry.withColumnsRenamed({SERIES: "_cs", CHUNK: "_cc"})  # NULL is a series like any other
    return loc.join(carry, F.col(SERIES).eqNullSafe(F.col("_cs")) & (F.col(CHUNK) == F.col("_cc")), "left").select(*out)


def _carried(ends: DataFrame, at: str, cols: list[str], levels: int) -> DataFrame:
    """Per (series, ``at``): the last entry of the rows before (``_cp_<c>``) and the first of those behind (``_cn_<c>``), from
    each row's ``_last_<c>`` and ``_first_<c>``. A window holds the rows of one stretch of FAN; what comes from other
    stretches is found the same way among the stretches, ``levels`` times, and then among all that are left."""
    up = f"_stretch{levels}"
    keys = [SERIES] if levels == 0 else [SERIES, up]
    rows = ends if levels == 0 else ends.withColumn(up, F.floor(F.col(at) / FAN).cast("long"))
    before, after = _looking(keys, at, -1)
    near = rows.select(*keys, at, *[F.last("_last_" + c, ignorenulls=True).over(before).alias("_cp_" + c) for c in cols],
                       *[F.last("_first_" + c, ignorenulls=True).over(after).alias("_cn_" + c) for c in cols])
    if levels == 0:
        return near
    has = lambda c: F.when(F.col(c).isNotNull(), F.col(at))
    above = _carried(rows.groupBy(*keys).agg(*[F.max_by("_last_" + c, has("_last_" + c)).alias("_last_" + c) for c in cols],
                                             *[F.min_by("_first_" + c, has("_first_" + c)).alias("_first_" + c) for c in cols]), up, cols, levels - 1)
    far = above.select(F.col(SERIES).alias("_us"), F.col(up).alias("_u"), *[F.col(k + c).alias("_u" + k + c) for c in cols for k in ("_cp_", "_cn_")])
    joined = near.join(far, F.col(SERIES).eqNullSafe(F.col("_us")) & (F.col(up) == F.col("_u")), "left")
    return joined.select(SERIES, at, *[F.coalesce(k + c, "_u" + k + c).alias(k + c) for c in cols for k in ("_cp_", "_cn_")])


def carry_forward(df: DataFrame, cols: list[str], names: list[str], chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``cols`` with NULLs replaced by the last value before them in the series, under new ``names``; other columns stay."""
    nb = neighbours(df, cols, chunk_rows)
    new = dict(zip(cols, names))
    return nb.select(*[F.col("_prev_" + c)["v"].alias(new[c]) if c in new else F.col(f"`{c}`") for c in df.columns])
