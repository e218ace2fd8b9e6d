"""Resampling onto a regular time spine (R1-R5) and the gap report.

Buckets are aggregated with a partial (map-side) hash aggregate on
``(series, bucket)``, so a hot series is split by its buckets before the shuffle.
The spine is generated in two levels (coarse blocks, then steps inside a block)
so no single ``sequence`` array grows with the length of a series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.operators.joins import join_same
from tsforge.operators.sequence import IDX

# Fixed frequency strings accepted (pandas aliases used by the reference plus lower case).
_FREQ = {
    "H": ("hour", "INTERVAL 1 HOUR", 3600),
    "h": ("hour", "INTERVAL 1 HOUR", 3600),
    "D": ("day", "INTERVAL 1 DAY", 86400),
    "d": ("day", "INTERVAL 1 DAY", 86400),
}

# Steps generated per spine block: bounds the array built by one ``sequence`` call.
SPINE_BLOCK_STEPS = 4096


def freq_spec(freq: str) -> tuple[str, str, int]:
    if freq not in _FREQ:
        raise ValueError(f"unsupported frequency {freq!r}; use one of {sorted(set(_FREQ))}")
    return _FREQ[freq]


def bucket(ts: Column | str, freq: str) -> Column:
    unit, _, _ = freq_spec(freq)
    return F.date_trunc(unit, F.col(ts) if isinstance(ts, str) else ts)


def spine(bounds: DataFrame, freq: str, lo: str = "lo", hi: str = "hi", out: str = TS,
          keys: list[str] | None = None, idx: str | None = None) -> DataFrame:
    """Regular stamps ``lo, lo+step, ... <= hi`` for every row of ``bounds``.

    Level 1 explodes block starts (one per ``SPINE_BLOCK_STEPS`` steps), the
    blocks are spread over the cluster, level 2 explodes the steps of a block. With
    ``idx`` each stamp's position on its spine is added: no row numbering is needed later.
    """
    _, interval, seconds = freq_spec(freq)
    keys = keys if keys is not None else [c for c in bounds.columns if c not in (lo, hi)]
    block = SPINE_BLOCK_STEPS * seconds
    blocks = bounds.select(
        *keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"),
        F.explode(F.sequence(F.lit(0).cast("long"),
                             F.floor((F.unix_seconds(F.col(hi)) - F.unix_seconds(F.col(lo))) / block).cast("long")))
        .alias("_blk"))
    # Only for wide ranges there are many blocks; AQE coalesces the tiny case.
    blocks = blocks.repartition(*keys, "_blk") if keys else blocks.repartition("_blk")
    start = F.expr(f"_lo + make_dt_interval(0, 0, 0, _blk * {block})") if seconds < 86400 else \
        F.expr(f"_lo + make_interval(0, 0, 0, cast(_blk * {SPINE_BLOCK_STEPS} as int))")
    blocks = blocks.select(*keys, "_hi", "_blk", start.alias("_start"))
    stop = F.least(F.col("_hi"), F.expr(f"_start + {interval} * {SPINE_BLOCK_STEPS - 1}"))
    stamps = F.sequence(F.col("_start"), stop, F.expr(interval))
    if idx is None:
        return blocks.select(*keys, F.explode(stamps).alias(out))
    return blocks.select(*keys, "_blk", F.posexplode(stamps).alias("_step", out)) \
        .select(*keys, out, (F.col("_blk") * SPINE_BLOCK_STEPS + F.col("_step")).alias(idx))


def resample(df: DataFrame, freq: str = "H", how: str | dict = "mean", value_cols: list[str] | None = None,
             fill_empty_sum: bool = True, keep_index: bool = False) -> DataFrame:
    """Aggregate to ``freq`` buckets and emit every bucket between each series' first and last.

    ``how`` is ``mean``/``sum`` or a per-column dict. Empty buckets: mean -> NULL,
    sum -> 0 (pandas ``sum`` of nothing), as in the reference's daily resample. A NULL series is a series of
    its own; rows without a stamp belong to no bucket. ``keep_index`` adds each bucket's position as ``_idx``.
    """
    value_cols = value_cols or [c for c in df.columns if c not in (SERIES, TS)]
    hows = {c: (how[c] if isinstance(how, dict) else how) for c in value_cols}
    aggs = []
    for c in value_cols:
        if hows[c] == "mean":
            aggs.append(F.avg(c).alias(c))
        elif hows[c] == "sum":
            aggs.append(F.sum(c).alias(c))
        else:
            raise ValueError(f"unsupported aggregation {hows[c]!r}")
    agg = df.groupBy(SERIES, bucket(TS, freq).alias(TS)).agg(*aggs)
    agg = agg.where(F.col(TS).isNotNull())
    # The bounds keep every value column in use, so both sides read one and the same exchange of the buckets
    # and the raw table is scanned once.
    used = [F.count(c).alias(f"_u{i}") for i, c in enumerate(value_cols)]
    bounds = agg.groupBy(SERIES).agg(F.min(TS).alias("lo"), F.max(TS).alias("hi"), *used) \
        .where(reduce(lambda a, b: a & b, [F.col(f"_u{i}") >= 0 for i in range(len(used))])).select(SERIES, "lo", "hi")
    grid = spine(bounds, freq, keys=[SERIES], idx=IDX).withColumnsRenamed({SERIES: "_gs", TS: "_gt"})
    full = grid.join(agg, F.col("_gs").eqNullSafe(F.col(SERIES)) & (F.col("_gt") == F.col(TS)), "left")
    outs = []
    for c in value_cols:
        col = F.col(c)
        if hows[c] == "sum" and fill_empty_sum:
            col = F.coalesce(col, F.lit(0.0))
        outs.append(col.alias(c))
    return full.select(F.col("_gs").alias(SERIES), F.col("_gt").alias(TS), *outs, *([IDX] if keep_index else []))


def gap_report(df: DataFrame, freq: str = "H", first_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per series expected/actual/missing counts, completeness and gap sizes.

    Returns ``(report, first_missing)``. ``report`` columns: total_expected,
    total_actual (rows, duplicates included), missing_count, completeness_pct,
    largest_gap_hours (max spacing between consecutive missing stamps, 0 when
    fewer than two) and longest_run_hours (longest run of consecutive missing
    steps, gaps-and-islands: consecutive stamps share ``step index - rank``). ``first_missing`` holds the first ``first_k``
    missing stamps per series (rank, ts). The spine starts at the first stamp
    itself (not truncated), as a date range does.
    """
    _, _, seconds = freq_spec(freq)
    stats = df.groupBy(SERIES).agg(F.min(TS).alias("lo"), F.max(TS).alias("hi"), F.count(F.lit(1)).alias("total_actual"))
    expected = spine(stats.select(SERIES, "lo", "hi"), freq, keys=[SERIES])
    present = df.select(SERIES, TS).distinct()
    missing = join_same(expected, present, [SERIES, TS], "left_anti")
    # Missing stamps lie on the spine grid: the distributed row index and a 1-row halo
    # give rank, spacing and island keys without ordering a whole series in one task.
    from tsforge.operators.sequence import apply_windows, with_row_index
    indexed = with_row_index(missing)
    spaced = apply_windows(indexed, lambda w: [
        ((F.unix_seconds(F.col(TS)) - F.unix_seconds(F.lag(TS).over(w))) / 3600.0).alias("_gap")], halo=1)
    m = spaced.select(SERIES, TS, "_gap", (F.unix_seconds(F.col(TS)) / seconds).cast("long").alias("_k"),
                      (F.col(IDX) + 1).alias("_rn"))
    # Consecutive missing steps share (k - rn): the island key.
    runs = (m.groupBy(SERIES, (F.col("_k") - F.col("_rn")).alias("_isl")).agg(F.count(F.lit(1)).alias("_len")))
    per_missing = m.groupBy(SERIES).agg(F.count(F.lit(1)).alias("missing_count"),
                                        F.coalesce(F.max("_gap"), F.lit(0.0)).alias("largest_gap_hours"))
    per_run = runs.groupBy(SERIES).agg((F.max("_len") * (seconds / 3600.0)).alias("longest_run_hours"))
    n_expected = expected.groupBy(SERIES).agg(F.count(F.lit(1)).alias("total_expected"))
    counted = join_same(join_same(join_same(stats, n_expected, [SERIES]), per_missing, [SERIES], "left"), per_run, [SERIES], "left")
    report = (counted
              .select(SERIES, "total_expected", "total_actual",
                      F.coalesce("missing_count", F.lit(0)).alias("missing_count"),
                      (F.col("total_actual") * 100.0 / F.col("total_expected")).alias("completeness_pct"),
                      F.coalesce("largest_gap_hours", F.lit(0.0)).alias("largest_gap_hours"),
                      F.coalesce("longest_run_hours", F.lit(0.0)).alias("longest_run_hours")))
    first = m.where(F.col("_rn") <= first_k).select(SERIES, F.col("_rn").alias("rank"), TS)
    return report, first
