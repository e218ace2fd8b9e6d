"""Row-based window features (W1-W14, W19): column builders over a series window ``W``.

Every builder takes the window spec and returns columns, so the same code runs
on the plain per-series window and on the chunk+halo window
(:func:`tsforge.operators.sequence.apply_windows`). Frames are ROWS frames that
end at the current row; the reference's rolling frames include the current row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tsforge import SERIES

# Fixed defaults of the reference.
DEFAULT_LAGS = [1, 2, 3, 6, 12, 24, 48, 72, 168]
DEFAULT_WINDOWS = [6, 12, 24, 48, 168]
DEFAULT_STATS = ["mean", "std", "min", "max"]
DEFAULT_ALPHAS = [0.1, 0.3, 0.5, 0.7]
STAT_PERIODS = [1, 24, 168]
WEEK = 168
_QUANT = {"median": 0.5, "q25": 0.25, "q75": 0.75}
_EMA_TOL = 1e-16


def lag_columns(target: str, lags: list[int], w: WindowSpec, guard: Column | None = None) -> list[Column]:
    """``<t>_lag_<n>h``; with ``guard`` (series length) only where it holds."""
    out = []
    for n in lags:
        c = F.lag(target, n).over(w)
        if guard is not None:
            c = F.when(guard > n, c)
        out.append(c.alias(f"{target}_lag_{n}h"))
    return out


def rolling_column(target: str, window: int, stat: str, w: WindowSpec) -> Column:
    """One rolling statistic, NULL until the frame holds ``window`` non-null values."""
    frame = w.rowsBetween(-(window - 1), 0)
    x = F.col(target)
    if stat == "mean":
        agg = F.avg(x)
    elif stat == "std":
        agg = F.stddev_samp(x)
    elif stat == "min":
        agg = F.min(x)
    elif stat == "max":
        agg = F.max(x)
    elif stat in _QUANT:
        agg = F.percentile(x, _QUANT[stat])
    else:
        raise ValueError(f"unknown rolling statistic {stat!r}")
    return F.when(F.count(x).over(frame) == window, agg.over(frame))


def rolling_columns(target: str, windows: list[int], stats: list[str], w: WindowSpec) -> list[Column]:
    """``<t>_rolling_<w>h_<stat>``."""
    return [rolling_column(target, n, s, w).alias(f"{target}_rolling_{n}h_{s}") for n in windows for s in stats]


def time_rolling_columns(target: str, hours: list[int], stats: list[str], w: WindowSpec) -> list[Column]:
    """W2-W5 by time: statistics of the values of the last ``h`` hours, this one included, however many there are.
    ``w`` orders by epoch seconds (:func:`tsforge.operators.sequence.apply_time_windows`)."""
    aggs = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}
    return [aggs[s](target).over(w.rangeBetween(-(h * 3600 - 1), 0)).alias(f"{target}_last_{h}h_{s}") for h in hours for s in stats]


def ema_span(alpha: float) -> int:
    """Rows after which the weight ``(1-alpha)^k`` drops below 1e-16 (350 for 0.1)."""
    return int(math.ceil(math.log(_EMA_TOL) / math.log(1.0 - alpha)))


def ema_columns(target: str, alphas: list[float], w: WindowSpec, names: list[str] | None = None) -> list[Column]:
    """W9 at rows with a value (NULL elsewhere): ``sum (1-a)^i x / sum (1-a)^i`` over non-null x.

    The row itself has weight 1, so leaving out weights below 1e-16 changes nothing a double can hold. A row
    without a value has the mean of the last row with one, however far back: :func:`ema_frame` carries it on.
    The plain form, for any window: one ``collect_list`` over the widest frame feeds all alphas (each slices its own
    tail); structs keep NULL entries, so positions (and decay) stay exact. Series frames take :func:`ema_by_blocks`.
    """
    if not alphas:
        return []
    kmax = max(ema_span(a) for a in alphas)
    hist = F.collect_list(F.struct(F.col(target).alias("v"))).over(w.rowsBetween(-kmax, 0))
    out = []
    for i, a in enumerate(alphas):
        k = ema_span(a)
        tail = F.slice(hist, F.greatest(F.lit(1), F.size(hist) - k), k + 1)
        decay = F.lit(1.0 - a)
        # Horner form in time order: n <- n*(1-a) + x, d <- d*(1-a) + 1 (x non-null only).
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
        acc = F.aggregate(
            tail, zero,
            lambda s, e: F.struct((s["n"] * decay + F.coalesce(e["v"], F.lit(0.0))).alias("n"),
                                  (s["d"] * decay + F.when(e["v"].isNotNull(), 1.0).otherwise(0.0)).alias("d")),
            lambda s: F.when(s["d"] > 0, s["n"] / s["d"]))
        out.append(F.when(F.col(target).isNotNull(), acc).alias(names[i] if names else f"{target}_ema_alpha_{a}"))
    return out


def ema_block(alphas: list[float]) -> int:
    """Rows of a block: as many as keep the weights of one block within a double's range."""
    steepest = max(-math.log10(1.0 - a) for a in alphas)
    return max(1, min(4096, int(250 / steepest)))


def ema_by_blocks(df: DataFrame, target: str, alphas: list[float], names: list[str], block: int | None = None) -> DataFrame:
    """W9 at rows with a value, as a linear recurrence: ``n <- (1-a) n + x`` and ``d <- (1-a) d + 1``, at a row's cost
    that does not depend on alpha.

    ``df`` has row positions. A block of rows is an affine map of the state that comes in: a multiplier ((1-a) to the
    block's length) and the sum and weight of its own values. The maps of the blocks that still weigh something are
    composed per block in a carry table of one row per (series, block); its row is the block's position -1. Inside a
    block the state is a running sum of values scaled by their position, scaled back.
    """
    from tsforge.operators.sequence import IDX
    if not alphas:
        return df
    size = block or ema_block(alphas)
    decays = [1.0 - a for a in alphas]
    x = F.col(f"`{target}`")
    power = lambda d, e: F.pow(F.lit(d), e)
    at = F.col(IDX) % size
    keys = [F.col(SERIES).alias(SERIES), F.floor(F.col(IDX) / size).cast("long").alias("_block")]
    own = []
    for i, d in enumerate(decays):
        own += [F.sum(x * power(d, size - 1 - at)).alias(f"_n{i}"), F.sum(power(d, size - 1 - at)).alias(f"_d{i}")]
    states = df.where(x.isNotNull()).groupBy(*keys).agg(*own)
    reach = [math.ceil(ema_span(a) / size) for a in alphas]
    parts = [F.when(F.col("_k") <= m, F.col(f"_{c}{i}") * power(d ** size, F.col("_k") - 1)).otherwise(0.0).alias(f"_{c}{i}")
             for i, (d, m) in enumerate(zip(decays, reach)) for c in "nd"]
    carry = states.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(max(reach))))).select(
        SERIES, (F.col("_block") + F.col("_k")).alias("_block"), *parts).groupBy(SERIES, "_block").agg(
        *[F.sum(f"_{c}{i}").alias(f"_{c}{i}") for i in range(len(alphas)) for c in "nd"])
    came = [f"_{c}{i}" for i in range(len(alphas)) for c in "nd"]
    rows = df.select("*", keys[1], at.alias("_at"), F.lit(False).alias("_carry"), *[F.lit(None).cast("double").alias(c) for c in came])
    heads = carry.select(*[F.col(SERIES) if c == SERIES else ((F.col("_block") * size - 1) if c == IDX else F.lit(None)).cast(df.schema[c].dataType).alias(c)
                           for c in df.columns], "_block", F.lit(-1).cast("long").alias("_at"), F.lit(True).alias("_carry"), *came)
    w = Window.partitionBy(SERIES, "_block").orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for i, (d, name) in enumerate(zip(decays, names)):
        scaled = power(d, -F.col("_at"))
        n = F.sum(F.when(F.col("_carry"), F.col(f"_n{i}")).otherwise(x) * scaled).over(w)
        weight = F.sum(F.when(F.col("_carry"), F.col(f"_d{i}")).when(x.isNotNull(), 1.0) * scaled).over(w)
        out.append(F.when(x.isNotNull(), n / weight).alias(name))
    return rows.unionByName(heads).select("*", *out).where(~F.col("_carry")).drop("_block", "_at", "_carry", *came)


def ema_frame(df: DataFrame, target: str, alphas: list[float], chunk_rows: int | None) -> DataFrame:
    """W9 on a series frame: ``<t>_ema_alpha_<a>`` for every row."""
    from tsforge.operators.sequence import IDX, apply_windows, carry_forward, with_row_index
    held, names = [f"_ema{i}" for i in range(len(alphas))], [f"{target}_ema_alpha_{a}" for a in alphas]
    if chunk_rows is None:
        return carry_forward(apply_windows(df, lambda w: ema_columns(target, alphas, w, held), halo_for(alphas=alphas), None), held, names, None)
    out = ema_by_blocks(df if IDX in df.columns else with_row_index(df), target, alphas, held)
    out = carry_forward(out, held, names, chunk_rows)
    return out if IDX in df.columns else out.drop(IDX)


def statistical_columns(target: str, w: WindowSpec, n_rows: Column, padded: str | None = None) -> list[Column]:
    """W10-W12. ``n_rows`` is the series length (columns are NULL where the reference omits them).

    Percent changes use the forward-padded series ``padded`` (pandas pads before
    ``pct_change``); division by zero gives NULL.
    """
    x = F.col(target)
    pad = padded or target
    out = [F.when(n_rows >= WEEK, F.try_divide(x, F.lag(target, WEEK).over(w)) - 1)
           .alias(f"{target}_vs_same_hour_last_week")]
    for p in STAT_PERIODS:
        out.append(F.when(n_rows > p, F.try_divide(F.col(pad), F.lag(pad, p).over(w)) - 1)
                   .alias(f"{target}_pct_change_{p}h"))
    mean = rolling_column(target, WEEK, "mean", w)
    std = rolling_column(target, WEEK, "std", w)
    out.append(F.when(n_rows >= WEEK, F.try_divide(x - mean, std)).alias(f"{target}_zscore_{WEEK}h"))
    return out


def abs_step(target: str, w: WindowSpec) -> Column:
    """``|x_t - x_{t-1}|``."""
    return F.abs(F.col(target) - F.lag(target, 1).over(w))


def halo_for(lags=(), windows=(), alphas=(), stats: bool = False) -> int:
    """Rows a chunk must borrow from its predecessor for the given features."""
    need = [0]
    need += list(lags)
    need += [n - 1 for n in windows]
    need += [ema_span(a) for a in alphas]
    if stats:
        need += [WEEK]
    return max(need)
