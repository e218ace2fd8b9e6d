"""Forecasters per series with more structure: seasonal ARMA on differences (M11) and a trend with breaks.

Both are fitted for all series at once: sums of products come from one aggregate, and only a few dozen numbers per
series are solved in numpy. Nothing gathers a series' rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.operators import sequence
from tsforge.operators.joins import join_same
from tsforge.operators.sequence import CHUNK, DEFAULT_CHUNK_ROWS, IDX, apply_windows, with_row_index
from tsforge.plans.baselines import with_split
from tsforge.plans.models import FOURIER_PERIODS, _by_series, _linear, _valued, grouped_regression
from tsforge.session import cut_lineage

# ---------------------------------------------------------------- seasonal ARMA


def _differenced(df: DataFrame, target: str, season: int) -> DataFrame:
    """Rows with ``_d``, the (1, season) difference, the level ``_base`` it is added to, and the lags that both regressions use."""

    def diff(w):
        lag = lambda k: F.lag(target, k).over(w)
        return [(F.col(target) - lag(1) - lag(season) + lag(season + 1)).alias("_d"), (lag(1) + lag(season) - lag(season + 1)).alias("_base")]

    d = apply_windows(df, diff, season + 1)
    lags = _long_lags(season)
    return apply_windows(d, lambda w: [F.lag("_d", k).over(w).alias(f"_d{k}") for k in lags], max(lags))


def _long_lags(season: int) -> list[int]:
    return sorted({1, 2, 3, 4, season - 1, season, season + 1, season + 2, 2 * season, 2 * season + 1, 3 * season, 3 * season + 1} - {0})


def _memory(ma: list[float], season: int) -> np.ndarray:
    """How the filter's state goes on one row where the series has no news. The state is the last ``season + 1`` values
    (newest first) of the filtered series and of that series filtered once more."""
    n = season + 1
    one = np.zeros((n, n))
    for k, c in ((0, ma[0]), (season - 1, ma[1]), (season, ma[0] * ma[1])):
        one[0, k] -= c
    m = np.zeros((2 * n, 2 * n))
    m[0, :n] = m[n, :n] = m[n, n:] = one[0]
    shift = np.arange(1, n)
    m[shift, shift - 1] = m[n + shift, n + shift - 1] = 1
    return m


def _filter(news: np.ndarray, ma, season: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``news`` divided by (1 + a B)(1 + b B^season) once and twice, from the values before (see ``_memory``)."""
    n = season + 1
    a, b = float(ma[0]), float(ma[1])
    h, k = ([*state[i:i + n][::-1].tolist(), *([0.0] * len(news))] for i in (0, n))
    for t, x in enumerate(news.tolist()):
        at = t + n
        h[at] = x - a * h[at - 1] - b * h[at - season] - a * b * h[at - n]
        k[at] = h[at] - a * k[at - 1] - b * k[at - season] - a * b * k[at - n]
    return np.array(h[n:]), np.array(k[n:])


def filtered(rows: DataFrame, season: int, news: str = "_news", ma: str = "ma", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``rows`` (with positions, ``news`` and the series' moving average) with ``_h`` and ``_k``: ``news`` filtered by the
    inverse of the moving average once and twice, over the whole series.

    A chunk is an affine map of the values before it: its own from a start of zeros, and a power of ``_memory``. The maps
    are composed over the chunks of a stretch (``sequence.FAN``), then over a series' stretches; each chunk is then filtered
    from the values that really come before it.
    """
    n = season + 1
    width, fan = 2 * n, sequence.FAN
    spark_type = rows.schema[SERIES].dataType.simpleString()
    base = rows.withColumn(CHUNK, F.floor(F.col(IDX) / chunk_rows).cast("long"))
    slim = base.select(SERIES, CHUNK, IDX, F.coalesce(news, F.lit(0.0)).alias("_x"), F.col(ma).alias("_c"))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        tail = np.zeros(width)
        for at, x in zip((0, n), _filter(pdf["_x"].to_numpy(), pdf["_c"].iloc[0], season, np.zeros(width)), strict=True):
            tail[at:at + min(n, len(x))] = x[::-1][:n]
        return pd.DataFrame({SERIES: pdf[SERIES].iloc[:1], CHUNK: pdf[CHUNK].iloc[:1], "_c": [pdf["_c"].iloc[0]], "_end": [tail.tolist()]})

    ends_of = slim.groupBy(SERIES, CHUNK).applyInPandas(ends, f"{SERIES} {spark_type}, {CHUNK} long, _c array<double>, _end array<double>")

    def compose(pdf: pd.DataFrame, at: str, step: int):
        """The state before each row from zeros, the state behind the last, and the rows in order."""
        pdf = pdf.sort_values(at)
        power = np.linalg.matrix_power(_memory(pdf["_c"].iloc[0], season), step)
        state, before = np.zeros(width), []
        for own in pdf["_end"]:
            before.append(state.tolist())
            state = power @ state + np.array(own)
        return before, state, pdf

    up = F.floor(F.col(CHUNK) / fan).cast("long").alias("_up")
    kinds = f"{SERIES} {spark_type}, _up long"

    def inside(pdf):
        before, _, pdf = compose(pdf, CHUNK, chunk_rows)
        return pd.DataFrame({SERIES: pdf[SERIES], "_up": pdf["_up"], CHUNK: pdf[CHUNK], "_before": before})

    def whole(pdf):
        _, state, pdf = compose(pdf, CHUNK, chunk_rows)
        return pd.DataFrame({SERIES: pdf[SERIES].iloc[:1], "_up": pdf["_up"].iloc[:1], "_c": [pdf["_c"].iloc[0]], "_end": [state.tolist()]})

    def over(pdf):
        before, _, pdf = compose(pdf, "_up", chunk_rows * fan)
        return pd.DataFrame({SERIES: pdf[SERIES], "_up": pdf["_up"], "_far": before})

    chunks = cut_lineage(ends_of.withColumn("_up", up))
    local = chunks.groupBy(SERIES, "_up").applyInPandas(inside, f"{kinds}, {CHUNK} long, _before array<double>")
    far = chunks.groupBy(SERIES, "_up").applyInPandas(whole, f"{kinds}, _c array<double>, _end array<double>") \
        .groupBy(SERIES).applyInPandas(over, f"{kinds}, _far array<double>")
    start = join_same(local, far, [SERIES, "_up"]).select(SERIES, CHUNK, "_before", "_far")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        into = int(pdf[CHUNK].iloc[0]) % fan  # chunks of the stretch before this one
        power = np.linalg.matrix_power(_memory(pdf["_c"].iloc[0], season), into * chunk_rows)
        h, k = _filter(pdf["_x"].to_numpy(), pdf["_c"].iloc[0], season, np.array(pdf["_before"].iloc[0]) + power @ np.array(pdf["_far"].iloc[0]))
        return pd.DataFrame({SERIES: pdf[SERIES], IDX: pdf[IDX], "_h": h, "_k": k})

    out = join_same(slim, start, [SERIES, CHUNK]).groupBy(SERIES, CHUNK).applyInPandas(run, f"{SERIES} {spark_type}, {IDX} long, _h double, _k double")
    return join_same(rows, out, [SERIES, IDX])


def _within(x, most: float = 0.99):
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def _first_guess(frame: DataFrame, season: int) -> DataFrame:
    """(series, mean, theta): coefficients by two regressions (Hannan and Rissanen) - a long autoregression gives residuals,
    whose lags stand for the moving average's in the second."""
    long = [f"_d{k}" for k in _long_lags(season)]
    learn = F.col("is_test") == F.lit(False)
    first = _by_series(frame, grouped_regression(frame.where(learn), [SERIES], long, "_d", "_long"))
    lags = (1, season, season + 1)
    lagged = apply_windows(first.withColumn("_e", F.col("_d") - _linear(long, "_long")), lambda w: [F.lag("_e", k).over(w).alias(f"_e{k}") for k in lags], season + 1)
    coef = grouped_regression(lagged.where(learn), [SERIES], [*(f"_d{k}" for k in lags), *(f"_e{k}" for k in lags)], "_d")
    mean = frame.where(learn).groupBy(SERIES).agg(F.avg("_d").alias("_mean"))
    c = F.col("coef")
    return join_same(mean, coef, [SERIES]).select(SERIES, "_mean", F.array(*[_within(c[k], 0.9) for k in (0, 1, 3, 4)]).alias("theta"))


def fit_seasonal_arma(rows: DataFrame, target: str, season: int = 24, rounds: int = 3, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows with the difference ``_d`` and residuals ``_e``, (series, _mean, theta)): (1,1,1)(1,1,1,season) for each series.

    (1 - p B)(1 - P B^s)(d - mean) = (1 + q B)(1 + Q B^s) e, theta = (p, P, q, Q). Two regressions give a first guess; each
    round filters the difference by the inverse of the present moving average, which gives the residuals and their
    derivatives by lags alone, and takes a Gauss-Newton step by one more regression. The guess of least squared residuals
    is kept. ``rows`` have positions and ``is_test``; only rows that are not test rows are learnt from. Coefficients stay
    within 0.99, so the filter forgets its start.
    """
    frame = cut_lineage(_differenced(rows, target, season))
    slim = cut_lineage(frame.select(SERIES, IDX, TS, "is_test", "_d"))
    theta = cut_lineage(_first_guess(frame, season))
    lags = (1, season, season + 1)
    tried = []

    def with_residuals(theta):
        known = join_same(slim, theta, [SERIES]).withColumn("_news", F.col("_d") - F.col("_mean")).withColumn("ma", F.slice("theta", 3, 2))
        both = filtered(known, season, chunk_rows=chunk_rows)
        p, big = F.col("theta")[0], F.col("theta")[1]
        left = lambda c, w: F.col(c) - p * F.coalesce(F.lag(c, 1).over(w), F.lit(0.0)) - big * F.coalesce(F.lag(c, season).over(w), F.lit(0.0)) \
            + p * big * F.coalesce(F.lag(c, season + 1).over(w), F.lit(0.0))
        return apply_windows(both, lambda w: [left("_h", w).alias("_e"), left("_k", w).alias("_g"), *[F.lag("_h", k).over(w).alias(f"_h{k}") for k in lags]], season + 1)

    for _ in range(rounds + 1):
        known = cut_lineage(with_residuals(theta))
        learn = known.where("NOT is_test AND _d IS NOT NULL")
        tried.append(learn.groupBy(SERIES, "_mean", "theta").agg(F.sum(F.col("_e") ** 2).alias("_sse")))
        if len(tried) > rounds:
            break
        lagged = apply_windows(known, lambda w: [F.lag("_g", k).over(w).alias(f"_g{k}") for k in lags], season + 1).where("NOT is_test AND _d IS NOT NULL")
        t = [F.col("theta")[k] for k in range(4)]
        s1 = season + 1
        slopes = lagged.select(SERIES, "_e", (F.col("_h1") - t[1] * F.col(f"_h{s1}")).alias("_s0"), (F.col(f"_h{season}") - t[0] * F.col(f"_h{s1}")).alias("_s1"),
                               (F.col("_g1") + t[3] * F.col(f"_g{s1}")).alias("_s2"), (F.col(f"_g{season}") + t[2] * F.col(f"_g{s1}")).alias("_s3"))
        step = grouped_regression(slopes, [SERIES], [f"_s{k}" for k in range(4)], "_e", "_step")
        theta = cut_lineage(join_same(theta, step, [SERIES]).select(SERIES, "_mean", F.transform("theta", lambda x, k: _within(x + F.col("_step")[k])).alias("theta")))
    every = reduce(DataFrame.unionByName, tried).where("_sse IS NOT NULL AND NOT isnan(_sse)")
    best = cut_lineage(every.groupBy(SERIES).agg(F.min_by(F.struct("_mean", "theta"), "_sse").alias("b")).select(SERIES, "b.*"))
    e = with_residuals(best).select(SERIES, IDX, "_e")
    return cut_lineage(join_same(frame, e, [SERIES, IDX])), best


def _next_difference(d, e, season: int):
    """The expected next difference from past ones and past residuals (functions of the lag)."""
    p, big, q, big_q = (F.col("theta")[k] for k in range(4))
    m = F.col("_mean")
    return m + p * (d(1) - m) + big * (d(season) - m) - p * big * (d(season + 1) - m) + q * e(1) + big_q * e(season) + q * big_q * e(season + 1)


def seasonal_arma(df: DataFrame, target: str, season: int = 24, test_size: float = 0.2) -> DataFrame:
    """One-step forecasts of the test rows by a seasonal ARMA model of the differenced series; long predictions."""
    rows, theta = fit_seasonal_arma(with_split(_valued(df, target), test_size), target, season)
    lagged = apply_windows(rows, lambda w: [F.lag("_e", k).over(w).alias(f"_e{k}") for k in (1, season, season + 1)], season + 1)
    ahead = _next_difference(lambda k: F.col(f"_d{k}"), lambda k: F.col(f"_e{k}"), season)
    return _by_series(lagged.where("is_test"), theta).select(
        SERIES, TS, F.lit("seasonal_arma").alias("model"), F.col(target).alias("y_true"), (F.col("_base") + ahead).alias("y_pred"))


def seasonal_arma_forecast(df: DataFrame, target: str, horizon: int = 24, season: int = 24, step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """``horizon`` steps past each series' end from a fit on the whole series; forecasts and expected residuals (0)
    feed the next steps. A series' state is its last 2 * season + 2 values and residuals, folded step by step in SQL."""
    rows, theta = fit_seasonal_arma(with_row_index(_valued(df, target)).withColumn("is_test", F.lit(False)), target, season)
    need = 2 * season + 2
    last = rows.groupBy(SERIES).agg(F.max(IDX).alias("_last"), F.max(TS).alias("_stop"))
    state = _by_series(rows, last).where(F.col(IDX) > F.col("_last") - need).groupBy(SERIES, "_stop").agg(
        F.array_sort(F.collect_list(F.struct(IDX, F.col(target).cast("double").alias("y"), F.coalesce("_e", F.lit(0.0)).alias("e")))).alias("_s")).where(F.size("_s") == need)
    state = state.select(SERIES, "_stop", F.struct(F.transform("_s", lambda x: x["y"]).alias("y"), F.transform("_s", lambda x: x["e"]).alias("e")).alias("_s"))

    def step_on(s, _):
        at = lambda k: F.element_at(s["y"], -k)
        d = lambda k: at(k) - at(k + 1) - at(k + season) + at(k + season + 1)
        new = at(1) + at(season) - at(season + 1) + _next_difference(d, lambda k: F.element_at(s["e"], -k), season)
        return F.struct(F.concat(s["y"], F.array(new)).alias("y"), F.concat(s["e"], F.array(F.lit(0.0))).alias("e"))

    paths = _by_series(state, theta).withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_s"), step_on))
    return paths.select(SERIES, "_stop", F.posexplode(F.slice("_s.y", -horizon, horizon)).alias("_at", "y_pred")).select(
        SERIES, (F.col("_at") + 1).cast("long").alias("step"), (F.col("_stop") + F.expr(step) * (F.col("_at") + 1)).alias(TS),
        F.lit("seasonal_arma").alias("model"), "y_pred")


# ---------------------------------------------------------------- trend with breaks
#: Possible breaks, the share of the training span they lie in, and the prior scale of a change of slope.
BREAKS, BREAK_RANGE, BREAK_SCALE = 25, 0.8, 0.05


def _design(hours: np.ndarray, t0: float, t1: float, harmonics: int, breaks: int) -> np.ndarray:
    """Columns: constant, trend over the span, sine and cosine terms (0 where the period is longer than the span), then one hinge a break."""
    span = t1 - t0
    t = (hours - t0) / span if span > 0 else np.zeros(len(hours))
    cols = [np.ones(len(t)), t]
    for p in FOURIER_PERIODS:
        for k in range(1, harmonics + 1):
            a = 2 * math.pi * k * hours / p
            cols += [np.sin(a), np.cos(a)] if span >= p else [np.zeros(len(t))] * 2
    return np.column_stack(cols + [np.maximum(0, t - BREAK_RANGE * (j + 1) / (breaks + 1)) for j in range(breaks)])


def _lasso(gram: np.ndarray, moment: np.ndarray, free: int, penalty: float, tol: float = 1e-10, sweeps: int = 20_000) -> np.ndarray:
    """Coefficients of least squares with ``penalty`` on the absolute values of all but the first ``free`` of them, by
    coordinate descent; the free ones are eliminated exactly."""
    inverse = np.linalg.pinv(gram[:free, :free], rcond=1e-12, hermitian=True)
    g = gram[free:, free:] - gram[free:, :free] @ inverse @ gram[:free, free:]
    b = moment[free:] - gram[free:, :free] @ inverse @ moment[:free]
    w = np.zeros(len(b))
    left = b.copy()  # b - g w
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(w)):
            if g[j, j] <= 1e-12 * gram[free + j, free + j]:
                continue
            rho = left[j] + g[j, j] * w[j]
            new = math.copysign(max(abs(rho) - penalty, 0.0), rho) / g[j, j]
            if new != w[j]:
                left -= g[:, j] * (new - w[j])
                largest = max(largest, abs(new - w[j]))
                w[j] = new
        if largest < tol:
            break
    return np.append(inverse @ (moment[:free] - gram[:free, free:] @ w), w)


def fit_trend(train: DataFrame, target: str, harmonics: int = 3, multiplicative: bool = True, breaks: int = BREAKS, scale: float = BREAK_SCALE) -> DataFrame:
    """Per series: ``_t0``, ``_t1`` (training span in hours), ``_log`` (fitted on logarithms), ``coef`` in the order of ``_design``.

    Each task sums its rows' products into one matrix per series; a series' matrices are added up and solved. The noise
    variance that weighs the penalty is that of the fit without one, so ``scale`` means the same for every series.
    """
    hours = F.unix_micros(TS) / 3.6e9
    span = train.groupBy(SERIES).agg(F.min(hours).alias("_t0"), F.max(hours).alias("_t1"), (F.lit(multiplicative) & (F.min(target) > 0)).alias("_log"))
    y = F.when(F.col("_log"), F.log(F.when(F.col(target) > 0, F.col(target)))).otherwise(F.col(target)).cast("double")
    rows = join_same(train, span, [SERIES]).select(SERIES, hours.alias("_h"), "_t0", "_t1", "_log", y.alias("_y")).where("_y IS NOT NULL AND _h IS NOT NULL")
    kind = train.schema[SERIES].dataType.simpleString()
    free = 2 + 2 * harmonics * len(FOURIER_PERIODS)
    width = free + breaks

    def products(batches):
        for b in batches:
            pdf = b.to_pandas()
            out = []
            for (series, t0, t1, log), part in pdf.groupby([SERIES, "_t0", "_t1", "_log"], dropna=False):
                x = np.column_stack([_design(part["_h"].to_numpy(), t0, t1, harmonics, breaks), part["_y"].to_numpy()])
                out.append((None if series != series or series is None else series, t0, t1, bool(log), len(part), (x.T @ x).tobytes()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(SERIES).type, pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)],
                                                 names=[SERIES, "_t0", "_t1", "_log", "_n", "_p"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p).reshape(width + 1, width + 1) for p in pdf["_p"])
        n, top = int(pdf["_n"].sum()), math.sqrt(max(total[width, width], 1e-300) / max(1, pdf["_n"].sum()))
        gram, moment, square = total[:width, :width], total[:width, width] / top, total[width, width] / top ** 2
        plain = np.linalg.lstsq(gram, moment, rcond=1e-10)[0]
        noise = max(0.0, square - 2 * plain @ moment + plain @ gram @ plain) / max(1, n - width)
        coef = _lasso(gram, moment, free, noise / scale) * top
        first = pdf.iloc[0]
        return pd.DataFrame({SERIES: [first[SERIES]], "_t0": [first["_t0"]], "_t1": [first["_t1"]], "_log": [first["_log"]], "coef": [coef.tolist()]})

    return rows.mapInArrow(products, f"{SERIES} {kind}, _t0 double, _t1 double, _log boolean, _n long, _p binary") \
        .groupBy(SERIES).applyInPandas(solve, f"{SERIES} {kind}, _t0 double, _t1 double, _log boolean, coef array<double>")


def _trend_value(harmonics: int, breaks: int):
    """The fitted curve at a row's time stamp, as an expression."""
    h = F.unix_micros(TS) / 3.6e9
    span, c = F.col("_t1") - F.col("_t0"), F.col("coef")
    t = F.when(span > 0, (h - F.col("_t0")) / span).otherwise(0.0)
    terms, at = [c[0], c[1] * t], 2
    for p in FOURIER_PERIODS:
        for k in range(1, harmonics + 1):
            for f in (F.sin, F.cos):
                terms.append(F.when(span >= p, c[at] * f(2 * math.pi * k * h / p)).otherwise(0.0))
                at += 1
    terms += [c[at + j] * F.greatest(F.lit(0.0), t - F.lit(BREAK_RANGE * (j + 1) / (breaks + 1))) for j in range(breaks)]
    y = reduce(lambda a, b: a + b, terms)
    return F.when(F.col("_log"), F.exp(y)).otherwise(y)


def trend_regression(df: DataFrame, target: str, harmonics: int = 3, multiplicative: bool = True, test_size: float = 0.2, breaks: int = BREAKS,
                     scale: float = BREAK_SCALE) -> DataFrame:
    """Trend with breaks plus daily, weekly and yearly seasons, fitted on the training rows; scores of the test rows."""
    split = with_split(_valued(df, target), test_size)
    fitted = fit_trend(split.where("NOT is_test"), target, harmonics, multiplicative, breaks, scale)
    return _by_series(split.where("is_test"), fitted).select(SERIES, TS, F.lit("trend_breaks").alias("model"), F.col(target).alias("y_true"),
                                                             _trend_value(harmonics, breaks).alias("y_pred"))


def trend_forecast(df: DataFrame, target: str, horizon: int = 24, harmonics: int = 3, multiplicative: bool = True, step: str = "INTERVAL 1 HOUR",
                   breaks: int = BREAKS, scale: float = BREAK_SCALE) -> DataFrame:
    """``horizon`` rows past each series' end from a fit on the whole series; the last slope goes on."""
    rows = df.where(F.col(target).isNotNull())
    fitted = fit_trend(rows, target, harmonics, multiplicative, breaks, scale)
    ahead = rows.groupBy(SERIES).agg(F.max(TS).alias("_stop")).select(SERIES, "_stop", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")) \
        .select(SERIES, F.col("step").cast("long").alias("step"), (F.col("_stop") + F.expr(step) * F.col("step")).alias(TS))
    return _by_series(ahead, fitted).select(SERIES, "step", TS, F.lit("trend_breaks").alias("model"), _trend_value(harmonics, breaks).alias("y_pred"))


def trend_breaks(fitted: DataFrame, breaks: int = BREAKS) -> DataFrame:
    """(series, ts, change): where the fitted slope changes, and by how much over the training span."""
    first = F.size("coef") - breaks
    at = fitted.select(SERIES, "_t0", "_t1", F.posexplode(F.slice("coef", first + 1, breaks)).alias("_j", "change")).where("change <> 0")
    when = F.col("_t0") + (F.col("_t1") - F.col("_t0")) * BREAK_RANGE * (F.col("_j") + 1) / (breaks + 1)
    return at.select(SERIES, F.timestamp_micros((when * 3.6e9).cast("long")).alias(TS), "change")
