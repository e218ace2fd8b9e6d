"""Registered queries: one Spark job per operator of the inventory, each with an
equivalent DuckDB SQL oracle where the operator is SQL-expressible.

Every query reads the supplied tables (or series Spark derives from them) in
full; ``present`` only fixes output precision and types at the edge.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.functions import windows as W
from tsforge.operators.sequence import DEFAULT_CHUNK_ROWS, IDX
from tsforge.plans import sqlfrag as Q
from tsforge.plans.present import present
from tsforge.sources import series as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir).drop(IDX))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


HOURLY = Q.spine_cte("hourly", Q.EVENTS_BY_TYPE)
FILLED = HOURLY + "," + Q.interp_cte("filled", "hourly", "value")


def _hourly_filled(spark, sf_dir):
    """Hourly spine per event type, interpolated + edge filled; keeps the row index for later windows."""
    from tsforge.operators.nulls import handle_missing
    return handle_missing(S.hourly_by_type(spark, sf_dir, keep_index=True), "interpolate", ["value"], keep_index=True)


# ---------------------------------------------------------------- resampling
@register("hourly_by_type", f"WITH {HOURLY} SELECT series, ts, {Q.r4('value', 'value')} FROM hourly")
def q_hourly_by_type(spark, sf_dir):
    """R1 + R3: hourly mean per event type on a complete spine (empty hours NULL)."""
    return S.hourly_by_type(spark, sf_dir)


_ALL = Q.spine_cte("h_all", "SELECT 'all' AS series, ts, value AS v FROM events")


@register("hourly_all", f"WITH {_ALL} SELECT series, ts, {Q.r4('value', 'value')} FROM h_all")
def q_hourly_all(spark, sf_dir):
    """Hourly mean over all events, one series."""
    return S.hourly_all(spark, sf_dir)


_DO = Q.spine_cte("d_o", "SELECT 'orders' AS series, o_orderdate AS ts, o_totalprice AS v FROM orders",
                  freq="day", how="sum", fill_zero=True)


@register("daily_orders", f"WITH {_DO} SELECT series, ts, {Q.r4('value', 'value')} FROM d_o")
def q_daily_orders(spark, sf_dir):
    """R2: daily sum of order prices; empty days sum to 0."""
    return S.daily_orders(spark, sf_dir)


_DL = Q.spine_cte("d_l", "SELECT 'lineitem' AS series, l_shipdate AS ts, l_extendedprice AS v FROM lineitem",
                  freq="day", how="sum", fill_zero=True)


@register("daily_lineitem", f"WITH {_DL} SELECT series, ts, {Q.r4('value', 'value')} FROM d_l")
def q_daily_lineitem(spark, sf_dir):
    """R2: daily sum of extended prices by ship date."""
    return S.daily_lineitem(spark, sf_dir)


# ---------------------------------------------------------------- null handling
@register("null_counts", f"""WITH {HOURLY}
SELECT CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS value_nulls,
       CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS total_nulls FROM hourly""")
def q_null_counts(spark, sf_dir):
    """Null counts of the hourly spine."""
    from tsforge.operators.nulls import null_counts
    return null_counts(S.hourly_by_type(spark, sf_dir), ["value"])


@register("interpolate_fill", f"WITH {FILLED} SELECT series, ts, {Q.r4('value', 'value')} FROM filled")
def q_interpolate_fill(spark, sf_dir):
    """P2 + P6: linear interpolation by position, then edge fill, per series (chunked)."""
    return _hourly_filled(spark, sf_dir)


_WS = "PARTITION BY series ORDER BY ts"


@register("forward_fill", f"""WITH {HOURLY}
SELECT series, ts, {Q.r4(f"coalesce(last_value(value IGNORE NULLS) OVER ({_WS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER ({_WS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", 'value')}
FROM hourly""")
def q_forward_fill(spark, sf_dir):
    """P3 + P6: forward fill, then edge fill."""
    from tsforge.operators.nulls import handle_missing
    return handle_missing(S.hourly_by_type(spark, sf_dir, keep_index=True), "forward_fill", ["value"])


@register("backward_fill", f"""WITH {HOURLY}
SELECT series, ts, {Q.r4(f"coalesce(first_value(value IGNORE NULLS) OVER ({_WS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(value IGNORE NULLS) OVER ({_WS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", 'value')}
FROM hourly""")
def q_backward_fill(spark, sf_dir):
    """P4 + P6: backward fill, then the forward edge fill for trailing nulls."""
    from tsforge.operators.nulls import handle_missing
    return handle_missing(S.hourly_by_type(spark, sf_dir, keep_index=True), "backward_fill", ["value"])


@register("drop_missing", f"WITH {HOURLY} SELECT series, ts, {Q.r4('value', 'value')} FROM hourly WHERE value IS NOT NULL")
def q_drop_missing(spark, sf_dir):
    """P5: rows with a null measure removed."""
    from tsforge.operators.nulls import handle_missing
    return handle_missing(S.hourly_by_type(spark, sf_dir), "drop", ["value"])


# ---------------------------------------------------------------- window features
def _lags_sql(col, lags):
    return ", ".join(Q.r4(f"lag({col}, {n}) OVER ({_WS})", f"{col}_lag_{n}h") for n in lags)


def _roll_sql(col, windows, stats):
    return ", ".join(Q.r4(Q.rolling_sql(col, n, s), f"{col}_rolling_{n}h_{s}") for n in windows for s in stats)


FLAGSHIP_SQL = f"""WITH {FILLED}
SELECT series, ts, {Q.r4('value', 'value')}, {_lags_sql('value', [1, 24])}, {_roll_sql('value', [24], ['mean'])}
FROM filled"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> hourly spine per type -> interpolation + edge fill -> lags 1, 24 and 24-row mean."""
    from tsforge.operators.sequence import apply_windows
    filled = _hourly_filled(spark, sf_dir)
    return apply_windows(filled, lambda w: W.lag_columns("value", [1, 24], w)
                         + W.rolling_columns("value", [24], ["mean"], w), halo=24).drop(IDX)


register("flagship_lags_rolling", FLAGSHIP_SQL)(flagship)


@register("lag_features", f"WITH {FILLED} SELECT series, ts, {Q.r4('value', 'value')}, {_lags_sql('value', W.DEFAULT_LAGS)} FROM filled")
def q_lag_features(spark, sf_dir):
    """Lags 1..168 rows per series (chunk+halo windows)."""
    from tsforge.operators.sequence import apply_windows
    return apply_windows(_hourly_filled(spark, sf_dir), lambda w: W.lag_columns("value", W.DEFAULT_LAGS, w), halo=168)


@register("rolling_features", f"""WITH {HOURLY} SELECT series, ts, {Q.r4('value', 'value')},
{_roll_sql('value', W.DEFAULT_WINDOWS, W.DEFAULT_STATS)} FROM hourly""")
def q_rolling_features(spark, sf_dir):
    """Rolling mean/std/min/max over 6..168 rows on the gappy spine (null guard: full frames only)."""
    from tsforge.operators.sequence import apply_windows
    return apply_windows(S.hourly_by_type(spark, sf_dir, keep_index=True),
                         lambda w: W.rolling_columns("value", W.DEFAULT_WINDOWS, W.DEFAULT_STATS, w), halo=167)


@register("rolling_features_filled", f"""WITH {FILLED} SELECT series, ts, {Q.r4('value', 'value')},
{_roll_sql('value', W.DEFAULT_WINDOWS, W.DEFAULT_STATS)} FROM filled""")
def q_rolling_features_filled(spark, sf_dir):
    """W2-W5 on the filled series, where every frame fills up (the 168-row ones too)."""
    from tsforge.operators.sequence import apply_windows
    return apply_windows(_hourly_filled(spark, sf_dir),
                         lambda w: W.rolling_columns("value", W.DEFAULT_WINDOWS, W.DEFAULT_STATS, w), halo=167)


@register("rolling_quantiles", f"""WITH {FILLED} SELECT series, ts, {Q.r4('value', 'value')},
{_roll_sql('value', [6, 24, 168], ['median', 'q25', 'q75'])} FROM filled""")
def q_rolling_quantiles(spark, sf_dir):
    """Rolling median / q25 / q75 (exact, interpolated)."""
    from tsforge.operators.sequence import apply_windows
    return apply_windows(_hourly_filled(spark, sf_dir),
                         lambda w: W.rolling_columns("value", [6, 24, 168], ["median", "q25", "q75"], w), halo=167)


def _ema_sql(src: str, col: str, alphas) -> str:
    """The weighted mean over the whole history at rows with a value; other rows have the last one before them."""
    parts = []
    for a in alphas:
        d, name = 1.0 - a, f"ema_{str(a).replace('.', '_')}"
        parts.append(f"""
{name}_at AS (
  SELECT x.series, x.ts, sum(pow({d}, x._i - y._i) * y.{col}) / sum(pow({d}, x._i - y._i)) AS e
  FROM {src}_p x JOIN {src}_p y ON x.series = y.series AND y._i <= x._i
  WHERE x.{col} IS NOT NULL AND y.{col} IS NOT NULL GROUP BY x.series, x.ts),
{name} AS (
  SELECT p.series, p.ts, last_value(q.e IGNORE NULLS) OVER (PARTITION BY p.series ORDER BY p.ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
  FROM {src}_p p LEFT JOIN {name}_at q ON p.series = q.series AND p.ts = q.ts)""")
    return ",".join(parts)


def _ema_query(src_cte: str, src: str, col: str, alphas) -> str:
    body = _ema_sql(src, col, alphas)
    sel = ", ".join(Q.r4(f"ema_{str(a).replace('.', '_')}.e", f"{col}_ema_alpha_{a}") for a in alphas)
    joins = " ".join(f"JOIN ema_{str(a).replace('.', '_')} USING (series, ts)" for a in alphas)
    return f"""WITH {src_cte},
{src}_p AS (SELECT *, row_number() OVER ({_WS}) AS _i FROM {src}),
{body}
SELECT series, ts, {Q.r4(f'{src}_p.{col}', col)}, {sel} FROM {src}_p {joins}"""


@register("ema_features", _ema_query(HOURLY, "hourly", "value", W.DEFAULT_ALPHAS))
def q_ema_features(spark, sf_dir):
    """Adjusted EWMA for alphas 0.1..0.7 on the gappy spine (nulls keep their position)."""
    return W.ema_frame(S.hourly_by_type(spark, sf_dir, keep_index=True), "value", W.DEFAULT_ALPHAS, DEFAULT_CHUNK_ROWS)


_MONTHLY = Q.spine_cte("mo", "SELECT 'orders' AS series, date_trunc('month', o_orderdate) AS ts, sum(o_totalprice) AS v FROM orders GROUP BY 2")


@register("ema_features_sparse", _ema_query(_MONTHLY, "mo", "value", W.DEFAULT_ALPHAS))
def q_ema_features_sparse(spark, sf_dir):
    """W9 where gaps are longer than any weight lasts: monthly order totals on an hourly spine."""
    return W.ema_frame(S.monthly_orders_hourly(spark, sf_dir, keep_index=True), "value", W.DEFAULT_ALPHAS, DEFAULT_CHUNK_ROWS)


def _stat_sql(src: str, col: str) -> str:
    pad = f"{src}_pad"
    return f"""{pad} AS (SELECT *, last_value({col} IGNORE NULLS) OVER ({_WS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _pad,
  count(*) OVER (PARTITION BY series) AS _n FROM {src})
SELECT series, ts, {Q.r4(col, col)},
  {Q.r4(f"CASE WHEN _n >= 168 THEN {col} / nullif(lag({col}, 168) OVER ({_WS}), 0) - 1 END", f"{col}_vs_same_hour_last_week")},
  {", ".join(Q.r4(f"CASE WHEN _n > {p} THEN _pad / nullif(lag(_pad, {p}) OVER ({_WS}), 0) - 1 END", f"{col}_pct_change_{p}h") for p in W.STAT_PERIODS)},
  {Q.r4(f"CASE WHEN _n >= 168 THEN ({col} - ({Q.rolling_sql(col, 168, 'mean')})) / nullif({Q.rolling_sql(col, 168, 'std')}, 0) END", f"{col}_zscore_168h")}
FROM {pad}"""


@register("statistical_features", f"WITH {HOURLY}, {_stat_sql('hourly', 'value')}")
def q_statistical_features(spark, sf_dir):
    """Week-over-week ratio, padded pct changes (1, 24, 168), 168-row z-score."""
    from tsforge.plans.features import FeatureConfig, window_features
    cfg = FeatureConfig(target="value", lags=[], windows=[], stats=[], alphas=[], statistical=True)
    return window_features(S.hourly_by_type(spark, sf_dir, keep_index=True), cfg)


@register("statistical_features_filled", f"WITH {FILLED}, {_stat_sql('filled', 'value')}")
def q_statistical_features_filled(spark, sf_dir):
    """W10-W12 on the filled series (the 168-row z-score has values there)."""
    from tsforge.plans.features import FeatureConfig, window_features
    cfg = FeatureConfig(target="value", lags=[], windows=[], stats=[], alphas=[], statistical=True)
    return window_features(_hourly_filled(spark, sf_dir), cfg)


# ---------------------------------------------------------------- calendar projections
def _with(fn_cols, base):
    return base.select("*", *fn_cols)


@register("time_features", f"WITH {_DL} SELECT series, ts, {Q.r4('value', 'value')}, {', '.join(Q.time_cols_sql())} FROM d_l")
def q_time_features(spark, sf_dir):
    """F1, F2, F4-F8 on 7 years of daily line-item revenue (leap days, year ends)."""
    from tsforge.functions.calendar import time_feature_columns
    return _with(time_feature_columns(TS), S.daily_lineitem(spark, sf_dir))


@register("calendar_features", f"WITH {_ALL} SELECT series, ts, {Q.r4('value', 'value')}, {', '.join(Q.calendar_cols_sql())} FROM h_all")
def q_calendar_features(spark, sf_dir):
    """F3, F9, F11-F14 on the hourly series (all hour-of-day flags)."""
    from tsforge.functions.calendar import calendar_feature_columns
    return _with(calendar_feature_columns(TS), S.hourly_all(spark, sf_dir))


@register("calendar_features_daily", f"WITH {_DL} SELECT series, ts, {', '.join(Q.calendar_cols_sql())} FROM d_l")
def q_calendar_features_daily(spark, sf_dir):
    """F3, F9, F11, F14 across 7 years (ISO weeks 52/53, all seasons)."""
    from tsforge.functions.calendar import calendar_feature_columns
    return S.daily_lineitem(spark, sf_dir).select(SERIES, TS, *calendar_feature_columns(TS))


_PERIOD_SQL = """CAST(day(ts) = 1 AS BIGINT) AS is_month_start,
  CAST(CAST(ts AS DATE) = last_day(ts) AS BIGINT) AS is_month_end,
  CAST(CAST(ts AS DATE) = CAST(date_trunc('quarter', ts) AS DATE) AS BIGINT) AS is_quarter_start,
  CAST(CAST(ts AS DATE) = CAST(date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS BIGINT) AS is_quarter_end,
  CAST(month(ts) = 1 AND day(ts) = 1 AS BIGINT) AS is_year_start,
  CAST(month(ts) = 12 AND day(ts) = 31 AS BIGINT) AS is_year_end,
  dayname(ts) AS day_name, monthname(ts) AS month_name"""


@register("period_flags", f"WITH {_DL} SELECT series, ts, {_PERIOD_SQL} FROM d_l")
def q_period_flags(spark, sf_dir):
    """F10 + F28: month/quarter/year start/end flags and day/month names."""
    from tsforge.functions.calendar import name_columns, period_flag_columns
    return S.daily_lineitem(spark, sf_dir).select(SERIES, TS, *period_flag_columns(TS), *name_columns(TS))


@register("utility_time_block", f"""WITH {_DL} SELECT series, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, {', '.join(Q.time_cols_sql())},
  CAST(weekofyear(ts) AS BIGINT) AS week_of_year, CAST(isodow(ts) < 6 AS BIGINT) AS is_business_day,
  {_PERIOD_SQL.split('dayname')[0].rstrip().rstrip(',')} FROM d_l""")
def q_utility_time_block(spark, sf_dir):
    """F31 and the utility time block: ISO text, time columns, ISO week, business day and period flags over 7 years."""
    from tsforge.functions.calendar import generated_time_columns, iso_text
    return S.daily_lineitem(spark, sf_dir).select(SERIES, TS, iso_text(TS).alias("iso"), *generated_time_columns(TS))


# ---------------------------------------------------------------- weather
_WX = Q.weather_cte("wx")


@register("weather_series", f"WITH {_WX} SELECT ts, {', '.join(Q.r4(c, c) for c in Q.WEATHER_COLS)} FROM wx")
def q_weather_series(spark, sf_dir):
    """Hourly weather measures derived from four event types, spine-filled."""
    return S.weather_series(spark, sf_dir)


@register("weather_features", f"WITH {_WX} SELECT ts, {', '.join(Q.weather_feature_sql())} FROM wx")
def q_weather_features(spark, sf_dir):
    """Degree hours, temperature bins, apparent temperature, comfort, severity, solar efficiency."""
    from tsforge.functions.weather import weather_feature_columns
    w = S.weather_series(spark, sf_dir)
    return w.select(TS, *weather_feature_columns(w.columns))


_LOAD = Q.spine_cte("ld", "SELECT event_type AS series, ts, value AS v FROM events WHERE event_type = 'purchase'", value="kwh")
_MERGED = f"""{_LOAD}, {_WX},
merged AS (SELECT ld.series, ld.ts, ld.kwh, {', '.join('wx.' + c for c in Q.WEATHER_COLS)} FROM ld JOIN wx ON ld.ts = wx.ts)"""
_MCOLS = ", ".join(Q.r4(c, c) for c in ["kwh"] + Q.WEATHER_COLS)


@register("merge_load_weather", f"WITH {_MERGED} SELECT series, ts, {_MCOLS} FROM merged")
def q_merge_load_weather(spark, sf_dir):
    """Load spine inner-joined with the global weather series on ts."""
    from tsforge.operators.joins import merge_on_time
    return merge_on_time(S.load_series(spark, sf_dir), S.weather_series(spark, sf_dir), "inner")


@register("interaction_features", f"""WITH {_MERGED},
tf AS (SELECT *, {', '.join(Q.time_cols_sql())} FROM merged)
SELECT series, ts, {', '.join(Q.interaction_sql())} FROM tf""")
def q_interaction_features(spark, sf_dir):
    """F24-F27 on the merged frame with time features."""
    from tsforge.functions.weather import interaction_feature_columns
    from tsforge.operators.joins import merge_on_time
    from tsforge.plans.preprocess import add_time_features
    m = add_time_features(merge_on_time(S.load_series(spark, sf_dir), S.weather_series(spark, sf_dir)))
    return m.select(SERIES, TS, *interaction_feature_columns(m.columns))


# ---------------------------------------------------------------- holidays
def _holiday_sql() -> str:
    from tsforge.functions.holidays import US_FEDERAL_RULES
    parts = []
    for name, month, rule, since in US_FEDERAL_RULES:
        first = f"make_date(CAST(y AS BIGINT), {month}, 1)"
        kind, *args = rule.split(":")
        if kind == "fixed":
            d = f"make_date(CAST(y AS BIGINT), {month}, {int(args[0])})"
        elif kind == "nth":
            wd, n = int(args[0]) - 1, int(args[1])
            d = f"CAST({first} + INTERVAL (((({wd} - (isodow({first}) - 1)) % 7) + 7) % 7 + {7 * (n - 1)}) DAY AS DATE)"
        else:
            wd = int(args[0]) - 1
            ld = f"last_day({first})"
            d = f"CAST({ld} - INTERVAL ((((isodow({ld}) - 1 - {wd}) % 7) + 7) % 7) DAY AS DATE)"
        parts.append(f"SELECT {d} AS hd FROM yrs WHERE y >= {since}")
    base = " UNION ALL ".join(parts)
    return f"""yrs AS (SELECT unnest(range(CAST(min(year(ts)) - 1 AS BIGINT), CAST(max(year(ts)) + 2 AS BIGINT))) AS y FROM d_l),
hol0 AS ({base}),
hol AS (SELECT hd FROM hol0 UNION SELECT CASE WHEN isodow(hd) = 6 THEN CAST(hd - INTERVAL 1 DAY AS DATE)
        ELSE CAST(hd + INTERVAL 1 DAY AS DATE) END FROM hol0 WHERE isodow(hd) >= 6),
dd AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM d_l),
dist AS (SELECT dd.d,
    max(CASE WHEN hol.hd = dd.d THEN 1 ELSE 0 END) AS is_holiday,
    min(CASE WHEN hol.hd > dd.d THEN date_diff('day', dd.d, hol.hd) END) AS dto,
    min(CASE WHEN hol.hd < dd.d THEN date_diff('day', hol.hd, dd.d) END) AS dfrom
  FROM dd LEFT JOIN hol ON abs(date_diff('day', dd.d, hol.hd)) <= 7 GROUP BY dd.d)"""


@register("holiday_features", f"""WITH {_DL}, {_holiday_sql()}
SELECT series, ts, CAST(coalesce(is_holiday, 0) AS BIGINT) AS is_holiday, CAST(coalesce(dto, 0) AS BIGINT) AS days_to_holiday,
  CAST(coalesce(dfrom, 0) AS BIGINT) AS days_from_holiday,
  CAST(coalesce(is_holiday, 0) = 1 OR coalesce(dto, 0) <= 1 OR coalesce(dfrom, 0) <= 1 AS BIGINT) AS is_holiday_period
FROM d_l JOIN dist ON CAST(d_l.ts AS DATE) = dist.d""")
def q_holiday_features(spark, sf_dir):
    """US federal holidays (rule table) and distances within 7 days, daily line items."""
    from tsforge.functions.holidays import add_holiday_features, holidays_covering
    d = S.daily_lineitem(spark, sf_dir)
    return add_holiday_features(d.select(SERIES, TS), holidays_covering(d))


# ---------------------------------------------------------------- outliers
_IQR = f"""iqr AS (SELECT series, {Q.agg_quantile('value', 0.25)} AS q1, {Q.agg_quantile('value', 0.75)} AS q3 FROM hourly GROUP BY 1),
fl AS (SELECT hourly.*, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) AS o
  FROM hourly JOIN iqr USING (series))"""


@register("outlier_stats_iqr", f"""WITH {HOURLY}, {_IQR}
SELECT series, 'iqr' AS method, CAST(count(*) FILTER (WHERE o) AS BIGINT) AS outlier_count,
  {Q.r4('count(*) FILTER (WHERE o) * 100.0 / count(*)', 'outlier_percentage')} FROM fl GROUP BY 1""")
def q_outlier_stats_iqr(spark, sf_dir):
    """O1 + O4: IQR fences (exact interpolated quartiles, 1.5x) per series; counts and share."""
    from tsforge.operators.outliers import flag_outliers, outlier_stats
    return outlier_stats(flag_outliers(S.hourly_by_type(spark, sf_dir), "value", "iqr"), "iqr")


@register("outlier_stamps_iqr", f"WITH {HOURLY}, {_IQR} SELECT series, ts FROM fl WHERE o")
def q_outlier_stamps_iqr(spark, sf_dir):
    """The stamps flagged by the IQR rule, as a table."""
    from tsforge.operators.outliers import flag_outliers, outlier_stamps
    return outlier_stamps(flag_outliers(S.hourly_by_type(spark, sf_dir), "value", "iqr"))


@register("outlier_stats_zscore", f"""WITH {HOURLY},
st AS (SELECT series, avg(value) AS mu, stddev_samp(value) AS sd FROM hourly GROUP BY 1),
fl AS (SELECT hourly.*, coalesce(abs((value - mu) / nullif(sd, 0)) > 3, false) AS o FROM hourly JOIN st USING (series))
SELECT series, 'zscore' AS method, CAST(count(*) FILTER (WHERE o) AS BIGINT) AS outlier_count,
  {Q.r4('count(*) FILTER (WHERE o) * 100.0 / count(*)', 'outlier_percentage')} FROM fl GROUP BY 1""")
def q_outlier_stats_zscore(spark, sf_dir):
    """O2 + O4: |z| > 3 with the sample standard deviation."""
    from tsforge.operators.outliers import flag_outliers, outlier_stats
    return outlier_stats(flag_outliers(S.hourly_by_type(spark, sf_dir), "value", "zscore"), "zscore")


# ---------------------------------------------------------------- preprocessing composition
_LIQR = f"""liqr AS (SELECT series, {Q.agg_quantile('kwh', 0.25)} AS q1, {Q.agg_quantile('kwh', 0.75)} AS q3 FROM ld GROUP BY 1),
lkept AS (SELECT ld.* FROM ld JOIN liqr USING (series)
  WHERE NOT coalesce(kwh < q1 - 1.5 * (q3 - q1) OR kwh > q3 + 1.5 * (q3 - q1), false)),
pre AS (SELECT lkept.series, lkept.ts, lkept.kwh, {', '.join('wf6.' + c for c in Q.WEATHER_COLS)}, {', '.join(Q.time_cols_sql('lkept.ts'))}
  FROM lkept JOIN wf6 ON lkept.ts = wf6.ts)"""


def _weather_filled() -> str:
    """wf6: weather with every measure interpolated + edge filled (one CTE chain per column)."""
    parts = ["wf0 AS (SELECT 'w' AS series, * FROM wx)"]
    for i, c in enumerate(Q.WEATHER_COLS, start=1):
        parts.append(Q.interp_cte(f"wf{i}", f"wf{i - 1}", c).strip())
    return ",\n".join(parts)
_PRE_COLS = ["kwh"] + Q.WEATHER_COLS


def _pre_select() -> str:
    ints = ["hour", "day_of_week", "day_of_month", "month", "quarter", "year", "day_of_year", "is_weekend"]
    dbl = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
           "day_of_year_sin", "day_of_year_cos"]
    return ", ".join(["series", "ts"] + [Q.r4(c, c) for c in _PRE_COLS] + ints + dbl)


@register("preprocessed", f"WITH {_LOAD}, {_WX}, {_weather_filled()}, {_LIQR} SELECT {_pre_select()} FROM pre")
def q_preprocessed(spark, sf_dir):
    """raw fill -> hourly resample -> IQR removal -> inner merge with weather -> 16 time columns."""
    from tsforge.plans.preprocess import preprocess
    processed, _, _ = preprocess(S.load_series(spark, sf_dir, raw=True), S.weather_series(spark, sf_dir))
    return processed


# ---------------------------------------------------------------- gap report
_GAP = """pres AS (SELECT DISTINCT event_type AS series, date_trunc('hour', ts) AS ts FROM events),
gst AS (SELECT series, min(ts) AS lo, max(ts) AS hi, count(*) AS total_actual FROM pres GROUP BY 1),
gsp AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM gst),
miss AS (SELECT gsp.series, gsp.ts FROM gsp WHERE NOT EXISTS (SELECT 1 FROM pres p WHERE p.series = gsp.series AND p.ts = gsp.ts)),
gm AS (SELECT series, ts, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series ORDER BY ts))) / 3600.0 AS gap,
    CAST(epoch(ts) AS BIGINT) // 3600 - row_number() OVER (PARTITION BY series ORDER BY ts) AS isl,
    row_number() OVER (PARTITION BY series ORDER BY ts) AS rn FROM miss)"""


def _gap_input(spark, sf_dir):
    obs = S.event_observations(spark, sf_dir)
    return obs.select(SERIES, F.date_trunc("hour", TS).alias(TS)).distinct()


@register("gap_report", f"""WITH {_GAP},
runs AS (SELECT series, isl, count(*) AS len FROM gm GROUP BY 1, 2),
pm AS (SELECT series, count(*) AS mc, coalesce(max(gap), 0) AS lg FROM gm GROUP BY 1),
pr AS (SELECT series, max(len) * 1.0 AS lr FROM runs GROUP BY 1),
ne AS (SELECT series, count(*) AS te FROM gsp GROUP BY 1)
SELECT gst.series, CAST(te AS BIGINT) AS total_expected, CAST(total_actual AS BIGINT) AS total_actual,
  CAST(coalesce(mc, 0) AS BIGINT) AS missing_count, {Q.r4('total_actual * 100.0 / te', 'completeness_pct')},
  {Q.r4('coalesce(lg, 0)', 'largest_gap_hours')}, {Q.r4('coalesce(lr, 0)', 'longest_run_hours')}
FROM gst JOIN ne USING (series) LEFT JOIN pm USING (series) LEFT JOIN pr USING (series)""")
def q_gap_report(spark, sf_dir):
    """Expected vs present hourly stamps per event type; gap sizes and longest missing run."""
    from tsforge.operators.resample import gap_report
    return gap_report(_gap_input(spark, sf_dir), "H")[0]


@register("gap_first_missing", f"WITH {_GAP} SELECT series, CAST(rn AS BIGINT) AS rank, ts FROM gm WHERE rn <= 10")
def q_gap_first_missing(spark, sf_dir):
    """The first 10 missing stamps per series."""
    from tsforge.operators.resample import gap_report
    return gap_report(_gap_input(spark, sf_dir), "H")[1]


# ---------------------------------------------------------------- summaries
def _merged(spark, sf_dir):
    from tsforge.operators.joins import merge_on_time
    return merge_on_time(S.load_series(spark, sf_dir), S.weather_series(spark, sf_dir))


def _summary_sql() -> str:
    cols = [f"CAST(count(*) AS BIGINT) AS total_records", "min(ts) AS start", "max(ts) AS \"end\"",
            "CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) AS BIGINT) AS duration_days",
            Q.r4("avg(kwh)", "mean_kwh"), Q.r4(Q.agg_quantile("kwh", 0.5), "median_kwh"),
            Q.r4("stddev_samp(kwh)", "std_kwh"), Q.r4("min(kwh)", "min_kwh"), Q.r4("max(kwh)", "max_kwh")]
    for c in Q.WEATHER_COLS:
        cols += [Q.r4(f"avg({c})", f"{c}_mean"), Q.r4(f"stddev_samp({c})", f"{c}_std"),
                 Q.r4(f"min({c})", f"{c}_min"), Q.r4(f"max({c})", f"{c}_max")]
    return f"WITH {_MERGED} SELECT series, {', '.join(cols)} FROM merged GROUP BY series"


@register("data_summary", _summary_sql())
def q_data_summary(spark, sf_dir):
    """A1: records, span, whole days, load mean/median/std/min/max, weather mean/std/min/max."""
    from tsforge.operators.aggregates import data_summary
    return data_summary(_merged(spark, sf_dir), "kwh")


def _describe_sql() -> str:
    parts = []
    for c in ["kwh"] + Q.WEATHER_COLS:
        parts.append(f"""SELECT series, '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, {Q.r4(f'avg({c})', 'mean')},
  {Q.r4(f'stddev_samp({c})', 'std')}, {Q.r4(f'min({c})', 'min')}, {Q.r4(Q.agg_quantile(c, 0.25), 'q25')},
  {Q.r4(Q.agg_quantile(c, 0.5), 'q50')}, {Q.r4(Q.agg_quantile(c, 0.75), 'q75')}, {Q.r4(f'max({c})', 'max')}
  FROM merged GROUP BY series""")
    return f"WITH {_MERGED} " + " UNION ALL ".join(parts)


@register("describe", _describe_sql())
def q_describe(spark, sf_dir):
    """A2: count/mean/std/min/quartiles/max of load and weather (one unpivoted aggregate)."""
    from tsforge.operators.aggregates import describe
    from tsforge.sources.series import WEATHER_COLUMNS
    return describe(_merged(spark, sf_dir), ["kwh"] + WEATHER_COLUMNS)


# ---------------------------------------------------------------- seasonal profiles (chart tables)
@register("profile_by_hour", f"""WITH {FILLED}
SELECT series, CAST(hour(ts) AS BIGINT) AS hour, {Q.r4('avg(value)', 'mean_value')} FROM filled GROUP BY 1, 2""")
def q_profile_by_hour(spark, sf_dir):
    """A3 / V6: mean by hour of day."""
    from tsforge.operators.aggregates import profile_by_hour
    return profile_by_hour(_hourly_filled(spark, sf_dir), "value")


_DAYS = "VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')"
_MONTHS = ", ".join(f"({i + 1}, '{m}')" for i, m in enumerate(
    ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]))


@register("profile_by_weekday", f"""WITH {FILLED},
dim AS (SELECT s.series, d.k, d.name FROM (SELECT DISTINCT series FROM filled) s CROSS JOIN ({_DAYS}) d(k, name)),
m AS (SELECT series, isodow(ts) - 1 AS k, avg(value) AS v FROM filled GROUP BY 1, 2)
SELECT dim.series, CAST(dim.k AS BIGINT) AS day_of_week, dim.name AS day_name, {Q.r4('m.v', 'mean_value')}
FROM dim LEFT JOIN m ON dim.series = m.series AND dim.k = m.k""")
def q_profile_by_weekday(spark, sf_dir):
    """A4 / V6: mean by weekday, Monday first, missing days NULL."""
    from tsforge.operators.aggregates import profile_by_weekday
    return profile_by_weekday(_hourly_filled(spark, sf_dir), "value")


@register("profile_by_month", f"""WITH {FILLED},
dim AS (SELECT s.series, d.k, d.name FROM (SELECT DISTINCT series FROM filled) s CROSS JOIN (VALUES {_MONTHS}) d(k, name)),
m AS (SELECT series, month(ts) AS k, avg(value) AS v FROM filled GROUP BY 1, 2)
SELECT dim.series, CAST(dim.k AS BIGINT) AS month, dim.name AS month_name, {Q.r4('m.v', 'mean_value')}
FROM dim LEFT JOIN m ON dim.series = m.series AND dim.k = m.k""")
def q_profile_by_month(spark, sf_dir):
    """A5 / V6: mean by month, January first, missing months NULL."""
    from tsforge.operators.aggregates import profile_by_month
    return profile_by_month(_hourly_filled(spark, sf_dir), "value")


_DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@register("heatmap_hour_day", f"""WITH {FILLED}
SELECT series, CAST(hour(ts) AS BIGINT) AS hour,
  {', '.join(Q.r4(f'avg(value) FILTER (WHERE isodow(ts) - 1 = {i})', d) for i, d in enumerate(_DAY_NAMES))}
FROM filled GROUP BY 1, 2""")
def q_heatmap_hour_day(spark, sf_dir):
    """Hour x weekday pivot of means."""
    from tsforge.operators.aggregates import heatmap_hour_day
    return heatmap_hour_day(_hourly_filled(spark, sf_dir), "value")


@register("histogram", f"""WITH {FILLED},
rg AS (SELECT series, min(value) AS lo, max(value) AS hi FROM filled GROUP BY 1),
b AS (SELECT f.series, lo, hi, CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 30) + 1, 30) ELSE 1 END AS BIGINT) AS bin
  FROM filled f JOIN rg USING (series) WHERE value IS NOT NULL)
SELECT series, bin, {Q.r4('lo + (bin - 1) * ((hi - lo) / 30)', 'bin_lo')}, {Q.r4('lo + bin * ((hi - lo) / 30)', 'bin_hi')},
  CAST(count(*) AS BIGINT) AS count FROM b GROUP BY series, bin, lo, hi""")
def q_histogram(spark, sf_dir):
    """30 equal-width bins per series; the maximum falls in bin 30."""
    from tsforge.operators.aggregates import histogram
    return histogram(_hourly_filled(spark, sf_dir), "value", 30)


# ---------------------------------------------------------------- baselines and metrics
def _baseline_long(spark, sf_dir):
    from tsforge.plans.baselines import BASELINES, baseline_predictions, to_long, with_split
    split = with_split(_hourly_filled(spark, sf_dir), 0.2)
    wide = baseline_predictions(split, "value")
    return to_long(wide, "value", [b[0] for b in BASELINES], keep=["is_test"]).where("is_test").drop("is_test")


_BASE_SQL = f"""bp AS (SELECT series, ts, value AS y, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS i,
    count(*) OVER (PARTITION BY series) AS n, avg(value) OVER (PARTITION BY series) AS mu,
    lag(value, 24) OVER (PARTITION BY series ORDER BY ts) AS l24, lag(value, 168) OVER (PARTITION BY series ORDER BY ts) AS l168,
    {Q.rolling_sql('value', 24, 'mean')} AS ma FROM filled),
lng AS (SELECT series, ts, 'naive_24h' AS model, y, coalesce(l24, mu) AS p FROM bp WHERE i >= floor(n * 0.8)
  UNION ALL SELECT series, ts, 'seasonal_naive', y, coalesce(l168, mu) FROM bp WHERE i >= floor(n * 0.8)
  UNION ALL SELECT series, ts, 'moving_avg_24h', y, coalesce(ma, mu) FROM bp WHERE i >= floor(n * 0.8))"""
_METRIC_COLS = f"""CAST(count(y - p) AS BIGINT) AS n, {Q.r4('avg(abs(y - p))', 'mae')}, {Q.r4('sqrt(avg((y - p) * (y - p)))', 'rmse')},
  {Q.r4('100 * avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))', 'mape')},
  {Q.r4('CASE WHEN count(y - p) = 0 THEN NULL WHEN var_pop(y) * count(y) = 0 THEN 0 ELSE 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) END', 'r2')}"""


@register("baseline_predictions", f"WITH {FILLED}, {_BASE_SQL} SELECT series, ts, model, {Q.r4('y', 'y_true')}, {Q.r4('p', 'y_pred')} FROM lng")
def q_baseline_predictions(spark, sf_dir):
    """Baseline forecasts on the test rows (last 20 %) as a long table."""
    return _baseline_long(spark, sf_dir)


@register("baseline_metrics", f"WITH {FILLED}, {_BASE_SQL} SELECT series, model, {_METRIC_COLS} FROM lng GROUP BY 1, 2")
def q_baseline_metrics(spark, sf_dir):
    """MAE, RMSE, MAPE %, R2 per series and baseline on the time-ordered test split."""
    from tsforge.plans.metrics import regression_metrics
    return regression_metrics(_baseline_long(spark, sf_dir), [SERIES, "model"])


@register("forecast_metrics", f"""WITH {FILLED}, {_BASE_SQL},
st AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY series, model ORDER BY ts)) AS step FROM lng)
SELECT series, model, {_METRIC_COLS},
  {Q.r4('CASE WHEN count(y - p) > 1 THEN avg(abs(y - p)) / nullif(avg(step), 0) END', 'mase')},
  {Q.r4('avg(200 * abs(y - p) / nullif(abs(y) + abs(p), 0))', 'smape')}
FROM st GROUP BY 1, 2""")
def q_forecast_metrics(spark, sf_dir):
    """A7 plus MASE (lag-1 naive scale) and sMAPE."""
    from tsforge.plans.metrics import regression_metrics
    return regression_metrics(_baseline_long(spark, sf_dir), [SERIES, "model"], extended=True)


@register("residual_stats", f"""WITH {FILLED}, {_BASE_SQL}
SELECT series, model, {Q.r4('avg(y - p)', 'mean')}, {Q.r4('stddev_pop(y - p)', 'std')}, {Q.r4('min(y - p)', 'min')},
  {Q.r4('max(y - p)', 'max')} FROM lng GROUP BY 1, 2""")
def q_residual_stats(spark, sf_dir):
    """A10: residual mean, population std, min, max per series and baseline."""
    from tsforge.operators.aggregates import residual_stats
    long = _baseline_long(spark, sf_dir).withColumn("residual", F.col("y_true") - F.col("y_pred"))
    return residual_stats(long, [SERIES, "model"])


def _qq_sql() -> str:
    from tsforge.operators.aggregates import qq_grid
    grid = qq_grid(50)
    vals = ", ".join(f"({i + 1}, {p!r}, {z!r})" for i, (p, z) in enumerate(grid))
    arr = "list_sort(list(y - p))"
    return f"""WITH {FILLED}, {_BASE_SQL},
rs AS (SELECT series, model, {arr} AS s FROM lng GROUP BY 1, 2),
g AS (SELECT k, CAST(prob AS DOUBLE) AS prob, CAST(theoretical AS DOUBLE) AS theoretical FROM (VALUES {vals}) g(k, prob, theoretical))
SELECT series, model, CAST(k AS BIGINT) AS k, {Q.r4('prob', 'prob')}, {Q.r4('theoretical', 'theoretical')},
  {Q.r4(Q.quantile_of_list('s', 'prob'), 'sample')} FROM rs CROSS JOIN g"""


@register("qq_table", _qq_sql())
def q_qq_table(spark, sf_dir):
    """Residual quantiles of each baseline against normal quantiles (50 points)."""
    from tsforge.operators.aggregates import qq_table
    long = _baseline_long(spark, sf_dir).withColumn("residual", F.col("y_true") - F.col("y_pred"))
    return qq_table(long, "residual", [SERIES, "model"], 50)


@register("best_model", f"""WITH {FILLED}, {_BASE_SQL},
m AS (SELECT series, model, sqrt(avg((y - p) * (y - p))) AS rmse FROM lng GROUP BY 1, 2)
SELECT series, arg_min(model, rmse) AS best_model, {Q.r4('min(rmse)', 'rmse')} FROM m GROUP BY 1""")
def q_best_model(spark, sf_dir):
    """Lowest-RMSE baseline per series."""
    from tsforge.plans.metrics import best_model, regression_metrics
    return best_model(regression_metrics(_baseline_long(spark, sf_dir), [SERIES, "model"]), "rmse", [SERIES])


# ---------------------------------------------------------------- scenario scoring
def _scenarios(spark, sf_dir):
    from tsforge.plans.scoring import scenarios_from_series
    return scenarios_from_series(_hourly_filled(spark, sf_dir), "value", S.weather_series(spark, sf_dir), 24, 24)


_SCEN = f"""{FILLED}, {_WX},
se AS (SELECT series, max(ts) AS end_ts FROM filled GROUP BY 1),
sc AS (SELECT f.series AS scenario, se.end_ts, list(f.value ORDER BY f.ts) AS recent, 24 AS horizon
  FROM filled f JOIN se USING (series) WHERE f.ts > se.end_ts - INTERVAL 24 HOUR GROUP BY 1, 2),
scw AS (SELECT sc.*, {', '.join('wx.' + c for c in Q.WEATHER_COLS)} FROM sc LEFT JOIN wx ON sc.end_ts = wx.ts)"""


@register("scenario_table", f"""WITH {_SCEN}
SELECT scenario, end_ts, list_transform(recent, lambda x: round(x * 10000) / 10000 + 0.0) AS recent, CAST(horizon AS BIGINT) AS horizon,
  {', '.join(Q.r4(c, c) for c in Q.WEATHER_COLS)} FROM scw""")
def q_scenario_table(spark, sf_dir):
    """One scenario per series (last 24 hourly values, weather at the last stamp, horizon 24)."""
    sc = _scenarios(spark, sf_dir)
    return sc.select("scenario", "end_ts", "recent", "horizon", "weather.*")


_M3 = "list_avg(list_slice(recent, len(recent) - 2, len(recent)))"
_P3 = "list_avg(list_slice(recent, len(recent) - 5, len(recent) - 3))"


@register("scenario_next_hour", f"""WITH {_SCEN},
h AS (SELECT scenario, end_ts, {_M3} AS m3, CASE WHEN len(recent) >= 6 THEN {_P3} END AS p3, len(recent) AS n,
  coalesce(temperature_c, 20.0) AS t FROM scw),
f AS (SELECT *, CASE WHEN n >= 6 AND p3 > 0 THEN m3 / p3 ELSE 1.0 END AS trend,
  1.0 + 0.2 * sin(2 * pi() * (hour(end_ts) - 6) / 24) AS hf, CASE WHEN t > 25 OR t < 15 THEN 1.1 ELSE 1.0 END AS wf FROM h)
SELECT scenario, end_ts, {Q.r4('m3', 'recent_average')}, {Q.r4('trend', 'trend_factor')}, {Q.r4('hf', 'hourly_factor')},
  {Q.r4('wf', 'weather_factor')}, {Q.r4('m3 * trend * hf * wf', 'prediction')}, CAST(NULL AS VARCHAR) AS error FROM f""")
def q_scenario_next_hour(spark, sf_dir):
    """M16 + M17 + P16: next-hour heuristic (recent mean x trend x hour-of-day x weather factor)."""
    from tsforge.plans.scoring import heuristic_next_hour
    return heuristic_next_hour(_scenarios(spark, sf_dir))


_STEPS = f"""st AS (SELECT scenario, end_ts, {_M3} AS m3, unnest(range(0, horizon)) AS step FROM scw)"""


@register("scenario_horizon_daily", f"""WITH {_SCEN}, {_STEPS}
SELECT scenario, CAST(step AS BIGINT) AS step, end_ts + INTERVAL 1 HOUR * (step + 1) AS ts,
  {Q.r4('m3 * (1 + 0.3 * sin(2 * pi() * step / 24)) * (1 + 0.0)', 'prediction')}, CAST(NULL AS VARCHAR) AS error FROM st""")
def q_scenario_horizon_daily(spark, sf_dir):
    """Horizon forecast with a daily sine pattern (noise off)."""
    from tsforge.plans.scoring import heuristic_horizon
    return heuristic_horizon(_scenarios(spark, sf_dir), "daily")


_WEEKLY = """greatest(0.1, m3 * (1 + 0.3 * sin(2 * pi() * ((hour(end_ts) + step) % 24 - 6) / 24))
    * CASE WHEN (isodow(end_ts) - 1 + step // 24) % 7 < 5 THEN 1.1 ELSE 0.9 END * (1 + 0.0))"""


@register("scenario_horizon_weekly", f"""WITH {_SCEN}, {_STEPS}
SELECT scenario, CAST(step AS BIGINT) AS step, end_ts + INTERVAL 1 HOUR * (step + 1) AS ts, {Q.r4(_WEEKLY, 'prediction')}, CAST(NULL AS VARCHAR) AS error FROM st""")
def q_scenario_horizon_weekly(spark, sf_dir):
    """Horizon forecast with daily and weekday/weekend patterns, floor 0.1 (noise off)."""
    from tsforge.plans.scoring import heuristic_horizon
    return heuristic_horizon(_scenarios(spark, sf_dir), "daily_weekly")


@register("forecast_summary", f"""WITH {_SCEN}, {_STEPS}, pr AS (SELECT scenario, {_WEEKLY} AS p FROM st)
SELECT scenario, {Q.r4('round(sum(p) * 1000) / 1000', 'total_predicted')}, {Q.r4('round(avg(p) * 1000) / 1000', 'average_hourly')},
  {Q.r4('round(max(p) * 1000) / 1000', 'peak_hour')}, {Q.r4('round(min(p) * 1000) / 1000', 'min_hour')},
  CAST(count(*) AS BIGINT) AS steps FROM pr GROUP BY 1""")
def q_forecast_summary(spark, sf_dir):
    """Total / average / peak / minimum of each scenario's horizon, rounded to 3."""
    from tsforge.plans.scoring import forecast_summary, heuristic_horizon
    return forecast_summary(heuristic_horizon(_scenarios(spark, sf_dir), "daily_weekly"))


# Requests as they come: sound ones, and each way a request can be wrong.
_REQUESTS = f"""{_SCEN},
rq AS (SELECT scenario || '/sound' AS scenario, end_ts, recent, 24 AS horizon, temperature_c FROM scw
  UNION ALL SELECT scenario || '/text', end_ts, list_slice(recent, 1, len(recent) - 1), 24, temperature_c FROM scw
  UNION ALL SELECT scenario || '/gap', end_ts, list_concat(list_slice(recent, 1, len(recent) - 2), [recent[-1]]), 24, temperature_c FROM scw
  UNION ALL SELECT scenario || '/no weather', end_ts, recent, 24, NULL FROM scw
  UNION ALL SELECT scenario || '/short', end_ts, list_slice(recent, len(recent) - 1, len(recent)), 24, temperature_c FROM scw
  UNION ALL SELECT scenario || '/nothing', end_ts, [], 24, temperature_c FROM scw
  UNION ALL SELECT scenario || '/no step', end_ts, recent, 0, temperature_c FROM scw
  UNION ALL SELECT scenario || '/too long', end_ts, recent, 721, temperature_c FROM scw),
rqe AS (SELECT *, CASE WHEN horizon NOT BETWEEN 1 AND 720 THEN 'horizon outside 1..720'
  WHEN len(recent) < 3 THEN 'fewer than three numeric values' END AS error FROM rq)"""


def _requests(spark, sf_dir):
    from tsforge.plans.scoring import request_variants
    return request_variants(_scenarios(spark, sf_dir))


@register("scenario_batch", f"""WITH {_REQUESTS},
st AS (SELECT scenario, end_ts, error, {_M3} AS m3, unnest(CASE WHEN error IS NULL THEN range(0, horizon) ELSE [NULL] END) AS step FROM rqe)
SELECT scenario, CAST(coalesce(step, -1) AS BIGINT) AS step, CASE WHEN error IS NULL THEN end_ts + INTERVAL 1 HOUR * (step + 1) END AS ts,
  {Q.r4(f'CASE WHEN error IS NULL THEN {_WEEKLY} END', 'prediction')}, error FROM st""")
def q_scenario_batch(spark, sf_dir):
    """A batch with sound, gappy, non-numeric, short, empty and out-of-range requests;
    every request is answered, with its steps or with its error."""
    from tsforge.plans.scoring import heuristic_horizon
    steps = heuristic_horizon(_requests(spark, sf_dir), "daily_weekly")
    return steps.withColumn("step", F.coalesce("step", F.lit(-1)))  # -1: the request's error row


@register("batch_success_count", f"""WITH {_REQUESTS}
SELECT CAST(count(*) FILTER (WHERE error IS NULL) AS BIGINT) AS successful, CAST(count(*) AS BIGINT) AS total FROM rqe""")
def q_batch_success_count(spark, sf_dir):
    """Requests of the batch that were scored."""
    from tsforge.plans.scoring import checked, success_count
    return success_count(checked(_requests(spark, sf_dir)))


def _request_features_sql() -> str:
    lags = ", ".join(Q.r4(f"CASE WHEN n > {k} THEN lag(kwh, {k}) OVER (PARTITION BY series ORDER BY ts) END", f"kwh_lag_{k}h") for k in (1, 2, 24))
    means = ", ".join(Q.r4(f"CASE WHEN n > {k} THEN {Q.rolling_sql('kwh', k, 'mean')} END", f"kwh_rolling_{k}h_mean") for k in (6, 24))
    return f"""WITH {_REQUESTS},
rf AS (SELECT scenario AS series, end_ts - INTERVAL 1 HOUR * (len(recent) - i) AS ts, recent[i] AS kwh, len(recent) AS n, coalesce(temperature_c, 20.0) AS t
  FROM (SELECT *, unnest(range(1, len(recent) + 1)) AS i FROM rqe WHERE error IS NULL))
SELECT series, ts, {Q.r4('kwh', 'kwh')}, {Q.r4('t', 'temperature_c')}, {', '.join(Q.time_cols_sql())}, {lags}, {means} FROM rf"""


@register("request_features", _request_features_sql())
def q_request_features(spark, sf_dir):
    """Requests turned into hourly frames with constant or default weather, time columns,
    serving lags and means."""
    from tsforge.plans.charts import serving_features
    from tsforge.plans.preprocess import add_time_features
    from tsforge.plans.scoring import request_frame
    frame = request_frame(_requests(spark, sf_dir), "kwh").select(SERIES, TS, IDX, "kwh", "temperature_c")
    return serving_features(add_time_features(frame), "kwh")


# ---------------------------------------------------------------- full feature frame
def _engineered_sql() -> str:
    t = "kwh"
    ws = _WS
    lags = ", ".join(Q.r4(f"lag({t}, {n}) OVER ({ws})", f"{t}_lag_{n}h") for n in W.DEFAULT_LAGS)
    rolls = ", ".join(Q.r4(Q.rolling_sql(t, n, s), f"{t}_rolling_{n}h_{s}") for n in W.DEFAULT_WINDOWS for s in W.DEFAULT_STATS)
    emas = _ema_sql("pre", t, W.DEFAULT_ALPHAS)
    ema_sel = ", ".join(Q.r4(f"ema_{str(a).replace('.', '_')}.e", f"{t}_ema_alpha_{a}") for a in W.DEFAULT_ALPHAS)
    ema_join = " ".join(f"JOIN ema_{str(a).replace('.', '_')} USING (series, ts)" for a in W.DEFAULT_ALPHAS)
    ints = ["hour", "day_of_week", "day_of_month", "month", "quarter", "year", "day_of_year", "is_weekend"]
    dbl = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
           "day_of_year_sin", "day_of_year_cos"]
    stat = (f"{Q.r4(f'CASE WHEN _n >= 168 THEN {t} / nullif(lag({t}, 168) OVER ({ws}), 0) - 1 END', f'{t}_vs_same_hour_last_week')}, "
            + ", ".join(Q.r4(f"CASE WHEN _n > {p} THEN _pad / nullif(lag(_pad, {p}) OVER ({ws}), 0) - 1 END", f"{t}_pct_change_{p}h")
                        for p in W.STAT_PERIODS)
            + ", " + Q.r4(f"CASE WHEN _n >= 168 THEN ({t} - ({Q.rolling_sql(t, 168, 'mean')})) / nullif({Q.rolling_sql(t, 168, 'std')}, 0) END",
                          f"{t}_zscore_168h"))
    return f"""WITH {_LOAD}, {_WX}, {_weather_filled()}, {_LIQR},
pre_p AS (SELECT *, row_number() OVER ({ws}) AS _i,
  last_value({t} IGNORE NULLS) OVER ({ws} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _pad,
  count(*) OVER (PARTITION BY series) AS _n FROM pre),
{emas},
win AS (SELECT pre_p.*, {lags}, {rolls}, {stat} FROM pre_p),
fe AS (SELECT win.*, {ema_sel} FROM win {ema_join})
SELECT series, ts, {', '.join(Q.r4(c, c) for c in _PRE_COLS)}, {', '.join(ints)}, {', '.join(dbl)},
  {', '.join(f'"{c}"' for c in [f"{t}_lag_{n}h" for n in W.DEFAULT_LAGS] + [f"{t}_rolling_{n}h_{s}" for n in W.DEFAULT_WINDOWS for s in W.DEFAULT_STATS] + [f"{t}_ema_alpha_{a}" for a in W.DEFAULT_ALPHAS])},
  {', '.join(Q.calendar_cols_sql())}, {', '.join(Q.weather_feature_sql())}, {', '.join(Q.interaction_sql())},
  {', '.join(f'"{c}"' for c in [f"{t}_vs_same_hour_last_week"] + [f"{t}_pct_change_{p}h" for p in W.STAT_PERIODS] + [f"{t}_zscore_168h"])}
FROM fe"""


@register("engineered_features", _engineered_sql())
def q_engineered_features(spark, sf_dir):
    """F33 on F34: the 92-column training frame (23 preprocessed + 69 engineered), row-based windows."""
    from tsforge.plans.features import FeatureConfig, engineer_features
    from tsforge.plans.preprocess import preprocess
    processed, _, _ = preprocess(S.load_series(spark, sf_dir, raw=True), S.weather_series(spark, sf_dir))
    return engineer_features(processed, FeatureConfig(target="kwh"))


# ---------------------------------------------------------------- models (seeded fits: rows-only checks)
def _engineered(spark, sf_dir):
    from tsforge.plans.features import FeatureConfig, engineer_features
    from tsforge.plans.preprocess import preprocess
    processed, _, _ = preprocess(S.load_series(spark, sf_dir, raw=True), S.weather_series(spark, sf_dir))
    return engineer_features(processed, FeatureConfig(target="kwh"))


@register("model_metrics_forest")
def q_model_metrics_forest(spark, sf_dir):
    """Random forest (100 trees, depth 10, seed 42) on the engineered frame;
    test-split metrics next to the three baselines (one long table, one metric aggregate)."""
    from tsforge.plans import models as M
    return M.evaluate_with_baselines(_engineered(spark, sf_dir), "kwh", [M.PRESETS["random_forest"]])[0]


@register("model_metrics_boosted")
def q_model_metrics_boosted(spark, sf_dir):
    """M2, M3, M7: both boosted-tree presets in full (200 iterations, depth 8, rate 0.1, seed 42; row sampling 0.8 / 1.0)."""
    from tsforge.plans import models as M
    return M.train_and_evaluate(_engineered(spark, sf_dir), "kwh", [M.PRESETS["boosted_a"], M.PRESETS["boosted_b"]])[0]


@register("cv_metrics_forest")
def q_cv_metrics_forest(spark, sf_dir):
    """M8: 3-fold expanding-window cross-validation of the forest preset on the training rows."""
    from tsforge.plans import models as M
    return M.cross_validate(_engineered(spark, sf_dir), "kwh", M.PRESETS["random_forest"], 3)


@register("feature_importance_top")
def q_feature_importance_top(spark, sf_dir):
    """M5, T4, V3: the 20 most important features of the forest."""
    from tsforge.plans import models as M
    _, _, models, feats = M.train_and_evaluate(_engineered(spark, sf_dir), "kwh", [M.PRESETS["random_forest"]])
    return M.top_k(M.feature_importance(models["random_forest"], feats, spark), 20)


@register("feature_group_importance")
def q_feature_group_importance(spark, sf_dir):
    """F32 + M5: feature count and summed forest importance per feature group."""
    from tsforge.plans import models as M
    _, _, models, feats = M.train_and_evaluate(_engineered(spark, sf_dir), "kwh", [M.PRESETS["random_forest"]])
    return M.group_importance(M.feature_importance(models["random_forest"], feats, spark))


def _seasonal_ar_sql() -> str:
    """Least squares on three lags and a constant by orthogonalising one regressor after the other."""
    w = "OVER (PARTITION BY series ORDER BY ts)"
    return f"""WITH {FILLED},
b AS (SELECT series, ts, value, row_number() {w} - 1 AS i, count(*) OVER (PARTITION BY series) AS n,
  lag(value) {w} + lag(value, 24) {w} - lag(value, 25) {w} AS base FROM filled),
d AS (SELECT *, i >= floor(n * 0.8) AS is_test, value - base AS d FROM b),
x AS (SELECT *, lag(d) {w} AS x1, lag(d, 24) {w} AS x2, lag(d, 25) {w} AS x3 FROM d),
t AS (SELECT * FROM x WHERE NOT is_test AND d IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL),
s1 AS (SELECT series, regr_slope(x2, x1) AS a21, regr_slope(x3, x1) AS a31, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(d) AS md FROM t GROUP BY 1),
o1 AS (SELECT series, d, x1, a21, a31, x2 - m2 - a21 * (x1 - m1) AS y2, x3 - m3 - a31 * (x1 - m1) AS y3 FROM t JOIN s1 USING (series)),
s2 AS (SELECT series, regr_slope(y3, y2) AS a32 FROM o1 GROUP BY 1),
o2 AS (SELECT *, y3 - a32 * y2 AS z3 FROM o1 JOIN s2 USING (series)),
g AS (SELECT series, any_value(a21) AS a21, any_value(a31) AS a31, any_value(a32) AS a32, regr_slope(d, x1) AS g1, regr_slope(d, y2) AS g2, regr_slope(d, z3) AS b3 FROM o2 GROUP BY 1),
c AS (SELECT series, b3, g2 - b3 * a32 AS b2, g1 - (g2 - b3 * a32) * a21 - b3 * a31 AS b1 FROM g),
k AS (SELECT series, b1, b2, b3, md - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM c JOIN s1 USING (series)),
lng AS (SELECT series, 'seasonal_ar' AS model, ts, value AS y, base + b1 * x1 + b2 * x2 + b3 * x3 + b0 AS p FROM x JOIN k USING (series) WHERE is_test)
SELECT series, model, {_METRIC_COLS} FROM lng GROUP BY 1, 2"""


@register("seasonal_ar_metrics", _seasonal_ar_sql())
def q_seasonal_ar_metrics(spark, sf_dir):
    """M11 (re-aimed): seasonal autoregression on the (1, 24)-differenced filled series, fitted per event type."""
    from tsforge.plans.metrics import regression_metrics
    from tsforge.plans.models import seasonal_ar
    return regression_metrics(seasonal_ar(_hourly_filled(spark, sf_dir), "value"), [SERIES, "model"])


@register("fourier_metrics")
def q_fourier_metrics(spark, sf_dir):
    """M12 (re-aimed): multiplicative trend + daily/weekly/yearly Fourier regression, fitted per event type."""
    from tsforge.plans.metrics import regression_metrics
    from tsforge.plans.models import fourier_regression
    return regression_metrics(fourier_regression(_hourly_filled(spark, sf_dir), "value"), [SERIES, "model"])


@register("seasonal_ar_forecast")
def q_seasonal_ar_forecast(spark, sf_dir):
    """24 steps past each event type's end, each step feeding the next."""
    from tsforge.plans.models import seasonal_ar_forecast
    return seasonal_ar_forecast(_hourly_filled(spark, sf_dir), "value", 24)


@register("fourier_forecast")
def q_fourier_forecast(spark, sf_dir):
    """24 future rows per event type from a fit on its whole series."""
    from tsforge.plans.models import fourier_forecast
    return fourier_forecast(_hourly_filled(spark, sf_dir), "value", 24)


@register("seasonal_arma_metrics")
def q_seasonal_arma_metrics(spark, sf_dir):
    """Seasonal ARMA (1,1,1)(1,1,1,24) of each event type's filled series; test-split metrics of one-step forecasts."""
    from tsforge.plans.classical import seasonal_arma
    from tsforge.plans.metrics import regression_metrics
    return regression_metrics(seasonal_arma(_hourly_filled(spark, sf_dir), "value"), [SERIES, "model"])


@register("seasonal_arma_forecast")
def q_seasonal_arma_forecast(spark, sf_dir):
    """24 steps past each event type's end, each step feeding the next."""
    from tsforge.plans.classical import seasonal_arma_forecast
    return seasonal_arma_forecast(_hourly_filled(spark, sf_dir), "value", 24)


@register("trend_breaks_metrics")
def q_trend_breaks_metrics(spark, sf_dir):
    """Trend with breaks and daily, weekly, yearly seasons per event type; test-split metrics."""
    from tsforge.plans.classical import trend_regression
    from tsforge.plans.metrics import regression_metrics
    return regression_metrics(trend_regression(_hourly_filled(spark, sf_dir), "value"), [SERIES, "model"])


@register("trend_breaks_forecast")
def q_trend_breaks_forecast(spark, sf_dir):
    """24 future rows per event type from a fit on its whole series, the last slope going on."""
    from tsforge.plans.classical import trend_forecast
    return trend_forecast(_hourly_filled(spark, sf_dir), "value", 24)


@register("model_forecast")
def q_model_forecast(spark, sf_dir):
    """The forest applied to each series' latest feature row, 24 steps, clamped at 0."""
    from tsforge.plans import models as M
    eng = _engineered(spark, sf_dir)
    _, _, models, feats = M.train_and_evaluate(eng, "kwh", [M.PRESETS["random_forest"]])
    safe = eng.select(*[F.col(f"`{c}`").alias(M.safe_name(c)) for c in eng.columns])
    return M.score_latest(models["random_forest"], safe, feats, 24, "random_forest")


@register("end_to_end")
def q_end_to_end(spark, sf_dir):
    """Preprocess -> 92-column features -> baselines, both boosted presets and the forest on the test split ->
    3-fold CV of each -> frames, models and summary written -> best model marked."""
    import uuid
    from tsforge.plans import models as M
    from tsforge.plans.run import run_on_tables
    from tsforge.session import shared_path
    return run_on_tables(spark, sf_dir, list(M.PRESETS.values()), shared_path(spark, "runs", uuid.uuid4().hex))


# ---------------------------------------------------------------- isolation forest, streaming
@register("outlier_stats_isolation_forest")
def q_outlier_stats_isolation_forest(spark, sf_dir):
    """O3 + O4: an isolation forest per event type (100 trees, 256-row samples, contamination 0.1, seed 42)."""
    from tsforge.operators.outliers import flag_outliers, outlier_stats
    return outlier_stats(flag_outliers(_hourly_filled(spark, sf_dir), "value", "isolation_forest"), "isolation_forest")


@register("isolation_forest_shares", f"""WITH {FILLED}
SELECT series, CAST(count(*) AS BIGINT) AS rows, true AS within_contamination FROM filled GROUP BY 1""")
def q_isolation_forest_shares(spark, sf_dir):
    """O3's properties: every row scored between 0 and 1, and at most a tenth of each series' rows (rounded up) flagged."""
    from tsforge.operators.outliers import flag_outliers
    flagged = flag_outliers(_hourly_filled(spark, sf_dir), "value", "isolation_forest")
    fine = (F.count_if("is_outlier") <= F.ceil(0.1 * F.count(F.lit(1)))) & (F.min("anomaly_score") > 0) & (F.max("anomaly_score") <= 1)
    return flagged.groupBy(SERIES).agg(F.count("anomaly_score").alias("rows"), fine.alias("within_contamination"))


@register("stream_hourly_means", """SELECT event_type AS series, date_trunc('hour', ts) AS ts,
  (round(CAST(avg(value) AS DOUBLE) * 10000) / 10000 + 0.0) AS value, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1, 2""")
def q_stream_hourly_means(spark, sf_dir):
    """R1 as Structured Streaming: file source -> watermark -> hourly window state -> table (availableNow)."""
    import uuid
    from tsforge.session import shared_path
    from tsforge.streaming.hourly import hourly_means_stream, run_available
    run = uuid.uuid4().hex
    stream = hourly_means_stream(spark, f"{sf_dir.rstrip('/')}/events*.parquet")
    return run_available(stream, shared_path(spark, "streams", run, "table"), shared_path(spark, "streams", run, "checkpoint"))


# ---------------------------------------------------------------- chart tables and report slices
@register("weekday_weekend_means", f"""WITH {FILLED}
SELECT series, {Q.r4('avg(value) FILTER (WHERE isodow(ts) >= 6)', 'weekend_mean')},
  {Q.r4('avg(value) FILTER (WHERE isodow(ts) < 6)', 'weekday_mean')} FROM filled GROUP BY 1""")
def q_weekday_weekend_means(spark, sf_dir):
    """Weekend vs weekday means per series."""
    from tsforge.plans.charts import weekday_weekend_means
    return weekday_weekend_means(_hourly_filled(spark, sf_dir), "value")


@register("head_tail_slices", f"""WITH {FILLED},
p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM filled)
SELECT series, ts, {Q.r4('value', 'value')}, 'first' AS slice FROM p WHERE i < 168
UNION ALL SELECT series, ts, {Q.r4('value', 'value')}, 'last' AS slice FROM p WHERE i >= n - 24""")
def q_head_tail_slices(spark, sf_dir):
    """P20: first week and last 24 hours of each series."""
    from tsforge.plans.charts import head_tail
    return head_tail(_hourly_filled(spark, sf_dir), 168, 24).drop("_idx")


@register("metric_comparison", f"""WITH {FILLED}, {_BASE_SQL},
m AS (SELECT series, model, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
  100 * avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) AS mape FROM lng GROUP BY 1, 2)
SELECT series, model, 'mae' AS metric, {Q.r4('coalesce(mae, 0)', 'value')} FROM m
UNION ALL SELECT series, model, 'rmse', {Q.r4('coalesce(rmse, 0)', 'value')} FROM m
UNION ALL SELECT series, model, 'mape', {Q.r4('coalesce(mape, 0)', 'value')} FROM m""")
def q_metric_comparison(spark, sf_dir):
    """V4: baseline metrics unpivoted to (model, metric, value), missing as 0."""
    from tsforge.plans.charts import metric_comparison
    from tsforge.plans.metrics import regression_metrics
    return metric_comparison(regression_metrics(_baseline_long(spark, sf_dir), [SERIES, "model"]))


@register("temperature_load_pairs", f"""WITH {_MERGED}
SELECT m.series, m.ts, {Q.r4('m.kwh', 'kwh')}, {Q.r4('wx.temperature_c', 'temperature_c')} FROM merged m JOIN wx ON m.ts = wx.ts""")
def q_temperature_load_pairs(spark, sf_dir):
    """Load with the temperature of the same hour (right side pre-projected)."""
    from tsforge.plans.charts import temperature_load_pairs
    return temperature_load_pairs(_merged(spark, sf_dir).select(SERIES, TS, "kwh"), S.weather_series(spark, sf_dir))


@register("persistence_forecast", f"""WITH {_SCEN}
SELECT scenario, CAST(step AS BIGINT) AS step, end_ts + INTERVAL 1 HOUR * step AS ts, {Q.r4('recent[-1]', 'prediction')}, CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, unnest(range(1, horizon + 1)) AS step FROM scw)""")
def q_persistence_forecast(spark, sf_dir):
    """Last value repeated over each scenario's horizon."""
    from tsforge.plans.charts import persistence_forecast
    return persistence_forecast(_scenarios(spark, sf_dir))


@register("serving_features", f"""WITH {FILLED}, c AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM filled)
SELECT series, ts, {Q.r4('value', 'value')},
  {', '.join(Q.r4(f'CASE WHEN n > {k} THEN lag(value, {k}) OVER ({_WS}) END', f'value_lag_{k}h') for k in (1, 2, 24))},
  {', '.join(Q.r4(f"CASE WHEN n > {k} THEN {Q.rolling_sql('value', k, 'mean')} END", f'value_rolling_{k}h_mean') for k in (6, 24))}
FROM c""")
def q_serving_features(spark, sf_dir):
    """Serving lags 1, 2, 24 and rolling means 6, 24 with series-length guards."""
    from tsforge.plans.charts import serving_features
    return serving_features(_hourly_filled(spark, sf_dir), "value")


@register("frame_shape", f"""WITH {_LOAD}, {_WX}, {_weather_filled()}, {_LIQR}
SELECT series, CAST(count(*) AS BIGINT) AS rows, CAST(25 AS BIGINT) AS columns FROM pre GROUP BY 1""")
def q_frame_shape(spark, sf_dir):
    """Rows per series and columns of the preprocessed frame (series, ts + 23 columns)."""
    from tsforge.plans.charts import frame_shape
    from tsforge.plans.preprocess import preprocess
    processed, _, _ = preprocess(S.load_series(spark, sf_dir, raw=True), S.weather_series(spark, sf_dir))
    return frame_shape(processed)


# ---------------------------------------------------------------- time-based windows, shifted features
_TW = "PARTITION BY series ORDER BY epoch(ts) RANGE BETWEEN {b} PRECEDING AND CURRENT ROW"


@register("rolling_by_time", f"""WITH {HOURLY}, kept AS (SELECT * FROM hourly WHERE value IS NOT NULL)
SELECT series, ts, {Q.r4('value', 'value')}, {', '.join(
    f"CAST(count(value) OVER ({_TW.format(b=h * 3600 - 1)}) AS BIGINT) AS value_last_{h}h_count" if st == 'count' else
    Q.r4(f"{fn}(value) OVER ({_TW.format(b=h * 3600 - 1)})" if st != 'mean' else
         f"list_sum(list(value) OVER ({_TW.format(b=h * 3600 - 1)})) / count(value) OVER ({_TW.format(b=h * 3600 - 1)})", f'value_last_{h}h_{st}')
    for h in (6, 24, 168) for st, fn in (('mean', 'avg'), ('std', 'stddev_samp'), ('min', 'min'), ('max', 'max'), ('count', 'count')))} FROM kept""")
def q_rolling_by_time(spark, sf_dir):
    """W2-W5, mode by time: statistics of the last 6, 24 and 168 hours where hours are missing."""
    from tsforge.operators.nulls import drop_missing
    from tsforge.operators.sequence import apply_time_windows
    kept = drop_missing(S.hourly_by_type(spark, sf_dir), ["value"])
    return apply_time_windows(kept, lambda w: W.time_rolling_columns("value", [6, 24, 168], ["mean", "std", "min", "max", "count"], w), 168 * 3600)


def _shift_sql() -> str:
    rolls = ", ".join(Q.r4(Q.rolling_sql("past", n, st), f"value_rolling_{n}h_{st}") for n in (6, 24) for st in ("mean", "max"))
    return f"""WITH {FILLED}, sh AS (SELECT *, lag(value) OVER ({_WS}) AS past FROM filled)
SELECT series, ts, {Q.r4('value', 'value')}, {_lags_sql('value', [1, 24])}, {rolls} FROM sh"""


@register("shifted_features", _shift_sql())
def q_shifted_features(spark, sf_dir):
    """W1-W5 with shift 1: rolling frames end one row earlier, so no feature holds the target it predicts."""
    from tsforge.plans.features import FeatureConfig, window_features
    cfg = FeatureConfig(target="value", lags=[1, 24], windows=[6, 24], stats=["mean", "max"], alphas=[], statistical=False, shift=1)
    return window_features(_hourly_filled(spark, sf_dir), cfg)


# ---------------------------------------------------------------- nulls, joins, ranks, charts, sinks
@register("median_fill", f"""WITH {HOURLY}, m AS (SELECT {Q.agg_quantile('value', 0.5)} AS v FROM hourly)
SELECT series, ts, {Q.r4('coalesce(value, m.v)', 'value')} FROM hourly CROSS JOIN m""")
def q_median_fill(spark, sf_dir):
    """Empty hours take the exact median over all rows."""
    from tsforge.operators.nulls import median_fill
    return median_fill(S.hourly_by_type(spark, sf_dir), ["value"])


@register("zero_fill", f"WITH {HOURLY} SELECT series, ts, {Q.r4('coalesce(value, 0)', 'value')} FROM hourly")
def q_zero_fill(spark, sf_dir):
    """Empty hours are 0."""
    from tsforge.operators.nulls import zero_fill
    return zero_fill(S.hourly_by_type(spark, sf_dir), ["value"])


@register("merge_left_defaults", f"""WITH {HOURLY}, {_WX}, g AS (SELECT date_trunc('day', ts) + INTERVAL 2 HOUR * (hour(ts) // 2) AS ts, avg(temperature_c) AS temperature_c,
  avg(humidity_percent) AS humidity_percent FROM wx GROUP BY 1)
SELECT h.series, h.ts, {Q.r4('h.value', 'value')}, {Q.r4('coalesce(g.temperature_c, 20)', 'temperature_c')},
  {Q.r4('coalesce(g.humidity_percent, 60)', 'humidity_percent')} FROM hourly h LEFT JOIN g ON h.ts = g.ts""")
def q_merge_left_defaults(spark, sf_dir):
    """Every load hour keeps its row; hours that a two-hourly weather source (means of two hours) lacks get the
    default weather."""
    from tsforge.operators.joins import merge_on_time
    from tsforge.operators.nulls import with_defaults
    from tsforge.plans.scoring import DEFAULT_WEATHER
    wx = S.weather_series(spark, sf_dir).groupBy(F.window(TS, "2 hours").alias("w")).agg(
        F.avg("temperature_c").alias("temperature_c"), F.avg("humidity_percent").alias("humidity_percent")) \
        .select(F.col("w.start").alias(TS), "temperature_c", "humidity_percent")
    merged = merge_on_time(S.hourly_by_type(spark, sf_dir), wx, "left")
    return with_defaults(merged, {c: DEFAULT_WEATHER[c] for c in ("temperature_c", "humidity_percent")})


@register("missing_stamps", f"""WITH {HOURLY} SELECT series, ts FROM hourly h
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = h.series AND date_trunc('hour', e.ts) = h.ts)""")
def q_missing_stamps(spark, sf_dir):
    """Spine stamps without an observation."""
    from tsforge.operators.joins import missing_stamps
    return missing_stamps(S.hourly_by_type(spark, sf_dir).select(SERIES, TS), _gap_input(spark, sf_dir))


@register("aligned_predictions", f"""WITH {FILLED}, {_BASE_SQL}
SELECT f.series, f.ts, {Q.r4('f.value', 'value')}, lng.model, {Q.r4('p', 'y_pred')} FROM filled f JOIN lng ON f.series = lng.series AND f.ts = lng.ts""")
def q_aligned_predictions(spark, sf_dir):
    """Predictions meet their actual values by series and stamp, never by position."""
    from tsforge.operators.joins import align_predictions
    truth = _hourly_filled(spark, sf_dir).drop(IDX)
    return align_predictions(truth, _baseline_long(spark, sf_dir).select(SERIES, TS, "model", "y_pred"))


@register("ranked_models", f"""WITH {FILLED}, {_BASE_SQL}, m AS (SELECT model, {_METRIC_COLS} FROM lng GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY rmse NULLS LAST, model) AS BIGINT) AS rank FROM m""")
def q_ranked_models(spark, sf_dir):
    """Models by RMSE, NULLs last (one row per model)."""
    from pyspark.sql import Window
    from tsforge.plans.metrics import ranked, regression_metrics
    order = ranked(regression_metrics(_baseline_long(spark, sf_dir), ["model"]))
    return order.withColumn("rank", F.row_number().over(Window.orderBy(F.col("rmse").asc_nulls_last(), "model")))


@register("series_table", f"""WITH {FILLED} SELECT series, date_trunc('day', ts) AS ts, {Q.r4('avg(value)', 'value')} FROM filled GROUP BY 1, 2""")
def q_series_table(spark, sf_dir):
    """V1: the series to plot, downsampled to daily means."""
    from tsforge.plans.charts import series_table
    return series_table(_hourly_filled(spark, sf_dir).drop(IDX), ["value"], "D")


@register("residual_histogram", f"""WITH {FILLED}, {_BASE_SQL}, r AS (SELECT series, model, y - p AS e FROM lng WHERE y - p IS NOT NULL),
rg AS (SELECT series, model, min(e) AS lo, max(e) AS hi FROM r GROUP BY 1, 2),
b AS (SELECT r.series, r.model, lo, hi, CAST(CASE WHEN hi > lo THEN least(floor((e - lo) / (hi - lo) * 30) + 1, 30) ELSE 1 END AS BIGINT) AS bin
  FROM r JOIN rg USING (series, model))
SELECT series, model, bin, {Q.r4('lo + (bin - 1) * ((hi - lo) / 30)', 'bin_lo')}, {Q.r4('lo + bin * ((hi - lo) / 30)', 'bin_hi')},
  CAST(count(*) AS BIGINT) AS count FROM b GROUP BY series, model, bin, lo, hi""")
def q_residual_histogram(spark, sf_dir):
    """30 bins of each baseline's residuals."""
    from tsforge.operators.aggregates import histogram
    from tsforge.plans.charts import residual_table
    return histogram(residual_table(_baseline_long(spark, sf_dir)), "residual", 30, [SERIES, "model"])


@register("dashboard", f"""WITH {FILLED}, {_BASE_SQL},
m AS (SELECT model, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse FROM lng GROUP BY 1),
bst AS (SELECT arg_min(model, rmse) AS model, min(rmse) AS rmse FROM m),
r AS (SELECT model, y - p AS e FROM lng JOIN bst USING (model) WHERE y - p IS NOT NULL),
rg AS (SELECT min(e) AS lo, max(e) AS hi FROM r), mg AS (SELECT min(mae) AS lo, max(mae) AS hi FROM m),
rb AS (SELECT model, CAST(CASE WHEN hi > lo THEN least(floor((e - lo) / (hi - lo) * 20) + 1, 20) ELSE 1 END AS BIGINT) AS bin FROM r CROSS JOIN rg),
mb AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor((mae - lo) / (hi - lo) * 20) + 1, 20) ELSE 1 END AS BIGINT) AS bin FROM m CROSS JOIN mg)
SELECT 'models by rmse' AS panel, model, 'rmse' AS item, {Q.r4('rmse', 'value')} FROM m
UNION ALL SELECT 'best model', model, 'rmse', {Q.r4('rmse', 'value')} FROM bst
UNION ALL SELECT 'residuals', model, CAST(bin AS VARCHAR), CAST(count(*) AS DOUBLE) FROM rb GROUP BY model, bin
UNION ALL SELECT 'mae', NULL, CAST(bin AS VARCHAR), CAST(count(*) AS DOUBLE) FROM mb GROUP BY bin""")
def q_dashboard(spark, sf_dir):
    """V7: the dashboard's panels of the baselines as one long table."""
    from tsforge.plans.charts import dashboard
    from tsforge.plans.metrics import regression_metrics
    long = _baseline_long(spark, sf_dir)
    return dashboard(regression_metrics(long, ["model"]), long)


@register("sink_round_trip", f"WITH {_MERGED} SELECT series, ts, {_MCOLS} FROM merged")
def q_sink_round_trip(spark, sf_dir):
    """The merged frame written partitioned by series and read back."""
    import uuid
    from tsforge.session import shared_path
    from tsforge.sources.files import read_frame, write_frame
    merged = _merged(spark, sf_dir)
    path = shared_path(spark, "frames", uuid.uuid4().hex)
    write_frame(merged, path)
    return read_frame(spark, path, merged)


_FAULTS = """f AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS t, o_totalprice AS v, o_orderkey % 13 AS k FROM orders),
r AS (SELECT *, CASE k WHEN 1 THEN 'time' WHEN 2 THEN 'no time' WHEN 3 THEN 'number: kwh' WHEN 4 THEN 'line' WHEN 5 THEN 'line' END AS reason FROM f)"""


@register("bucketed_merge", f"WITH {_MERGED} SELECT series, ts, {_MCOLS} FROM merged")
def q_bucketed_merge(spark, sf_dir):
    """Load and weather written in buckets of their join key and merged where they lie."""
    import uuid
    from tsforge.operators.joins import merge_on_time
    from tsforge.session import shared_path
    from tsforge.sources.files import write_bucketed
    path = shared_path(spark, "buckets", uuid.uuid4().hex)
    load = write_bucketed(S.load_series(spark, sf_dir), f"{path}/load", [TS], 16)
    return merge_on_time(load, write_bucketed(S.weather_series(spark, sf_dir), f"{path}/weather", [TS], 16))


@register("stream_merge", f"WITH {_MERGED} SELECT series, ts, {_MCOLS} FROM merged")
def q_stream_merge(spark, sf_dir):
    """J1 on two streams: hourly load and weather arrive in two runs, the weather an hour late; rows of the first run find
    their partner in the second."""
    import uuid
    from tsforge.session import shared_path
    from tsforge.streaming.hourly import merge_streams, run_appending
    path = shared_path(spark, "streams", uuid.uuid4().hex)
    load, weather = S.load_series(spark, sf_dir), S.weather_series(spark, sf_dir)
    middle = load.agg(F.timestamp_seconds((F.unix_seconds(F.min(TS)) + F.unix_seconds(F.max(TS))) / 2)).first()[0]
    out = None
    for first in (True, False):
        for name, df, late in (("load", load, 0), ("weather", weather, 1)):
            early = F.col(TS) < F.lit(middle) - F.expr(f"INTERVAL {late} HOURS")
            df.where(early if first else ~early).write.mode("append").parquet(f"{path}/{name}")
        streams = [spark.readStream.schema(df.schema).parquet(f"{path}/{name}") for name, df in (("load", load), ("weather", weather))]
        out = run_appending(merge_streams(*streams), f"{path}/table", f"{path}/checkpoint")
    return out


@register("stream_scenarios", f"""WITH {_SCEN}, {_STEPS}
SELECT scenario, CAST(step AS BIGINT) AS step, end_ts + INTERVAL 1 HOUR * (step + 1) AS ts,
  {Q.r4('m3 * (1 + 0.3 * sin(2 * pi() * step / 24)) * (1 + 0.0)', 'prediction')}, CAST(NULL AS VARCHAR) AS error FROM st""")
def q_stream_scenarios(spark, sf_dir):
    """M16, M18 on a stream: requests arrive as files and are scored as they come."""
    import uuid
    from tsforge.plans.scoring import heuristic_horizon
    from tsforge.session import shared_path
    from tsforge.streaming.hourly import score_stream
    path = shared_path(spark, "streams", uuid.uuid4().hex)
    asked = _scenarios(spark, sf_dir)
    asked.repartition(3).write.parquet(f"{path}/in")
    arriving = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    score_stream(arriving, lambda batch: heuristic_horizon(batch, "daily"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("epoch")


@register("csv_quarantine", f"""WITH {_FAULTS}
SELECT coalesce(reason, 'good') AS reason, CAST(count(*) AS BIGINT) AS lines, {Q.r4('sum(CASE WHEN reason IS NULL AND k <> 6 THEN v END)', 'kwh')},
  CAST(count(*) FILTER (WHERE reason IS NULL AND k = 6) AS BIGINT) AS empty FROM r GROUP BY 1""")
def q_csv_quarantine(spark, sf_dir):
    """Orders written as CSV lines of which 5 in 13 are damaged, read back and sorted into good rows and
    lines set aside by reason."""
    import uuid
    from tsforge.session import shared_path
    from tsforge.sources.files import LOAD_SCHEMA, checked_series_csv, write_quarantine
    from tsforge.sources.tables import read_table
    k = F.pmod("o_orderkey", F.lit(13))
    stamp = F.when(k == 1, "soon").when(k == 2, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    value = F.when(k == 3, "n/a").when(k == 6, "").otherwise(F.col("o_totalprice").cast("string"))
    line = F.when(k == 4, F.concat_ws(",", stamp, value, F.lit("more"))).when(k == 5, stamp).otherwise(F.concat_ws(",", stamp, value))
    path = shared_path(spark, "csv", uuid.uuid4().hex)
    read_table(spark, sf_dir, "orders").select(line.alias("value")).write.text(f"{path}/load")
    good, bad = checked_series_csv(spark, f"{path}/load", LOAD_SCHEMA, "orders", header=False)
    kept = good.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("lines"), F.sum("kwh").alias("kwh"), F.count_if(F.col("kwh").isNull()).alias("empty"))
    return kept.unionByName(write_quarantine(bad, f"{path}/quarantine").withColumn("empty", F.lit(0).cast("long")), allowMissingColumns=True)


@register("model_registry", f"""WITH {FILLED}, {_BASE_SQL},
m AS (SELECT series, model, {_METRIC_COLS} FROM lng GROUP BY 1, 2),
v AS (SELECT CASE series WHEN 'click' THEN '20240101_000000' ELSE '20240102_000000' END AS version, model, rmse, r2 FROM m WHERE series IN ('click', 'purchase'))
SELECT version, model, rmse, version = max(version) OVER () AS latest, model = arg_min(model, rmse) OVER (PARTITION BY version) AS best_rmse,
  model = arg_max(model, r2) OVER (PARTITION BY version) AS best_r2 FROM v""")
def q_model_registry(spark, sf_dir):
    """Two versions of three models saved with their metrics, a third that breaks off before it is committed; then
    listed, the latest found, and the best of each version by two metrics."""
    import uuid
    from pyspark.ml import PipelineModel
    from tsforge.plans import registry as R
    from tsforge.plans.metrics import regression_metrics
    from tsforge.session import cut_lineage, shared_path
    base = shared_path(spark, "registry", uuid.uuid4().hex)
    metrics = cut_lineage(regression_metrics(_baseline_long(spark, sf_dir), [SERIES, "model"]))
    models = {n: PipelineModel([]) for n in ("naive_24h", "seasonal_naive", "moving_avg_24h")}
    versions = {"click": "20240101_000000", "purchase": "20240102_000000"}
    for series, version in versions.items():
        R.save_models(spark, base, models, metrics.where(F.col(SERIES) == series), [], version)
    try:
        R.save_models(spark, base, {**models, "broken": None}, metrics, [], "20240103_000000")
    except AttributeError:
        pass
    out = R.list_models(spark, base).join(R.latest_version(spark, base).select("version", F.lit(True).alias("latest")), "version", "left")
    for metric in ("rmse", "r2"):
        best = [R.best_entry(spark, base, v, metric).select("version", "model", F.lit(True).alias(f"best_{metric}")) for v in versions.values()]
        out = out.join(best[0].unionByName(best[1]), ["version", "model"], "left")
    return out.select("version", "model", F.col("metrics")["rmse"].alias("rmse"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("latest", "best_rmse", "best_r2")])


def _feature_groups_sql() -> str:
    """Membership of the columns that DuckDB itself lists for the engineered frame."""
    from tsforge.plans.features import FEATURE_GROUPS
    groups = ", ".join(f"('{g}', '{frag}')" for g, frags in FEATURE_GROUPS for frag in frags)
    return f"""WITH d AS (SELECT column_name AS feature FROM (DESCRIBE {_engineered_sql()}))
SELECT DISTINCT feature, g."group" FROM d JOIN (VALUES {groups}) g("group", fragment)
ON contains(feature, fragment) WHERE feature NOT IN ('series', 'ts', 'kwh')"""


@register("feature_groups", _feature_groups_sql())
def q_feature_groups(spark, sf_dir):
    """F32: every engineered column with each group it belongs to."""
    from tsforge.plans.features import feature_catalogue, feature_names_of
    return feature_catalogue(spark, feature_names_of(_engineered(spark, sf_dir))).drop("position")


_TRAINING = f"""e AS ({_engineered_sql()}),
l AS (SELECT series, ts, kwh, list_value(*COLUMNS(* EXCLUDE (series, ts, kwh))) AS f FROM e),
k AS (SELECT series, ts, kwh, row_number() OVER ({_WS}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM l
  WHERE kwh IS NOT NULL AND len(list_filter(f, lambda x: x IS NULL)) < 0.5 * len(f)),
t AS (SELECT *, i >= floor(n * 0.8) AS is_test FROM k)"""


@register("training_split", f"WITH {_TRAINING} SELECT series, ts, {Q.r4('kwh', 'label')}, is_test FROM t")
def q_training_split(spark, sf_dir):
    """The rows models are fitted and tested on (target present, fewer than half of the features missing)."""
    from tsforge.plans import models as M
    frame, _ = M.training_frame(_engineered(spark, sf_dir), "kwh")
    return frame.select(SERIES, TS, "label", "is_test")


@register("cv_fold_bounds", f"""WITH {_TRAINING}, tr AS (SELECT *, count(*) OVER (PARTITION BY series) AS m FROM t WHERE NOT is_test),
fo AS (SELECT tr.*, fold, m - (3 - fold) * floor(m / 4) AS cut, floor(m / 4) AS size FROM tr CROSS JOIN (VALUES (0), (1), (2)) v(fold)),
h AS (SELECT *, i >= cut AS held FROM fo WHERE i < cut + size)
SELECT series, CAST(fold AS BIGINT) AS fold, held, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM h GROUP BY 1, 2, 3""")
def q_cv_fold_bounds(spark, sf_dir):
    """M8: rows and time span of the training and the held-out part of each expanding fold."""
    from tsforge.plans import models as M
    frame, _ = M.training_frame(_engineered(spark, sf_dir), "kwh")
    folds = M.cv_folds(frame.where("NOT is_test"), 3)
    return folds.groupBy(SERIES, "fold", "held").agg(F.count(F.lit(1)).alias("n"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))


@register("request_forecast")
def q_request_forecast(spark, sf_dir):
    """A forest fitted on the serving features of the load series, applied to the whole batch of
    requests; every request is answered with its steps or its error."""
    from tsforge.plans import models as M
    from tsforge.plans.charts import serving_features
    from tsforge.plans.preprocess import add_time_features
    known = serving_features(add_time_features(_merged(spark, sf_dir)), "kwh")
    frame, feats = M.training_frame(known, "kwh")
    model = M.fit(frame, feats, M.PRESETS["random_forest"])
    return M.forecast_requests(model, _requests(spark, sf_dir), feats, "kwh", "random_forest")
