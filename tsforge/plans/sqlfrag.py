"""Oracle SQL fragments (DuckDB dialect) shared by the registered queries.

Each oracle restates an operator in plain SQL over the same parquet views, so
the Spark job is checked against an independent engine.
"""

from __future__ import annotations


def r4(expr: str, alias: str) -> str:
    return f'(round(CAST({expr} AS DOUBLE) * 10000) / 10000 + 0.0) AS "{alias}"'


def spine_cte(name: str, src_select: str, freq: str = "hour", how: str = "avg", value: str = "value",
              fill_zero: bool = False) -> str:
    """CTE ``name`` (series, ts, <value>) - bucket aggregate plus complete spine.

    ``src_select`` must yield (series, ts, v)."""
    step = "INTERVAL 1 HOUR" if freq == "hour" else "INTERVAL 1 DAY"
    val = f"coalesce({name}_b.{value}, 0.0)" if fill_zero else f"{name}_b.{value}"
    return f"""
{name}_src AS ({src_select}),
{name}_b AS (SELECT series, date_trunc('{freq}', ts) AS ts, {how}(v) AS {value} FROM {name}_src GROUP BY 1, 2),
{name}_bounds AS (SELECT series, min(ts) AS lo, max(ts) AS hi FROM {name}_b GROUP BY 1),
{name}_sp AS (SELECT series, unnest(generate_series(lo, hi, {step})) AS ts FROM {name}_bounds),
{name} AS (SELECT {name}_sp.series, {name}_sp.ts, {val} AS {value}
           FROM {name}_sp LEFT JOIN {name}_b ON {name}_sp.series = {name}_b.series AND {name}_sp.ts = {name}_b.ts)"""


EVENTS_BY_TYPE = "SELECT event_type AS series, ts, value AS v FROM events"


def interp_cte(name: str, src: str, col: str) -> str:
    """CTE ``name``: linear interpolation by row position (forward), then ffill/bfill edges."""
    w = "PARTITION BY series ORDER BY ts"
    return f"""
{name}_pos AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS _i FROM {src}),
{name}_nb AS (SELECT *,
    last_value(CASE WHEN {col} IS NOT NULL THEN _i END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _pi,
    last_value({col} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _pv,
    first_value(CASE WHEN {col} IS NOT NULL THEN _i END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _ni,
    first_value({col} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _nv
  FROM {name}_pos),
{name}_i AS (SELECT * EXCLUDE (_pi, _pv, _ni, _nv, {col}),
    CASE WHEN {col} IS NOT NULL THEN {col}
         WHEN _pi IS NOT NULL AND _ni IS NOT NULL THEN _pv + (_nv - _pv) * (_i - _pi) / (_ni - _pi)
         WHEN _pi IS NOT NULL THEN _pv END AS {col}
  FROM {name}_nb),
{name} AS (SELECT * EXCLUDE ({col}, _i), coalesce({col},
    first_value({col} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {col}
  FROM {name}_i)"""


def lag_sql(col: str, n: int, alias: str) -> str:
    return f"lag({col}, {n}) OVER (PARTITION BY series ORDER BY ts)"


def frame(n: int) -> str:
    return f"(PARTITION BY series ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_AGG = {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
        "median": "quantile_cont({c}, 0.5)", "q25": "quantile_cont({c}, 0.25)", "q75": "quantile_cont({c}, 0.75)"}


_Q = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def quantile_of_list(arr: str, q: float) -> str:
    """Linear-interpolated quantile of a sorted non-empty list:
    ``(ceil(p) - p) * s[floor(p)] + (p - floor(p)) * s[ceil(p)]``, ``p = q (n - 1)``."""
    p = f"({q} * (len({arr}) - 1))"
    return (f"CASE WHEN floor({p}) = ceil({p}) THEN {arr}[CAST(floor({p}) AS BIGINT) + 1] "
            f"ELSE (ceil({p}) - {p}) * {arr}[CAST(floor({p}) AS BIGINT) + 1] "
            f"+ ({p} - floor({p})) * {arr}[CAST(ceil({p}) AS BIGINT) + 1] END")


def rolling_sql(col: str, n: int, stat: str) -> str:
    f = frame(n)
    if stat == "mean":
        # frame values summed in time order (as a frame is re-aggregated row by row)
        return f"CASE WHEN count({col}) OVER {f} = {n} THEN list_sum(list({col}) OVER {f}) / {n} END"
    if stat in _Q:
        arr = f"list_sort(list({col}) OVER {f})"
        return f"CASE WHEN count({col}) OVER {f} = {n} THEN {quantile_of_list(arr, _Q[stat])} END"
    return f"CASE WHEN count({col}) OVER {f} = {n} THEN {_AGG[stat].format(c=col)} OVER {f} END"


DOW = "(isodow({t}) - 1)"


def time_cols_sql(t: str = "ts") -> list[str]:
    d = DOW.format(t=t)
    tp = "2 * pi()"
    return [
        f"CAST(hour({t}) AS BIGINT) AS hour", f"CAST({d} AS BIGINT) AS day_of_week",
        f"CAST(day({t}) AS BIGINT) AS day_of_month", f"CAST(month({t}) AS BIGINT) AS month",
        f"CAST(quarter({t}) AS BIGINT) AS quarter", f"CAST(year({t}) AS BIGINT) AS year",
        f"CAST(dayofyear({t}) AS BIGINT) AS day_of_year",
        r4(f"sin({tp} * hour({t}) / 24)", "hour_sin"), r4(f"cos({tp} * hour({t}) / 24)", "hour_cos"),
        r4(f"sin({tp} * {d} / 7)", "day_of_week_sin"), r4(f"cos({tp} * {d} / 7)", "day_of_week_cos"),
        r4(f"sin({tp} * month({t}) / 12)", "month_sin"), r4(f"cos({tp} * month({t}) / 12)", "month_cos"),
        r4(f"sin({tp} * dayofyear({t}) / 365)", "day_of_year_sin"), r4(f"cos({tp} * dayofyear({t}) / 365)", "day_of_year_cos"),
        f"CAST({d} >= 5 AS BIGINT) AS is_weekend",
    ]


def calendar_cols_sql(t: str = "ts") -> list[str]:
    d, h = DOW.format(t=t), f"hour({t})"
    season = f"((month({t}) % 12) // 3 + 1)"
    pm, pe = f"({h} >= 7 AND {h} <= 9)", f"({h} >= 17 AND {h} <= 21)"
    return [
        f"CAST({d} < 5 AS BIGINT) AS is_business_day", f"CAST({season} AS BIGINT) AS season",
        f"CAST({season} = 1 AS BIGINT) AS is_winter", f"CAST({season} = 2 AS BIGINT) AS is_spring",
        f"CAST({season} = 3 AS BIGINT) AS is_summer", f"CAST({season} = 4 AS BIGINT) AS is_fall",
        f"CAST({h} >= 6 AND {h} < 12 AS BIGINT) AS is_morning", f"CAST({h} >= 12 AND {h} < 18 AS BIGINT) AS is_afternoon",
        f"CAST({h} >= 18 AND {h} < 22 AS BIGINT) AS is_evening", f"CAST({h} >= 22 OR {h} < 6 AS BIGINT) AS is_night",
        f"CAST({pm} AS BIGINT) AS is_peak_morning", f"CAST({pe} AS BIGINT) AS is_peak_evening",
        f"CAST({pm} OR {pe} AS BIGINT) AS is_peak_hours", f"CAST(weekofyear({t}) AS BIGINT) AS week_of_year",
        f"CAST(((4 - {d}) % 7 + 7) % 7 AS BIGINT) AS days_to_weekend",
    ]


def weather_cte(name: str = "wx") -> str:
    """Hourly weather measures from the four non-target event types, on a complete spine."""
    def hi(x, v):
        return f"CASE WHEN {x} IS NULL THEN NULL ELSE least({v}, {x}) END"
    return f"""
{name}_b AS (SELECT date_trunc('hour', ts) AS ts,
    avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type = 'click') AS b,
    avg(value) FILTER (WHERE event_type = 'signup') AS c, avg(value) FILTER (WHERE event_type = 'error') AS d
  FROM events WHERE event_type <> 'purchase' GROUP BY 1),
{name}_v AS (SELECT ts, a % 50 - 10 AS temperature_c, {hi('b', '100.0')} AS humidity_percent,
    {hi('c / 4', '60.0')} AS wind_speed_kmh, CASE WHEN d IS NULL THEN NULL ELSE greatest(0.0, d / 100 - 1) END AS precipitation_mm,
    100 - {hi('b', '100.0')} AS cloud_cover_percent, {hi('a * 4', '1000.0')} AS solar_irradiance_wm2 FROM {name}_b),
{name}_sp AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM {name}_v),
{name} AS (SELECT {name}_sp.ts, temperature_c, humidity_percent, wind_speed_kmh, precipitation_mm, cloud_cover_percent,
    solar_irradiance_wm2 FROM {name}_sp LEFT JOIN {name}_v ON {name}_sp.ts = {name}_v.ts)"""


WEATHER_COLS = ["temperature_c", "humidity_percent", "wind_speed_kmh", "precipitation_mm",
                "cloud_cover_percent", "solar_irradiance_wm2"]


def weather_feature_sql() -> list[str]:
    t, h, w = "temperature_c", "humidity_percent", "wind_speed_kmh"

    def fl(c):
        return f"CAST(coalesce({c}, false) AS BIGINT)"
    return [
        r4(f"CASE WHEN {t} IS NULL THEN NULL ELSE greatest(0.0, 18 - {t}) END", "heating_degree_hours"),
        r4(f"CASE WHEN {t} IS NULL THEN NULL ELSE greatest(0.0, {t} - 22) END", "cooling_degree_hours"),
        f"{fl(f'{t} < 0')} AS temp_very_cold", f"{fl(f'{t} >= 0 AND {t} < 10')} AS temp_cold",
        f"{fl(f'{t} >= 10 AND {t} < 25')} AS temp_mild", f"{fl(f'{t} >= 25 AND {t} < 35')} AS temp_warm",
        f"{fl(f'{t} >= 35')} AS temp_hot",
        r4(f"{t} + 0.33 * ({h} / 100) - 0.70 * {w} - 4.00", "apparent_temperature"),
        r4(f"100 - (({t} - 22) ** 2 + ({h} - 50) ** 2) / 50", "comfort_index"),
        r4(f"precipitation_mm * 0.5 + CASE WHEN {w} IS NULL THEN NULL ELSE greatest(0.0, {w} - 20) END * 0.1", "weather_severity"),
        r4("solar_irradiance_wm2 * (100 - cloud_cover_percent) / 100", "solar_efficiency"),
    ]


def interaction_sql() -> list[str]:
    return [
        "CAST(hour * CAST(day_of_week < 5 AS BIGINT) AS BIGINT) AS hour_weekday_interaction",
        "CAST(hour * CAST(day_of_week >= 5 AS BIGINT) AS BIGINT) AS hour_weekend_interaction",
        r4("temperature_c * month", "temp_month_interaction"),
        "CAST(day_of_week >= 5 AND hour >= 8 AND hour <= 11 AS BIGINT) AS weekend_morning",
        "CAST(day_of_week < 5 AND ((hour >= 7 AND hour <= 9) OR (hour >= 17 AND hour <= 19)) AS BIGINT) AS weekday_rush",
    ]


def agg_quantile(col: str, q: float) -> str:
    """Exact interpolated quantile of a group's non-null values (Spark ``percentile`` definition)."""
    return quantile_of_list(f"list_sort(list({col}) FILTER (WHERE {col} IS NOT NULL))", q)
