"""Scenario scoring.

A request becomes a row of a scenario table
``(scenario string, end_ts timestamp, recent array<double>, weather struct, horizon int)``;
many scenarios are scored by one DataFrame job, each carrying its own ``error``
instead of raising. Horizons are exploded with ``sequence(0, horizon-1)``
(at most 720 steps, checked first). Clock time is an explicit column, never
the wall clock, so results are reproducible.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.operators.joins import join_same
from tsforge.sources.series import WEATHER_COLUMNS

MAX_HORIZON = 720
SHORT_HISTORY = "fewer than three numeric values"
# Fixed default weather of a request without weather (the reference's serving defaults).
DEFAULT_WEATHER = {"temperature_c": 20.0, "humidity_percent": 60.0, "wind_speed_kmh": 10.0,
                   "precipitation_mm": 0.0, "cloud_cover_percent": 50.0, "solar_irradiance_wm2": 300.0}
TWO_PI = 2.0 * math.pi


def scenarios_from_series(df: DataFrame, target: str, weather: DataFrame | None = None,
                          history: int = 24, horizon: int = 24) -> DataFrame:
    """One scenario per series: its last ``history`` hourly values (time-ordered),
    the weather at its last stamp, and a horizon. Only the last ``history`` hours of
    each series are gathered (filtered before any collect)."""
    end = df.groupBy(SERIES).agg(F.max(TS).alias("end_ts"))
    recent = (join_same(df, end, [SERIES])
                .where(F.col(TS) > F.col("end_ts") - F.expr(f"INTERVAL {history} HOURS"))
                .groupBy(SERIES, "end_ts")
                .agg(F.array_sort(F.collect_list(F.struct(TS, F.col(target).alias("v")))).alias("_h")))
    sc = recent.select(F.col(SERIES).alias("scenario"), "end_ts",
                       F.transform("_h", lambda e: e["v"]).alias("recent"), F.lit(horizon).alias("horizon"))
    if weather is not None:
        wcols = [c for c in WEATHER_COLUMNS if c in weather.columns]
        wx = weather.select(F.col(TS).alias("end_ts"), F.struct(*wcols).alias("weather"))
        sc = sc.join(wx, "end_ts", "left")
    else:
        sc = sc.withColumn("weather", F.lit(None).cast(
            "struct<" + ",".join(f"{c}:double" for c in WEATHER_COLUMNS) + ">"))
    return sc


def coerce_numeric(values: Column) -> Column:
    """Keep the elements that parse as numbers (array<string> or array<double>)."""
    return F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: v.isNotNull())


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def checked(sc: DataFrame) -> DataFrame:
    """``recent`` reduced to its numeric values, and why a request cannot be scored as ``error``
    (NULL when it can): its horizon is looked at before its history."""
    return horizon_check(sc).withColumn("recent", F.coalesce(coerce_numeric(F.col("recent")), F.array().cast("array<double>"))) \
        .withColumn("error", F.coalesce("error", F.when(F.size("recent") < 3, F.lit(SHORT_HISTORY))))


def heuristic_next_hour(sc: DataFrame, weather_factor: bool = True) -> DataFrame:
    """Mean of the last 3 x trend x hourly factor (x weather factor).

    trend = mean(last 3) / mean(3 before) when >= 6 values and that mean > 0, else 1;
    hourly factor = 1 + 0.2 sin(2 pi (h - 6) / 24) with h the hour of ``end_ts``;
    weather factor 1.1 when temperature > 25 or < 15 (default 20). Fewer than 3
    numeric values -> ``error``.
    """
    vals = F.coalesce(coerce_numeric(F.col("recent")), F.array().cast("array<double>"))
    n = F.size(vals)
    last3 = F.slice(vals, -3, 3)
    prev3 = F.when(n >= 6, F.slice(vals, -6, 3))
    m3 = _mean(last3)
    p3 = F.when(n >= 6, _mean(prev3))
    trend = F.when((n >= 6) & (p3 > 0), m3 / p3).otherwise(F.lit(1.0))
    hourly = 1.0 + 0.2 * F.sin(TWO_PI * (F.hour("end_ts") - 6) / 24)
    temp = F.coalesce(F.col("weather.temperature_c"), F.lit(DEFAULT_WEATHER["temperature_c"]))
    wf = F.when((temp > 25) | (temp < 15), F.lit(1.1)).otherwise(F.lit(1.0)) if weather_factor else F.lit(1.0)
    ok = n >= 3
    return sc.select(
        "scenario", "end_ts",
        F.when(ok, m3).alias("recent_average"), F.when(ok, trend).alias("trend_factor"),
        F.when(ok, hourly).alias("hourly_factor"), F.when(ok, wf).alias("weather_factor"),
        F.when(ok, m3 * trend * hourly * wf).alias("prediction"),
        F.when(~ok, F.lit(SHORT_HISTORY)).alias("error"))


def horizon_check(sc: DataFrame) -> DataFrame:
    """``error`` for horizons outside 1..720 (checked before any history use)."""
    fine = F.coalesce(F.col("horizon").between(1, MAX_HORIZON), F.lit(False))
    return sc.withColumn("error", F.when(~fine, F.lit(f"horizon outside 1..{MAX_HORIZON}")))


def steps_of(sc: DataFrame, first: int = 0) -> DataFrame:
    """Checked requests, one row per step from ``first`` on; a request with an error is one row without a step."""
    count = F.when(F.col("error").isNull(), F.sequence(F.lit(first), F.col("horizon").cast("int") - 1 + first))
    return checked(sc).select("scenario", "end_ts", "recent", "error", F.explode_outer(count).alias("step"))


def heuristic_horizon(sc: DataFrame, variant: str = "daily_weekly", noise_sd: float = 0.0, seed: int = 42) -> DataFrame:
    """M18 ("daily") / M19 ("daily_weekly"): one row per (scenario, step), and one with ``error`` per request
    that cannot be scored.

    daily: mean3 * (1 + 0.3 sin(2 pi i / 24)) * (1 + N(0, sd)).
    daily_weekly: mean3 * (1 + 0.3 sin(2 pi (hod - 6) / 24)) * (1.1 weekday | 0.9 weekend) * N(1, sd),
    floored at 0.1; hod = (hour(end_ts) + i) % 24, dow = (weekday(end_ts) + i div 24) % 7.
    Noise is off by default (sd 0) and seeded when on.
    """
    m3 = _mean(F.slice(F.col("recent"), -3, 3))
    i = F.col("step")
    noise = F.randn(seed) * noise_sd if noise_sd else F.lit(0.0)
    if variant == "daily":
        pred = m3 * (1 + 0.3 * F.sin(TWO_PI * i / 24)) * (1 + noise)
    else:
        hod = (F.hour("end_ts") + i) % 24
        dow = (F.weekday("end_ts") + F.floor(i / 24).cast("int")) % 7
        weekly = F.when(dow < 5, F.lit(1.1)).otherwise(F.lit(0.9))
        pred = F.greatest(F.lit(0.1), m3 * (1 + 0.3 * F.sin(TWO_PI * (hod - 6) / 24)) * weekly * (1 + noise))
    return steps_of(sc).select("scenario", "step", (F.col("end_ts") + F.expr("INTERVAL 1 HOUR") * (i + 1)).alias(TS),
                               F.when(i.isNotNull(), pred).alias("prediction"), "error")


def request_variants(sc: DataFrame) -> DataFrame:
    """A batch of requests in the form they arrive (history as text) from sound scenarios: for each, one sound
    request and one of each kind that is incomplete or wrong."""
    text = F.transform("recent", lambda v: v.cast("string"))
    n = F.size("recent")
    none = F.lit(None).cast(sc.schema["weather"].dataType)
    kinds = [("sound", text, F.lit(24), F.col("weather")),
             ("text", F.transform(text, lambda v, i: F.when(i == n - 1, F.lit("n/a")).otherwise(v)), F.lit(24), F.col("weather")),
             ("gap", F.transform(text, lambda v, i: F.when(i != n - 2, v)), F.lit(24), F.col("weather")),
             ("no weather", text, F.lit(24), none),
             ("short", F.slice(text, -2, 2), F.lit(24), F.col("weather")),
             ("nothing", F.lit(None).cast("array<string>"), F.lit(24), F.col("weather")),
             ("no step", text, F.lit(0), F.col("weather")),
             ("too long", text, F.lit(MAX_HORIZON + 1), F.col("weather"))]
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), r.alias("recent"), h.alias("horizon"), w.alias("weather")) for k, r, h, w in kinds])
    return sc.select("scenario", "end_ts", F.explode(entries).alias("_q")).select(
        F.concat_ws("/", "scenario", "_q.kind").alias("scenario"), "end_ts", "_q.recent", "_q.horizon", "_q.weather")


def request_frame(sc: DataFrame, target: str = "kwh") -> DataFrame:
    """S15 the other way: the history of every request without an error as an hourly series frame that ends at
    ``end_ts``, with its weather on every row (J3) or the defaults (P14). Keeps each row's position as ``_idx``."""
    from tsforge.operators.sequence import IDX
    rows = checked(sc).where("error IS NULL").select("scenario", "end_ts", "weather", F.size("recent").alias("_n"),
                                                      F.posexplode("recent").alias(IDX, target))
    weather = [F.coalesce(F.col(f"weather.{c}"), F.lit(v)).alias(c) for c, v in DEFAULT_WEATHER.items()]
    return rows.select(F.col("scenario").alias(SERIES), (F.col("end_ts") - F.expr("INTERVAL 1 HOUR") * (F.col("_n") - 1 - F.col(IDX))).alias(TS),
                       F.col(IDX).cast("long").alias(IDX), target, *weather)


def forecast_summary(steps: DataFrame, value: str = "prediction", keys: list[str] | None = None) -> DataFrame:
    """Total, average, peak and minimum per scenario, rounded to 3 decimals."""
    keys = keys or ["scenario"]
    v = F.col(value)

    def r3(c: Column) -> Column:  # rounds the binary value (as NumPy does), not its decimal text
        return F.round(c * 1000.0) / 1000.0

    return steps.where(v.isNotNull()).groupBy(*keys).agg(
        r3(F.sum(v)).alias("total_predicted"), r3(F.avg(v)).alias("average_hourly"),
        r3(F.max(v)).alias("peak_hour"), r3(F.min(v)).alias("min_hour"),
        F.count(F.lit(1)).alias("steps"))


def success_count(results: DataFrame) -> DataFrame:
    """Scenarios scored without error."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("successful"), F.count(F.lit(1)).alias("total"))
