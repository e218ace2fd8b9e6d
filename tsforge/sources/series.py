"""Series frames derived from the supplied tables.

Raw observations have the layout ``(series, ts, value)``; hourly/daily frames are
produced by :func:`tsforge.operators.resample.resample` so every series gets a
complete time spine. Definitions follow FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.functions.weather import clamp_high, clamp_low
from tsforge.operators.resample import resample
from tsforge.sources.tables import read_table

# Fixed names of the six weather measures (the reference's column contract).
WEATHER_COLUMNS = [
    "temperature_c", "humidity_percent", "wind_speed_kmh",
    "precipitation_mm", "cloud_cover_percent", "solar_irradiance_wm2",
]


def observations(df: DataFrame, series: str | F.Column, ts: str, value: str, name: str = "value") -> DataFrame:
    """Project any table onto ``(series, ts, <name>)``."""
    s = F.lit(series) if isinstance(series, str) and series not in df.columns else (
        F.col(series) if isinstance(series, str) else series)
    return df.select(s.cast("string").alias(SERIES), F.col(ts).alias(TS), F.col(value).cast("double").alias(name))


def event_observations(spark: SparkSession, sf_dir: str, name: str = "value") -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"])
    return observations(ev, "event_type", "ts", "value", name)


def hourly_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: mean value per hour over all types, one series ``all``, spine-filled."""
    ev = read_table(spark, sf_dir, "events", ["ts", "value"])
    return resample(observations(ev, F.lit("all"), "ts", "value"), "H", how="mean")


def hourly_by_type(spark: SparkSession, sf_dir: str, keep_index: bool = False) -> DataFrame:
    """``events``: mean value per (event_type, hour); empty hours are NULL rows."""
    return resample(event_observations(spark, sf_dir), "H", how="mean", keep_index=keep_index)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice"])
    return resample(observations(o, F.lit("orders"), "o_orderdate", "o_totalprice"), "D", how="sum")


def daily_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_shipdate", "l_extendedprice"])
    return resample(observations(li, F.lit("lineitem"), "l_shipdate", "l_extendedprice"), "D", how="sum")


def load_series(spark: SparkSession, sf_dir: str, event_type: str = "purchase", raw: bool = False) -> DataFrame:
    """The target series ``kwh``: the ``purchase`` events.

    ``raw=True`` returns the observations before resampling (the reference fills
    and resamples itself); otherwise the hourly spine-filled mean.
    """
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"]).where(F.col("event_type") == event_type)
    obs = observations(ev, "event_type", "ts", "value", "kwh")
    return obs if raw else resample(obs, "H", how="mean")


def weather_series(spark: SparkSession, sf_dir: str, exclude: str = "purchase") -> DataFrame:
    """Six weather measures from the hourly means of the other four event types.

    a = view, b = click, c = signup, d = error (FIXTURES.md). One global series
    (no ``series`` column): it joins to any load series on ``ts``.
    """
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"]).where(F.col("event_type") != exclude)
    hourly = (ev.groupBy(F.date_trunc("hour", "ts").alias(TS))
                .pivot("event_type", ["view", "click", "signup", "error"])
                .agg(F.avg("value")))
    a, b, c, d = (F.col(x) for x in ("view", "click", "signup", "error"))
    obs = hourly.select(
        F.lit("weather").alias(SERIES), TS,
        (a % 50 - 10).alias("temperature_c"),
        clamp_high(b, 100.0).alias("humidity_percent"),
        clamp_high(c / 4, 60.0).alias("wind_speed_kmh"),
        clamp_low(d / 100 - 1, 0.0).alias("precipitation_mm"),
        (100 - clamp_high(b, 100.0)).alias("cloud_cover_percent"),
        clamp_high(a * 4, 1000.0).alias("solar_irradiance_wm2"),
    )
    return resample(obs, "H", how="mean").drop(SERIES)


def monthly_orders_hourly(spark: SparkSession, sf_dir: str, keep_index: bool = False) -> DataFrame:
    """Monthly order totals, stamped at the month's first hour, on an hourly spine: about 730 empty hours between values."""
    o = read_table(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice"])
    monthly = o.groupBy(F.date_trunc("month", "o_orderdate").alias(TS)).agg(F.sum("o_totalprice").alias("value"))
    return resample(monthly.select(F.lit("orders").alias(SERIES), TS, "value"), "H", how="mean", keep_index=keep_index)
