"""Weather and time interaction features (F18-F27), emitted only for columns present.

Spark's ``greatest`` skips NULL (``max(0, NULL)`` would be 0), so clamps are
wrapped to keep NULL in, as NumPy's ``maximum`` propagates NaN. Comparisons
with NULL count as false (0), as NaN comparisons do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_low(x: Column, lo: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), x))


def clamp_high(x: Column, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(hi), x))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def weather_feature_columns(columns: list[str]) -> list[Column]:
    have = set(columns)
    out: list[Column] = []
    if "temperature_c" in have:
        t = F.col("temperature_c")
        out += [
            clamp_low(18 - t, 0.0).alias("heating_degree_hours"),
            clamp_low(t - 22, 0.0).alias("cooling_degree_hours"),
            _flag(t < 0).alias("temp_very_cold"),
            _flag((t >= 0) & (t < 10)).alias("temp_cold"),
            _flag((t >= 10) & (t < 25)).alias("temp_mild"),
            _flag((t >= 25) & (t < 35)).alias("temp_warm"),
            _flag(t >= 35).alias("temp_hot"),
        ]
    if {"temperature_c", "humidity_percent"} <= have:
        t, h = F.col("temperature_c"), F.col("humidity_percent")
        wind = F.col("wind_speed_kmh") if "wind_speed_kmh" in have else F.lit(0.0)
        out += [
            (t + 0.33 * (h / 100) - 0.70 * wind - 4.00).alias("apparent_temperature"),
            (100 - ((t - 22) ** 2 + (h - 50) ** 2) / 50).alias("comfort_index"),
        ]
    if {"precipitation_mm", "wind_speed_kmh"} <= have:
        out.append((F.col("precipitation_mm") * 0.5 + clamp_low(F.col("wind_speed_kmh") - 20, 0.0) * 0.1)
                   .alias("weather_severity"))
    if {"solar_irradiance_wm2", "cloud_cover_percent"} <= have:
        out.append((F.col("solar_irradiance_wm2") * (100 - F.col("cloud_cover_percent")) / 100).alias("solar_efficiency"))
    return out


def interaction_feature_columns(columns: list[str]) -> list[Column]:
    have = set(columns)
    out: list[Column] = []
    if {"hour", "day_of_week"} <= have:
        h, d = F.col("hour"), F.col("day_of_week")
        out += [(h * (d < 5).cast("int")).alias("hour_weekday_interaction"),
                (h * (d >= 5).cast("int")).alias("hour_weekend_interaction")]
    if {"temperature_c", "month"} <= have:
        out.append((F.col("temperature_c") * F.col("month")).alias("temp_month_interaction"))
    if {"hour", "day_of_week"} <= have:
        h, d = F.col("hour"), F.col("day_of_week")
        out += [((d >= 5) & (h >= 8) & (h <= 11)).cast("int").alias("weekend_morning"),
                ((d < 5) & (((h >= 7) & (h <= 9)) | ((h >= 17) & (h <= 19)))).cast("int").alias("weekday_rush")]
    return out
