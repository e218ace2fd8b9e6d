"""Calendar projections of the time stamp (F1-F14, F28, F31). All built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsforge import TS

TWO_PI = 2.0 * math.pi


def _ts(ts: str | Column) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def day_of_week(ts: str | Column = TS) -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(_ts(ts))


def time_feature_columns(ts: str | Column = TS) -> list[Column]:
    """The preprocessing time block (16 columns): F1, F2, F4-F8."""
    t = _ts(ts)
    hour, dow, month, doy = F.hour(t), day_of_week(t), F.month(t), F.dayofyear(t)
    return [
        hour.alias("hour"), dow.alias("day_of_week"), F.dayofmonth(t).alias("day_of_month"),
        month.alias("month"), F.quarter(t).alias("quarter"), F.year(t).alias("year"),
        doy.alias("day_of_year"),
        F.sin(TWO_PI * hour / 24).alias("hour_sin"), F.cos(TWO_PI * hour / 24).alias("hour_cos"),
        F.sin(TWO_PI * dow / 7).alias("day_of_week_sin"), F.cos(TWO_PI * dow / 7).alias("day_of_week_cos"),
        F.sin(TWO_PI * month / 12).alias("month_sin"), F.cos(TWO_PI * month / 12).alias("month_cos"),
        F.sin(TWO_PI * doy / 365).alias("day_of_year_sin"), F.cos(TWO_PI * doy / 365).alias("day_of_year_cos"),
        (dow >= 5).cast("int").alias("is_weekend"),
    ]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def calendar_feature_columns(ts: str | Column = TS) -> list[Column]:
    """14 named flags/fields plus ``season``."""
    t = _ts(ts)
    hour, dow, month = F.hour(t), day_of_week(t), F.month(t)
    season = (month % 12) / 3
    season = F.floor(season).cast("int") + 1
    peak_m = (hour >= 7) & (hour <= 9)
    peak_e = (hour >= 17) & (hour <= 21)
    return [
        (dow < 5).cast("int").alias("is_business_day"),
        season.alias("season"),
        (season == 1).cast("int").alias("is_winter"),
        (season == 2).cast("int").alias("is_spring"),
        (season == 3).cast("int").alias("is_summer"),
        (season == 4).cast("int").alias("is_fall"),
        ((hour >= 6) & (hour < 12)).cast("int").alias("is_morning"),
        ((hour >= 12) & (hour < 18)).cast("int").alias("is_afternoon"),
        ((hour >= 18) & (hour < 22)).cast("int").alias("is_evening"),
        ((hour >= 22) | (hour < 6)).cast("int").alias("is_night"),
        peak_m.cast("int").alias("is_peak_morning"),
        peak_e.cast("int").alias("is_peak_evening"),
        (peak_m | peak_e).cast("int").alias("is_peak_hours"),
        F.weekofyear(t).alias("week_of_year"),
        F.pmod(F.lit(4) - dow, F.lit(7)).alias("days_to_weekend"),
    ]


def period_flag_columns(ts: str | Column = TS) -> list[Column]:
    """month/quarter/year start and end flags (calendar day, any hour)."""
    t = _ts(ts)
    d = F.to_date(t)
    q_start = F.to_date(F.date_trunc("quarter", t))
    return [
        (F.dayofmonth(t) == 1).cast("int").alias("is_month_start"),
        (d == F.last_day(d)).cast("int").alias("is_month_end"),
        (d == q_start).cast("int").alias("is_quarter_start"),
        (d == F.date_sub(F.add_months(q_start, 3), 1)).cast("int").alias("is_quarter_end"),
        ((F.month(t) == 1) & (F.dayofmonth(t) == 1)).cast("int").alias("is_year_start"),
        ((F.month(t) == 12) & (F.dayofmonth(t) == 31)).cast("int").alias("is_year_end"),
    ]


def generated_time_columns(ts: str | Column = TS) -> list[Column]:
    """The utility time block: preprocessing fields + ISO week + business/period flags."""
    t = _ts(ts)
    base = time_feature_columns(t)
    return base[:7] + [F.weekofyear(t).alias("week_of_year")] + base[7:] + [
        (day_of_week(t) < 5).cast("int").alias("is_business_day")] + period_flag_columns(t)


def name_columns(ts: str | Column = TS) -> list[Column]:
    """English day and month names."""
    t = _ts(ts)
    return [F.date_format(t, "EEEE").alias("day_name"), F.date_format(t, "MMMM").alias("month_name")]


def iso_text(ts: str | Column = TS) -> Column:
    """ISO-8601 text ``yyyy-MM-ddTHH:mm:ss``."""
    return F.date_format(_ts(ts), "yyyy-MM-dd'T'HH:mm:ss")
