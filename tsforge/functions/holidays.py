"""Holiday features (F15-F17, J6, J8) from a holiday dimension table.

The dimension is a DataFrame ``(holiday_date date, name string)``; a US federal
calendar is generated here by date arithmetic over a ``sequence`` of years.
Distances use an equi-join on date: each holiday is expanded to the 15 dates
within +-7 days (bounded fan-out), so no range or cross join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge import TS

HOLIDAY_WINDOW_DAYS = 7

# Fixed rules of the US federal holidays (5 U.S.C. 6103), with the first year in force.
# (name, month, rule, first_year); rule: "fixed:<day>", "nth:<weekday 1=Mon>:<n>" or "last:<weekday>".
US_FEDERAL_RULES = [
    ("New Year's Day", 1, "fixed:1", 1870),
    ("Martin Luther King Jr. Day", 1, "nth:1:3", 1986),
    ("Washington's Birthday", 2, "nth:1:3", 1971),
    ("Memorial Day", 5, "last:1", 1971),
    ("Juneteenth National Independence Day", 6, "fixed:19", 2021),
    ("Independence Day", 7, "fixed:4", 1870),
    ("Labor Day", 9, "nth:1:1", 1894),
    ("Columbus Day", 10, "nth:1:2", 1971),
    ("Veterans Day", 11, "fixed:11", 1938),
    ("Thanksgiving", 11, "nth:4:4", 1942),
    ("Christmas Day", 12, "fixed:25", 1870),
]


def _rule_date(year: F.Column, month: int, rule: str) -> F.Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    kind, *args = rule.split(":")
    if kind == "fixed":
        return F.make_date(year, F.lit(month), F.lit(int(args[0])))
    wd = int(args[0]) - 1  # Monday = 0 as in weekday()
    if kind == "nth":
        n = int(args[1])
        shift = F.pmod(F.lit(wd) - F.weekday(first), F.lit(7))
        return F.date_add(first, shift + 7 * (n - 1))
    last = F.last_day(first)
    back = F.pmod(F.weekday(last) - F.lit(wd), F.lit(7))
    return F.date_sub(last, back)


def us_federal_holidays(spark: SparkSession, first_year: int, last_year: int, observed: bool = True) -> DataFrame:
    """US federal holidays for ``first_year..last_year``; with ``observed`` a Saturday
    holiday adds the Friday before and a Sunday holiday the Monday after."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return holidays_for_years(years, observed)


def holidays_covering(df: DataFrame, ts: str = TS, observed: bool = True) -> DataFrame:
    """Holidays for every year the data touches, one year of margin each side (lazy: no driver round trip)."""
    years = (df.agg(F.min(F.year(ts)).alias("lo"), F.max(F.year(ts)).alias("hi"))
               .select(F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("year")))
    return holidays_for_years(years, observed)


def holidays_for_years(years: DataFrame, observed: bool = True) -> DataFrame:
    """Rule table applied to a DataFrame of years (column ``year``)."""
    rows = None
    for name, month, rule, since in US_FEDERAL_RULES:
        d = years.where(F.col("year") >= since).select(
            _rule_date(F.col("year"), month, rule).alias("holiday_date"), F.lit(name).alias("name"))
        rows = d if rows is None else rows.unionByName(d)
    if observed:
        wd = F.weekday("holiday_date")
        obs = rows.where(wd >= 5).select(
            F.when(wd == 5, F.date_sub("holiday_date", 1)).otherwise(F.date_add("holiday_date", 1)).alias("holiday_date"),
            F.concat(F.col("name"), F.lit(" (observed)")).alias("name"))
        rows = rows.unionByName(obs)
    return rows


def holiday_distances(dates: DataFrame, holidays: DataFrame, date_col: str = "date",
                      window: int = HOLIDAY_WINDOW_DAYS) -> DataFrame:
    """Per date: is_holiday, days_to_holiday (next, 1..window, else 0), days_from_holiday.

    ``dates`` is a date dimension (one row per date). Holidays are expanded to
    offsets -window..window and equi-joined on the date.
    """
    hd = holidays.select(F.col("holiday_date")).distinct()
    near = hd.select(F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("k"), "holiday_date") \
             .select(F.date_sub("holiday_date", F.col("k")).alias(date_col), "k")
    # k = holiday - date in days
    per = near.groupBy(date_col).agg(
        F.max((F.col("k") == 0).cast("int")).alias("is_holiday"),
        F.min(F.when(F.col("k") > 0, F.col("k"))).alias("_to"),
        F.min(F.when(F.col("k") < 0, -F.col("k"))).alias("_from"))
    return (dates.select(date_col).distinct().join(per, date_col, "left")
            .select(date_col,
                    F.coalesce("is_holiday", F.lit(0)).alias("is_holiday"),
                    F.coalesce("_to", F.lit(0)).alias("days_to_holiday"),
                    F.coalesce("_from", F.lit(0)).alias("days_from_holiday")))


def add_holiday_features(df: DataFrame, holidays: DataFrame, strict: bool = False, ts: str = TS) -> DataFrame:
    """F15-F17 onto a series frame.

    The per-date table has one row per calendar day of the data's span (a
    proven bound: 366 rows per year); it is joined on the date.
    ``is_holiday_period``: holiday or a distance <= 1; as 0 also means "none
    within 7 days" that is 1 on most rows (reference behaviour); ``strict``
    requires a distance of exactly 1.
    """
    dates = df.select(F.to_date(ts).alias("_date")).distinct()
    per = holiday_distances(dates, holidays, "_date")
    j = df.withColumn("_date", F.to_date(ts)).join(per, "_date", "left").drop("_date")
    to, frm = F.col("days_to_holiday"), F.col("days_from_holiday")
    if strict:
        near = (to == 1) | (frm == 1)
    else:
        near = (to <= 1) | (frm <= 1)
    return j.withColumn("is_holiday_period", ((F.col("is_holiday") == 1) | near).cast("int"))
