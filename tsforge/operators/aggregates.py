"""Summaries and profiles (A1-A6, A10-A12, A14, T2, T3). One aggregate per job where possible."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.operators.joins import join_same
from tsforge.operators.quantiles import exact_quantiles

# Fixed day and month names (Monday-first, January-first) of the seasonal profiles.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]


def data_summary(df: DataFrame, target: str = "kwh", weather_cols: list[str] | None = None) -> DataFrame:
    """A1: per series record count, start, end, whole days, target mean/median/std/min/max,
    and mean/std/min/max of each weather column present. The median is selected exactly, apart from the aggregate."""
    from tsforge.sources.series import WEATHER_COLUMNS
    wcols = [c for c in (weather_cols or WEATHER_COLUMNS) if c in df.columns]
    t = F.col(target)
    aggs = [F.count(F.lit(1)).alias("total_records"), F.min(TS).alias("start"), F.max(TS).alias("end"),
            F.avg(t).alias(f"mean_{target}"),
            F.stddev_samp(t).alias(f"std_{target}"), F.min(t).alias(f"min_{target}"), F.max(t).alias(f"max_{target}")]
    for c in wcols:
        x = F.col(c)
        aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_std"),
                 F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    median = exact_quantiles(df, [target], [0.5], [SERIES]).select(F.col(SERIES).alias("_ps"), F.col("q")[0].alias(f"median_{target}"))
    s = df.groupBy(SERIES).agg(*aggs)
    s = s.join(median, F.col(SERIES).eqNullSafe(F.col("_ps")), "left").drop("_ps")
    days = F.floor((F.unix_seconds("end") - F.unix_seconds("start")) / 86400).cast("long")
    return s.select(SERIES, "total_records", "start", "end", days.alias("duration_days"),
                    *[c for c in s.columns if c not in (SERIES, "total_records", "start", "end")])


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """A2: count, mean, std, min, 25%, 50%, 75%, max per (series, column); exact quantiles.

    The frame is unpivoted to (series, column, x) so one grouped aggregate, and one selection of quantiles, covers all columns.
    """
    long = df.select(SERIES, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                                                  for c in cols])).alias("kv")).select(SERIES, "kv.column", "kv.x")
    g = long.groupBy(SERIES, "column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"),
                                           F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
                                           F.max("x").alias("max"))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], [SERIES]).withColumnsRenamed({SERIES: "_ps", "column": "_pc"})
    return g.join(q, F.col(SERIES).eqNullSafe(F.col("_ps")) & (F.col("column") == F.col("_pc")), "left") \
        .select(SERIES, "column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"),
                F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def profile_by_hour(df: DataFrame, value: str) -> DataFrame:
    """A3: mean by hour of day."""
    return df.groupBy(SERIES, F.hour(TS).alias("hour")).agg(F.avg(value).alias(f"mean_{value}"))


def profile_by_weekday(df: DataFrame, value: str) -> DataFrame:
    """A4: mean by day of week, Monday first; a 7-row dimension keeps missing days as NULL."""
    dim = _series_dim(df.select(SERIES).distinct(), DAY_NAMES, "day_of_week")
    m = df.groupBy(SERIES, F.weekday(TS).alias("day_of_week")).agg(F.avg(value).alias(f"mean_{value}"))
    return join_same(dim, m, [SERIES, "day_of_week"], "left").withColumnRenamed("name", "day_name")


def _series_dim(series: DataFrame, names: list[str], key: str) -> DataFrame:
    """Series x fixed-size dimension via an exploded literal array (no join)."""
    arr = F.array(*[F.struct(F.lit(i).alias(key), F.lit(n).alias("name")) for i, n in enumerate(names)])
    return series.select(SERIES, F.explode(arr).alias("d")).select(SERIES, f"d.{key}", "d.name")


def profile_by_month(df: DataFrame, value: str) -> DataFrame:
    """A5: mean by month (1..12), January first; missing months NULL."""
    series = df.select(SERIES).distinct()
    dim = _series_dim(series, MONTH_NAMES, "month").withColumn("month", F.col("month") + 1)
    m = df.groupBy(SERIES, F.month(TS).alias("month")).agg(F.avg(value).alias(f"mean_{value}"))
    return join_same(dim, m, [SERIES, "month"], "left").withColumnRenamed("name", "month_name")


def heatmap_hour_day(df: DataFrame, value: str) -> DataFrame:
    """Hour x day-of-week pivot of means, columns Monday..Sunday (fixed pivot values: one pass)."""
    return (df.withColumn("_dow", F.weekday(TS)).groupBy(SERIES, F.hour(TS).alias("hour"))
              .pivot("_dow", list(range(7))).agg(F.avg(value))
              .select(SERIES, "hour", *[F.col(str(i)).alias(DAY_NAMES[i]) for i in range(7)]))


def histogram(df: DataFrame, value: str, bins: int = 30, keys: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the group's min and max; the max falls in the last bin.

    bin = least(floor((x - lo) / (hi - lo) * bins) + 1, bins); lo == hi -> bin 1.
    Output (keys..., bin, bin_lo, bin_hi, count) for non-empty bins.
    """
    keys = keys or [SERIES]
    x = F.col(value)
    rng = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    j = join_same(df.where(x.isNotNull()), rng, keys)
    b = F.when(F.col("_hi") > F.col("_lo"),
               F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1, F.lit(bins))
               ).otherwise(F.lit(1)).cast("long")
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (j.groupBy(*keys, b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
             .select(*keys, "bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
                     (F.col("_lo") + F.col("bin") * width).alias("bin_hi"), "count"))


def qq_grid(points: int = 50) -> list[tuple[float, float]]:
    """Probabilities (i - 0.5)/points and their standard-normal quantiles."""
    nd = NormalDist()
    return [((i - 0.5) / points, nd.inv_cdf((i - 0.5) / points)) for i in range(1, points + 1)]


def qq_table(df: DataFrame, value: str, keys: list[str], points: int = 50) -> DataFrame:
    """Sample quantiles of ``value`` (exact, interpolated) against normal quantiles."""
    grid = qq_grid(points)
    probs = [p for p, _ in grid]
    g = exact_quantiles(df, [value], probs, keys).withColumnRenamed("q", "_q")
    arr = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(p).alias("p"), F.lit(z).alias("theoretical"))
                    for i, (p, z) in enumerate(grid)])
    return (g.select(*keys, "_q", F.explode(arr).alias("g"))
             .select(*keys, F.col("g.k").alias("k"), F.col("g.p").alias("prob"), F.col("g.theoretical").alias("theoretical"),
                     F.element_at("_q", F.col("g.k")).alias("sample")))


def residual_stats(df: DataFrame, keys: list[str], resid: str = "residual") -> DataFrame:
    """A10: mean, population std, min, max of residuals."""
    r = F.col(resid)
    return df.groupBy(*keys).agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"),
                                 F.min(r).alias("min"), F.max(r).alias("max"))
