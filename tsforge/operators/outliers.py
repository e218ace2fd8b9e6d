"""Outlier detection on one measure per series.

Fences come from exact quantiles by distributed selection and are joined back (one row per series).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.operators.quantiles import exact_quantiles

OUTLIER_METHODS = ("iqr", "zscore", "isolation_forest")


def iqr_fences(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Per series: q1, q3 (linear interpolation), lower = q1 - k*iqr, upper = q3 + k*iqr."""
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return exact_quantiles(df, [col], [0.25, 0.75], [SERIES]).select(
        SERIES, q1.alias("q1"), q3.alias("q3"), (q1 - k * (q3 - q1)).alias("lower"), (q3 + k * (q3 - q1)).alias("upper"))


def _join_series(df: DataFrame, per_series: DataFrame) -> DataFrame:
    """Left join of one row per series; NULL is a series like any other."""
    side = per_series.withColumnRenamed(SERIES, "_ps")
    return df.join(side, F.col(SERIES).eqNullSafe(F.col("_ps")), "left").drop("_ps")


def flag_outliers(df: DataFrame, col: str = "kwh", method: str = "iqr",
                  z: float = 3.0, flag: str = "is_outlier", **kwargs) -> DataFrame:
    """Add ``flag`` (boolean, NULL measure -> false) by ``method``."""
    x = F.col(col)
    if method == "iqr":
        fences = iqr_fences(df, col).select(SERIES, "lower", "upper")
        j = _join_series(df, fences)
        cond = (x < F.col("lower")) | (x > F.col("upper"))
        return j.withColumn(flag, F.coalesce(cond, F.lit(False))).drop("lower", "upper")
    if method == "zscore":
        st = df.groupBy(SERIES).agg(F.avg(col).alias("_mu"), F.stddev_samp(col).alias("_sd"))
        j = _join_series(df, st)
        cond = F.abs(F.try_divide(x - F.col("_mu"), F.col("_sd"))) > z
        return j.withColumn(flag, F.coalesce(cond, F.lit(False))).drop("_mu", "_sd")
    if method == "isolation_forest":
        from tsforge.operators.isolation import isolation_forest_flags
        return isolation_forest_flags(df, col, flag=flag, **kwargs)
    raise ValueError(f"unknown outlier method {method!r}")


def outlier_stats(flagged: DataFrame, method: str, flag: str = "is_outlier") -> DataFrame:
    """Per series method, outlier_count, outlier_percentage."""
    return flagged.groupBy(SERIES).agg(
        F.lit(method).alias("method"),
        F.count_if(F.col(flag)).alias("outlier_count"),
        (F.count_if(F.col(flag)) * 100.0 / F.count(F.lit(1))).alias("outlier_percentage"))


def outlier_stamps(flagged: DataFrame, flag: str = "is_outlier") -> DataFrame:
    """The flagged stamps as a table (not a driver-side list)."""
    return flagged.where(F.col(flag)).select(SERIES, TS)


def remove_outliers(flagged: DataFrame, flag: str = "is_outlier") -> DataFrame:
    """P7."""
    return flagged.where(~F.col(flag)).drop(flag)
