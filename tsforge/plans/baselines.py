"""Baseline forecasters (W15-W17, M6) and the time-ordered split.

The series mean used to fill the first rows is a grouped aggregate joined back
(one row per series), never an unbounded window over a whole series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.operators.joins import join_same
from tsforge.functions import windows as W
from tsforge.operators.sequence import DEFAULT_CHUNK_ROWS, IDX, apply_windows, series_window, with_row_index

# Fixed baseline names and parameters of the reference.
BASELINES = [("naive_24h", "lag", 24), ("seasonal_naive", "lag", 168), ("moving_avg_24h", "mean", 24)]


def with_split(df: DataFrame, test_size: float = 0.2, chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """M1: ``is_test`` = row position >= int(n * (1 - test_size)) within each series; keeps ``_idx``."""
    if IDX in df.columns:
        base = df
    elif chunk_rows is not None:
        base = with_row_index(df)
    else:
        base = df.withColumn(IDX, F.row_number().over(series_window(False)) - 1)
    n = base.groupBy(SERIES).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.col("_n") * (1.0 - test_size))
    return join_same(base, n, [SERIES]).withColumn("is_test", F.col(IDX) >= cut).drop("_n")


def baseline_predictions(df: DataFrame, target: str = "kwh", chunk_rows: int | None = DEFAULT_CHUNK_ROWS,
                         fit_on: str = "all") -> DataFrame:
    """Wide frame with one prediction column per baseline; rows without history take
    the series mean (over all rows as the reference does, or train rows with ``fit_on='train'``)."""
    src = df.where(~F.col("is_test")) if fit_on == "train" and "is_test" in df.columns else df
    means = src.groupBy(SERIES).agg(F.avg(target).alias("_mean"))

    def build(w):
        cols = []
        for name, kind, n in BASELINES:
            raw = F.lag(target, n).over(w) if kind == "lag" else W.rolling_column(target, n, "mean", w)
            cols.append(raw.alias("_raw_" + name))
        return cols

    halo = max(n if kind == "lag" else n - 1 for _, kind, n in BASELINES)
    wide = join_same(apply_windows(df, build, halo, chunk_rows), means, [SERIES], "left")
    return wide.select(*df.columns, *[F.coalesce("_raw_" + name, "_mean").alias(name) for name, _, _ in BASELINES])


def to_long(wide: DataFrame, target: str, models: list[str], keep: list[str] | None = None) -> DataFrame:
    """Stack prediction columns into ``(series, ts, model, y_true, y_pred)``."""
    keep = keep or []
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("y_pred")) for m in models])
    return (wide.select(SERIES, TS, *keep, F.col(target).alias("y_true"), F.explode(arr).alias("p"))
                .select(SERIES, TS, *keep, "p.model", "y_true", "p.y_pred"))
