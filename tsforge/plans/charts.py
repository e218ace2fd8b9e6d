"""Chart data as tables (V1-V8) and the small report slices.

Pictures are not drawn; each chart of the reference becomes the DataFrame it plots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.operators.joins import join_same
from tsforge.functions import windows as W
from tsforge.operators.resample import resample
from tsforge.operators.sequence import IDX, apply_windows, with_row_index


def series_table(df: DataFrame, columns: list[str] | None = None, freq: str | None = None) -> DataFrame:
    """V1: chosen columns (default the first measure) over time, optionally downsampled by mean."""
    cols = columns or [next(c for c in df.columns if c not in (SERIES, TS))]
    out = df.select(SERIES, TS, *cols)
    return resample(out, freq, how="mean") if freq else out


def metric_comparison(metrics: DataFrame, names: tuple = ("mae", "rmse", "mape")) -> DataFrame:
    """V4: ``(model, metric, value)`` with missing values as 0 (the bar chart's convention)."""
    keys = [c for c in metrics.columns if c not in names and c in ("series", "model")]
    arr = F.array(*[F.struct(F.lit(n).alias("metric"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value"))
                    for n in names])
    return metrics.select(*keys, F.explode(arr).alias("m")).select(*keys, "m.metric", "m.value")


def temperature_load_pairs(load: DataFrame, weather: DataFrame, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Load joined with the pre-projected temperature of its hour, on the series too when the weather has
    one; optional seeded sample (a sampling feature)."""
    keys = [TS] + [SERIES] * (SERIES in weather.columns)
    pairs = load.select(SERIES, TS, "kwh").join(weather.select(*keys, "temperature_c"), keys).select(SERIES, TS, "kwh", "temperature_c")
    return pairs.sample(fraction=fraction, seed=seed) if fraction else pairs


def weekday_weekend_means(df: DataFrame, value: str) -> DataFrame:
    """Mean on weekend and on weekday rows per series."""
    wk = F.weekday(TS) >= 5
    return df.groupBy(SERIES).agg(F.avg(F.when(wk, F.col(value))).alias("weekend_mean"),
                                  F.avg(F.when(~wk, F.col(value))).alias("weekday_mean"))


def head_tail(df: DataFrame, head: int = 168, tail: int = 168) -> DataFrame:
    """P20: first ``head`` and last ``tail`` rows of every series, tagged; positions from the
    distributed row index (no sort of a whole series in one task)."""
    idx = with_row_index(df) if IDX not in df.columns else df
    n = idx.groupBy(SERIES).agg(F.count(F.lit(1)).alias("_n"))
    j = join_same(idx, n, [SERIES])
    first = j.where(F.col(IDX) < head).withColumn("slice", F.lit("first"))
    last = j.where(F.col(IDX) >= F.col("_n") - tail).withColumn("slice", F.lit("last"))
    return first.unionByName(last).drop("_n")


def frame_shape(df: DataFrame) -> DataFrame:
    """Rows per series and the column count."""
    return df.groupBy(SERIES).agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def persistence_forecast(sc: DataFrame) -> DataFrame:
    """The last observed value repeated over the horizon; one row with ``error`` per request that cannot be scored."""
    from tsforge.plans.scoring import steps_of
    step = F.col("step")
    return steps_of(sc, 1).select("scenario", "step", (F.col("end_ts") + F.expr("INTERVAL 1 HOUR") * step).alias(TS),
                                  F.when(step.isNotNull(), F.try_element_at("recent", F.lit(-1))).alias("prediction"), "error")


def serving_features(df: DataFrame, target: str = "kwh") -> DataFrame:
    """The serving subset - lags 1, 2, 24 and rolling means 6, 24, each only where the
    series is longer than the lag/window (else NULL), as the request path computes them."""
    n = df.groupBy(SERIES).agg(F.count(F.lit(1)).alias("_n"))
    base = join_same(df, n, [SERIES])

    def build(w):
        cols = W.lag_columns(target, [1, 2, 24], w, guard=F.col("_n"))
        cols += [F.when(F.col("_n") > k, W.rolling_column(target, k, "mean", w)).alias(f"{target}_rolling_{k}h_mean")
                 for k in (6, 24)]
        return cols

    return apply_windows(base, build, 24).drop("_n")


def residual_table(long: DataFrame) -> DataFrame:
    """V5: every scored row with its residual."""
    return long.withColumn("residual", F.col("y_true") - F.col("y_pred"))


def dashboard(metrics: DataFrame, long: DataFrame, importance: DataFrame | None = None, metric: str = "rmse",
              models: int = 5, features: int = 10, bins: int = 20) -> DataFrame:
    """V7: the dashboard's panels as one long table ``(panel, model, item, value)`` of a few dozen rows: the models of
    least ``metric``, the best model's name, its residual histogram (bin: count), the MAE histogram over models and
    the most important features."""
    from tsforge.operators.aggregates import histogram
    from tsforge.plans.metrics import best_model, ranked
    row = lambda df, panel, model, item, value: df.select(F.lit(panel).alias("panel"), model.alias("model"), item.cast("string").alias("item"),
                                                          value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    best = best_model(metrics, metric)
    top = ranked(metrics.where(F.col(metric).isNotNull()), metric).limit(models)
    own = residual_table(long).join(F.broadcast(best.select(F.col("best_model").alias("model"))), "model")
    errors = histogram(metrics.where(F.col("mae").isNotNull()).withColumn("_all", F.lit(1)), "mae", bins, ["_all"])
    out = row(top, f"models by {metric}", F.col("model"), F.lit(metric), F.col(metric)) \
        .unionByName(row(best, "best model", F.col("best_model"), F.lit(metric), F.col(metric))) \
        .unionByName(row(histogram(own, "residual", bins, ["model"]), "residuals", F.col("model"), F.col("bin"), F.col("count"))) \
        .unionByName(row(errors, "mae", none, F.col("bin"), F.col("count")))
    if importance is not None:
        out = out.unionByName(row(importance.orderBy(F.desc("importance"), "feature").limit(features), "importance", none, F.col("feature"), F.col("importance")))
    return out
