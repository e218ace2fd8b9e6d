"""Forecast metrics over a long prediction table (A7, A8, M7), one grouped aggregate.

Rows where either the actual or the prediction is NULL are masked out (as the
reference's pairwise NaN mask). MAPE divides by max(|y|, machine epsilon);
R2 is 0 when the actuals are constant; sMAPE skips 0/0 rows (NULL) where NumPy
would return NaN for the whole metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tsforge import TS

EPS = 2.220446049250313e-16  # float64 machine epsilon (fixed by the metric's definition)


def regression_metrics(long: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred",
                       extended: bool = False) -> DataFrame:
    ok = F.col(y).isNotNull() & F.col(p).isNotNull()
    yt = F.when(ok, F.col(y))
    e = F.when(ok, F.col(y) - F.col(p))
    extra = []
    if extended:
        extra = [F.avg(F.when(ok, F.try_divide(200 * F.abs(F.col(y) - F.col(p)),
                                                F.abs(F.col(y)) + F.abs(F.col(p))))).alias("smape")]
    g = long.groupBy(*keys).agg(
        F.count(e).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(F.abs(e) / F.greatest(F.abs(yt), F.lit(EPS)))).alias("mape"),
        F.sum(e * e).alias("_ss_res"),
        (F.var_pop(yt) * F.count(yt)).alias("_ss_tot"),
        *extra)
    if extended:
        g = g.join(_naive_scale(long.where(ok), keys, y), keys, "left")
    r2 = F.when(F.col("n") == 0, F.lit(None)).when(F.col("_ss_tot") == 0, F.lit(0.0)) \
        .otherwise(1 - F.col("_ss_res") / F.col("_ss_tot"))
    cols = [*keys, "n", "mae", "rmse", "mape", r2.alias("r2")]
    if extended:
        cols += [F.when(F.col("n") > 1, F.try_divide(F.col("mae"), F.nullif(F.col("_naive_mae"), F.lit(0.0)))).alias("mase"),
                 "smape"]
    return g.select(*cols)


def _naive_scale(clean: DataFrame, keys: list[str], y: str) -> DataFrame:
    """Mean |y_t - y_{t-1}| over each group's clean rows in time order (the MASE scale).

    Groups become the series key of the bounded chunk executor (1-row halo), so a
    long group never sits in one task."""
    from tsforge import SERIES
    from tsforge.functions.windows import abs_step
    from tsforge.operators.sequence import apply_windows
    gk = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    framed = clean.select(*[F.col(k).alias("_g_" + k) for k in keys], gk.alias(SERIES), F.col(TS),
                          F.col(y).alias("_y"))
    stepped = apply_windows(framed, lambda w: [abs_step("_y", w).alias("_step")], halo=1)
    return stepped.groupBy(*[F.col("_g_" + k).alias(k) for k in keys]).agg(F.avg("_step").alias("_naive_mae"))


def best_model(metrics: DataFrame, metric: str = "rmse", keys: list[str] | None = None) -> DataFrame:
    """Lowest mae/rmse/mape or highest r2 per key group; NULL/NaN never wins."""
    keys = keys or []
    m = F.col(metric)
    valid = metrics.where(m.isNotNull() & ~F.isnan(m))
    pick = F.max_by if metric == "r2" else F.min_by
    agg = [pick("model", m).alias("best_model"), (F.max(m) if metric == "r2" else F.min(m)).alias(metric)]
    return valid.groupBy(*keys).agg(*agg) if keys else valid.agg(*agg)


def ranked(metrics: DataFrame, metric: str = "rmse") -> DataFrame:
    """Models sorted by a metric, NULLs last."""
    return metrics.orderBy(F.col(metric).asc_nulls_last(), "model")
