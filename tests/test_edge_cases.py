"""Hand-made edge cases (FIXTURES.md): all-null, leading/trailing nulls, zero divisor,
constant series, short series, duplicates in one hour, year boundary, leap day."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tsforge.functions.calendar import calendar_feature_columns, time_feature_columns
from tsforge.operators.nulls import handle_missing
from tsforge.operators.resample import resample
from tsforge.plans.features import FeatureConfig, window_features
from tsforge.plans.metrics import regression_metrics


def _frame(spark, values, start="2024-01-01 00:00:00", series="s"):
    t0 = dt.datetime.fromisoformat(start)
    return spark.createDataFrame([(series, t0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)],
                                 "series string, ts timestamp, value double")


def test_all_null_series_stays_null(spark):
    out = handle_missing(_frame(spark, [None] * 10), "interpolate", ["value"]).toPandas()
    assert out["value"].isna().all()


def test_short_series_statistical_columns_are_null(spark):
    cfg = FeatureConfig(target="value", lags=[], windows=[], stats=[], alphas=[], statistical=True)
    out = window_features(_frame(spark, [float(i + 1) for i in range(50)]), cfg).toPandas()
    assert out["value_vs_same_hour_last_week"].isna().all()
    assert out["value_zscore_168h"].isna().all()
    assert out["value_pct_change_168h"].isna().all()
    assert out["value_pct_change_1h"].notna().sum() == 49


def test_zero_divisor_gives_null(spark):
    cfg = FeatureConfig(target="value", lags=[], windows=[], stats=[], alphas=[], statistical=True)
    out = window_features(_frame(spark, [0.0, 5.0, 0.0, 1.0]), cfg).orderBy("ts").toPandas()
    assert math.isnan(out["value_pct_change_1h"][1])          # 5 / 0
    assert out["value_pct_change_1h"][2] == pytest.approx(-1.0)


def test_constant_series_r2_is_zero(spark):
    df = spark.createDataFrame([("m", dt.datetime(2024, 1, 1, h), 3.0, 2.0) for h in range(10)],
                               "model string, ts timestamp, y_true double, y_pred double")
    r = regression_metrics(df, ["model"]).first()
    assert r["r2"] == 0.0 and r["mae"] == pytest.approx(1.0) and r["n"] == 10


def test_metrics_empty_after_mask(spark):
    df = spark.createDataFrame([("m", dt.datetime(2024, 1, 1, h), None, 2.0) for h in range(3)],
                               "model string, ts timestamp, y_true double, y_pred double")
    r = regression_metrics(df, ["model"], extended=True).first()
    assert r["n"] == 0 and r["mae"] is None and r["r2"] is None


def test_duplicates_in_one_hour_are_averaged(spark):
    rows = [("s", dt.datetime(2024, 1, 1, 0, m), float(v)) for m, v in ((5, 1), (35, 3))] + \
           [("s", dt.datetime(2024, 1, 1, 3, 0), 10.0)]
    out = resample(spark.createDataFrame(rows, "series string, ts timestamp, value double"), "H").orderBy("ts").toPandas()
    assert list(out["value"][:1]) == [2.0] and out["value"][1:3].isna().all() and len(out) == 4


def test_daily_sum_of_empty_day_is_zero(spark):
    rows = [("s", dt.datetime(2024, 2, 27, 5), 1.0), ("s", dt.datetime(2024, 3, 1, 5), 2.0)]
    out = resample(spark.createDataFrame(rows, "series string, ts timestamp, value double"), "D", how="sum") \
        .orderBy("ts").toPandas()
    assert list(out["value"]) == [1.0, 0.0, 0.0, 2.0]  # 2024-02-29 (leap day) is present and empty


def test_year_boundary_and_leap_day_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 12, 31, 23),), (dt.datetime(2021, 1, 1, 0),), (dt.datetime(2024, 2, 29, 12),)],
                               "ts timestamp")
    out = df.select("ts", *time_feature_columns("ts"), *calendar_feature_columns("ts")).orderBy("ts").toPandas()
    assert list(out["week_of_year"]) == [53, 53, 9]              # ISO weeks
    assert list(out["day_of_year"]) == [366, 1, 60]
    assert list(out["day_of_week"]) == [3, 4, 3]                 # Thu, Fri, Thu (Monday = 0)
    assert list(out["season"]) == [1, 1, 1]
    assert list(out["days_to_weekend"]) == [1, 0, 1]


def test_unknown_frequency_raises(spark):
    with pytest.raises(ValueError):
        resample(_frame(spark, [1.0]), "W")
