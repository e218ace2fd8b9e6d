"""A series without a name is a series like any other: no query drops or empties its rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tsforge.operators import aggregates as A
from tsforge.operators.joins import join_same
from tsforge.operators.resample import gap_report
from tsforge.plans import baselines, charts, features, models, scoring

T0 = dt.datetime(2024, 1, 1)
N = 240


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(s, T0 + dt.timedelta(hours=i), float(i % 24) + k) for k, s in enumerate(("a", None)) for i in range(N) if i not in (7, 8, 30)]
    return spark.createDataFrame(rows, "series string, ts timestamp, value double")


def both(df, *cols):
    """The rows of the named and of the nameless series, without the series, in order."""
    rows = df.collect()
    part = lambda s: sorted(tuple(r[c] for c in cols) for r in rows if r.series == s)
    assert part(None)
    return part("a"), part(None)


def test_split_baselines_and_models(frame):
    a, b = both(baselines.with_split(frame), "ts", "is_test")
    assert a == b
    wide = baselines.baseline_predictions(frame, "value")
    assert wide.where("naive_24h IS NULL OR moving_avg_24h IS NULL").count() == 0
    a, b = both(wide, "ts", "naive_24h")
    assert [t for t, _ in a] == [t for t, _ in b] and [v + 1 for _, v in a] == pytest.approx([v for _, v in b])
    long = models.seasonal_ar(frame, "value")
    a, b = both(long, "ts")
    assert a == b


def test_slices_profiles_and_histogram(frame):
    a, b = both(charts.head_tail(frame, 10, 5), "slice", "ts")
    assert a == b and len(a) == 15
    for f, key in ((A.profile_by_weekday, "day_of_week"), (A.profile_by_month, "month")):
        rows = {(r.series, r[key]): r.mean_value for r in f(frame, "value").collect()}
        assert all((rows[None, k] is None) == (v is None) and (v is None or rows[None, k] == pytest.approx(v + 1)) for (s, k), v in rows.items() if s == "a")
        assert sum(v is not None for (s, _), v in rows.items() if s is None) > 0
    a, b = both(A.histogram(frame, "value"), "bin", "count")
    assert a == b


def test_serving_features_and_window_features(frame):
    a, b = both(charts.serving_features(frame, "value"), "ts")
    assert len(a) == len(b) == N - 3
    assert charts.serving_features(frame, "value").where("series IS NULL AND value_lag_24h IS NOT NULL").count() == N - 3 - 24
    out = features.window_features(frame, features.FeatureConfig(target="value"))
    assert out.where("series IS NULL AND value_vs_same_hour_last_week IS NOT NULL").count() == N - 3 - 168


def test_gap_report(frame):
    report, first = gap_report(frame)
    a, b = both(report, *[c for c in report.columns if c != "series"])
    assert a == b and report.first().missing_count == 3
    a, b = both(first, "rank", "ts")
    assert a == b and len(a) == 3


def test_scenarios(frame):
    got = scoring.scenarios_from_series(frame, "value").collect()
    assert {r.scenario for r in got} == {"a", None} and all(len(r.recent) == 24 for r in got)


def test_join_same(spark):
    left = spark.createDataFrame([(None, 1, "x"), ("a", None, "y"), ("a", 2, "z")], "k string, j int, v string")
    right = spark.createDataFrame([(None, 1, 10), ("a", None, 20), ("b", 2, 30)], "k string, j int, w int")
    assert sorted((r.v, r.w) for r in join_same(left, right, ["k", "j"]).collect()) == [("x", 10), ("y", 20)]
    out = join_same(left, right, ["k", "j"], "left")
    assert out.columns == ["k", "j", "v", "w"] and out.where(F.col("w").isNull()).count() == 1
    assert [r.v for r in join_same(left, right, ["k", "j"], "left_anti").collect()] == ["z"]
