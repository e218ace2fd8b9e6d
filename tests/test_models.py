"""Classical forecasters per series, failing models, streaming epochs, frames read back."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsforge.plans import models as M

T0 = dt.datetime(2024, 1, 1)


def _frame(spark, n=600):
    rng = np.random.default_rng(8)
    rows = []
    for s, level in (("a", 10.0), ("b", 1000.0)):
        y = level * (1 + 0.3 * np.sin(2 * np.pi * np.arange(n) / 24)) + level * 0.02 * rng.normal(size=n)
        rows += [(s, T0 + dt.timedelta(hours=i), float(v)) for i, v in enumerate(y)]
    rows += [("c", T0 + dt.timedelta(hours=i), float(v)) for i, v in enumerate(5 * np.sin(2 * np.pi * np.arange(n) / 24))]
    return spark.createDataFrame(rows, "series string, ts timestamp, value double")


def test_grouped_regression_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for s in ("a", None):
        x = rng.normal(size=(80, 2))
        y = x @ rng.normal(size=2) + 3 + 0.1 * rng.normal(size=80)
        want[s] = np.linalg.lstsq(np.column_stack([x, np.ones(80)]), y, rcond=None)[0]
        rows += [(s, float(p), float(q), float(v)) for (p, q), v in zip(x, y)]
    rows.append(("a", None, 1.0, 2.0))
    df = spark.createDataFrame(rows, "series string, p double, q double, y double").repartition(4)
    got = {r.series: r.coef for r in M.grouped_regression(df, ["series"], ["p", "q"], "y").collect()}
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-6)


def test_classical_models_fit_each_series(spark):
    df = _frame(spark)
    for f in (M.seasonal_ar, M.fourier_regression):
        out = f(df, "value").toPandas()
        assert len(out) == 360 and out.y_pred.notna().all()  # every test row, negative values too
        for _, g in out.groupby("series"):
            assert np.sqrt(((g.y_true - g.y_pred) ** 2).mean()) < 0.25 * g.y_true.std()
    for f in (M.seasonal_ar_forecast, M.fourier_forecast):
        out = f(df, "value", 48).toPandas()
        assert len(out) == 144 and out.ts.min() == T0 + dt.timedelta(hours=600)
        b = out[out.series == "b"].sort_values("step")
        truth = 1000 * (1 + 0.3 * np.sin(2 * np.pi * np.arange(600, 648) / 24))
        assert np.abs(b.y_pred - truth).max() < 150


def test_a_model_that_fails_has_null_metrics(spark):
    rng = np.random.default_rng(2)
    rows = [("s", T0 + dt.timedelta(hours=i), float(i % 24), float(rng.normal()), i, i >= 80, float(i % 24)) for i in range(100)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double, x double, _idx long, is_test boolean, label double")
    bad = M.TreePreset("bad", "rf", (("numTrees", 0),))
    good = M.TreePreset("good", "rf", (("numTrees", 3), ("maxDepth", 3), ("seed", 1)))
    with pytest.warns(UserWarning, match="bad"):
        metrics, _, models, _ = M.train_and_evaluate(df, "value", [bad, good], prepared=(df, ["x"]))
    got = {r.model: r for r in metrics.collect()}
    assert got["bad"].rmse is None and got["bad"].n == 0 and got["good"].n == 20 and list(models) == ["good"]


def test_isolation_forest_is_per_series(spark):
    from tsforge.operators.isolation import isolation_forest_flags
    rng = np.random.default_rng(4)
    rows = [(s, T0 + dt.timedelta(hours=i), float(rng.normal(m, d))) for s, m, d in (("a", 1, 0.1), ("b", 1000, 100)) for i in range(500)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double").repartition(3)
    got = isolation_forest_flags(df, "value", trees=40).groupBy("series").agg(F.avg(F.col("is_outlier").cast("int")).alias("share")).collect()
    assert len(got) == 2 and all(0.085 <= r.share <= 0.1 for r in got)


def test_epochs_are_replaceable(spark, tmp_path):
    from tsforge.streaming.hourly import _write_epoch, newest
    rows = lambda v: spark.createDataFrame([("a", T0, v, 1)], "series string, ts timestamp, value double, n int")
    path = f"file://{tmp_path}/t"
    _write_epoch(rows(1.0), 0, path)
    _write_epoch(rows(2.0), 1, path)
    _write_epoch(rows(2.0), 1, path)
    got = newest(spark.read.parquet(path)).collect()
    assert [(r.series, r.value) for r in got] == [("a", 2.0)]


def test_frames_are_read_back_as_written(spark, tmp_path):
    from tsforge.sources.files import read_frame, write_frame
    df = _frame(spark, 30)
    write_frame(df, f"file://{tmp_path}/f")
    again = read_frame(spark, f"file://{tmp_path}/f", df)
    assert again.columns == df.columns and again.exceptAll(df).count() == 0 and df.exceptAll(again).count() == 0


def test_default_presets_fit(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(3 * a + b)) for a, b in rng.normal(size=(60, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    model = M.fit(df, ["a", "b"], M.DEFAULT_PRESETS["random_forest_default"])
    fitted = model.transform(df).agg(F.corr("prediction", "label")).first()[0]
    assert fitted > 0.95 and model.stages[-1].getNumTrees == 100


def test_requests_scored_on_a_stream(spark, tmp_path):
    from tsforge.plans.scoring import heuristic_horizon
    from tsforge.streaming.hourly import score_stream
    w = "struct<temperature_c:double,humidity_percent:double,wind_speed_kmh:double,precipitation_mm:double,cloud_cover_percent:double,solar_irradiance_wm2:double>"
    schema = f"scenario string, end_ts timestamp, recent array<double>, weather {w}, horizon int"
    spark.createDataFrame([("a", T0, [1.0, 2.0, 3.0], None, 3), ("b", T0, [1.0], None, 3)], schema).write.parquet(f"{tmp_path}/in")
    q = score_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), heuristic_horizon, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    q.awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").toPandas()
    assert (got.scenario == "a").sum() == 3 and got[got.scenario == "b"].error.notna().all()


def test_federal_holidays(spark):
    from tsforge.functions.holidays import us_federal_holidays
    days = {r[0] for r in us_federal_holidays(spark, 2021, 2021, True).select(F.col("holiday_date").cast("string")).collect()}
    assert {"2021-01-01", "2021-05-31", "2021-11-25", "2021-07-04", "2021-07-05"} <= days


def test_requests_are_forecast_by_a_model(spark):
    from tsforge.plans.catalog import QUERIES
    got = QUERIES["request_forecast"](spark, "/root/testdata/sf0.001").toPandas()
    kinds = got.scenario.str.split("/").str[1]
    for k in ("sound", "text", "gap", "no weather"):
        assert (kinds == k).sum() == 5 * 24 and got[kinds == k].predicted_kwh.notna().all() and got[kinds == k].error.isna().all()
    for k in ("short", "nothing", "no step", "too long"):
        assert (kinds == k).sum() == 5 and got[kinds == k].error.notna().all()
