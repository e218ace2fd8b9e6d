"""Seasonal ARMA and trends with breaks on constructed series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsforge.operators import sequence
from tsforge.operators.sequence import with_row_index
from tsforge.plans import classical as C
from tsforge.plans import models as M

T0 = dt.datetime(2024, 1, 1)


def frame(spark, series):
    rows = [(s, T0 + dt.timedelta(hours=i), None if v != v else float(v)) for s, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series string, ts timestamp, value double").repartition(4)


def arma_series(n, phi, big_phi, theta, big_theta, season=24, seed=0):
    """(1,1,1)(1,1,1,season) from white noise; the series and its noise."""
    rng = np.random.default_rng(seed)
    e, d = rng.normal(size=n), np.zeros(n)
    for t in range(n):
        at = lambda x, k: x[t - k] if t >= k else 0.0  # noqa: B023, E731
        d[t] = phi * at(d, 1) + big_phi * at(d, season) - phi * big_phi * at(d, season + 1) \
            + e[t] + theta * at(e, 1) + big_theta * at(e, season) + theta * big_theta * at(e, season + 1)
    y = np.zeros(n)
    for t in range(n):
        at = lambda k: y[t - k] if t >= k else 0.0  # noqa: B023, E731
        y[t] = d[t] + at(1) + at(season) - at(season + 1)
    return y, e


def test_coefficients_come_back(spark):
    want = {"a": (0.5, -0.4, 0.4, -0.5), None: (-0.3, 0.2, -0.6, 0.4)}
    made = {s: arma_series(4000, *c, seed=k) for k, (s, c) in enumerate(want.items())}
    df = frame(spark, {s: y for s, (y, _) in made.items()})
    rows = with_row_index(df).withColumn("is_test", F.lit(False))
    fitted, coef = C.fit_seasonal_arma(rows, "value", chunk_rows=512)
    got = {r.series: r.theta for r in coef.collect()}
    for s, (p, q, a, b) in want.items():
        assert got[s] == pytest.approx([p, q, a, b], abs=0.06)
    e = fitted.where("series = 'a'").orderBy("_idx").toPandas()["_e"].to_numpy()
    assert np.corrcoef(e[500:], made["a"][1][500:])[0, 1] > 0.98  # the residuals are the noise that made the series


def test_residuals_over_chunks_equal_one_filter(spark, monkeypatch):
    monkeypatch.setattr(sequence, "FAN", 3)
    rng, ma = np.random.default_rng(4), [0.9, -0.95]
    news = {s: rng.normal(size=n) for s, n in (("a", 700), (None, 90), ("c", 3))}
    rows = [(s, i, float(v), ma) for s, x in news.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series string, _idx long, _news double, ma array<double>").repartition(5)
    got = C.filtered(df, 24, chunk_rows=30).toPandas().sort_values("_idx")
    for s, x in news.items():
        part = got[got.series.isna() if s is None else got.series == s]
        h, k = C._filter(x, ma, 24, np.zeros(50))
        assert part["_h"].to_numpy() == pytest.approx(h, abs=1e-8) and part["_k"].to_numpy() == pytest.approx(k, abs=1e-7)


def test_moving_average_beats_the_autoregression(spark):
    y, _ = arma_series(1500, 0.2, 0.0, -0.7, -0.8, seed=3)
    df = frame(spark, {"a": y + 1000, "short": y[:20]})
    error = lambda out: out.where("series = 'a'").agg(F.sqrt(F.avg((F.col("y_true") - F.col("y_pred")) ** 2)), F.count("y_pred")).first()
    arma, ar = error(C.seasonal_arma(df, "value")), error(M.seasonal_ar(df, "value"))
    assert arma[1] == ar[1] == 300 and arma[0] < 0.9 * ar[0]
    ahead = C.seasonal_arma_forecast(df, "value", 30).toPandas()
    assert len(ahead[ahead.series == "a"]) == 30 and ahead.y_pred.notna().all()
    assert ahead.ts.min() == T0 + dt.timedelta(hours=1500)


def test_trend_breaks_are_found(spark):
    n = 1400
    t = np.arange(n)
    rng = np.random.default_rng(1)
    bend = np.where(t < 400, 0.05 * t, 20 - 0.03 * (t - 400))
    df = frame(spark, {"a": 100 + bend + 5 * np.sin(2 * np.pi * t / 24) + 0.5 * rng.normal(size=n), None: 50 + 0.01 * t + rng.normal(size=n) - 200})
    error = lambda out: {r.series: r.e for r in out.groupBy("series").agg(F.sqrt(F.avg((F.col("y_true") - F.col("y_pred")) ** 2)).alias("e")).collect()}
    broken, straight = error(C.trend_regression(df, "value", multiplicative=False)), error(M.fourier_regression(df, "value", multiplicative=False))
    assert broken["a"] < 0.3 * straight["a"] and broken["a"] < 2.5
    assert broken[None] < 1.5 * straight[None]
    fitted = C.fit_trend(df, "value", multiplicative=False)
    found = C.trend_breaks(fitted).toPandas()
    a = found[found.series == "a"]
    near = a[(a.ts - (T0 + dt.timedelta(hours=400))).abs() < dt.timedelta(hours=120)]
    assert near.change.sum() == pytest.approx(-0.08 * (n - 1), rel=0.15)
    assert abs(found[found.series.isna()].change.sum()) < 2  # no break was planted there: small bends cancel
    ahead = C.trend_forecast(df, "value", 24, multiplicative=False).where("series = 'a'").orderBy("step").toPandas()
    assert np.abs(ahead.y_pred - (100 + 20 - 0.03 * (np.arange(n, n + 24) - 400) + 5 * np.sin(2 * np.pi * np.arange(n, n + 24) / 24))).max() < 3


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 9))
    x[:, 5] = x[:, 4] + 0.01 * x[:, 5]
    y = x @ np.array([1, -2, 0, 0, 3, 0, 0, 0.5, 0]) + rng.normal(size=200)
    g, b = x.T @ x, x.T @ y
    for penalty in (5.0, 20.0, 1e4):
        w = C._lasso(g, b, 2, penalty)
        slope = b - g @ w
        assert np.abs(slope[:2]).max() < 1e-6
        on = w[2:] != 0
        assert np.abs(slope[2:][on] - penalty * np.sign(w[2:][on])).max(initial=0) < 5e-3
        assert (np.abs(slope[2:]) <= penalty + 5e-3).all()
    assert not C._lasso(g, b, 2, 1e4)[2:].any()
