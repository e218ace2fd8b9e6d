"""Long gaps, NULL keys, hot series and exact quantiles."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsforge.functions import windows as W
from tsforge.operators.quantiles import exact_quantiles
from tsforge.operators.resample import resample
from tsforge.operators.sequence import apply_windows, with_row_index

T0 = dt.datetime(2024, 1, 1)


def _hours(values, series="s"):
    return [(series, T0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)]


@pytest.mark.parametrize("chunk", [64, 4096])
def test_ema_over_gaps_longer_than_any_weight(spark, chunk):
    rng = np.random.default_rng(3)
    x = [None, 0.0, 10.0] + [None] * 900 + rng.normal(size=50).tolist() + [None] * 400 + [3.0, None]
    df = spark.createDataFrame(_hours(x), "series string, ts timestamp, value double")
    got = W.ema_frame(df, "value", W.DEFAULT_ALPHAS, chunk).toPandas().sort_values("ts")
    for a in W.DEFAULT_ALPHAS:
        want = pd.Series(x, dtype=float).ewm(alpha=a, adjust=True).mean()
        np.testing.assert_allclose(got[f"value_ema_alpha_{a}"].to_numpy(float), want.to_numpy(), rtol=1e-9)


def test_null_series_and_stamps_keep_their_rows(spark):
    rows = [("a", T0, 1.0), ("a", None, 2.0), (None, T0, 3.0), (None, T0 + dt.timedelta(hours=2), 5.0)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    got = {(r.series, r.ts): r._idx for r in with_row_index(df).collect()}
    assert got == {("a", None): 0, ("a", T0): 1, (None, T0): 0, (None, T0 + dt.timedelta(hours=2)): 1}
    hourly = {(r.series, r.ts): (r.value, r._idx) for r in resample(df, "H", keep_index=True).collect()}
    assert hourly == {("a", T0): (1.0, 0), (None, T0): (3.0, 0), (None, T0 + dt.timedelta(hours=1)): (None, 1), (None, T0 + dt.timedelta(hours=2)): (5.0, 2)}


def test_ties_and_a_hot_series(spark):
    rows = [("hot", T0, float(i % 7)) for i in range(3000)] + [("cold", T0 + dt.timedelta(hours=i), 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double").repartition(6)
    got = with_row_index(df, total="n").toPandas()
    for s, n in (("hot", 3000), ("cold", 10)):
        g = got[got.series == s]
        assert sorted(g._idx) == list(range(n)) and set(g.n) == {n}
    hot = got[got.series == "hot"].sort_values("_idx")
    assert (np.diff(hot.value) >= 0).all()


def test_a_lag_longer_than_a_chunk(spark):
    df = spark.createDataFrame(_hours([float(i) for i in range(500)]), "series string, ts timestamp, value double")
    got = apply_windows(df, lambda w: [F.lag("value", 150).over(w).alias("y")], 150, 20).toPandas().sort_values("ts")
    assert got.y.tolist()[150:] == [float(i) for i in range(350)] and got.y[:150].isna().all() and len(got) == 500


@pytest.mark.parametrize("direct", [1_000_000, 100])
def test_exact_quantiles_equal_numpy(spark, direct):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x), None) for x in rng.integers(0, 50, 5000)] + [("b", float(x), float(x) ** 2) for x in rng.normal(size=31)]
    rows += [("wide", float(x), float(x)) for x in rng.normal(size=30_000)]
    rows += [("one", 4.0, None), ("none", None, None), (None, 2.0, 1.0), (None, 3.0, None)]
    df = spark.createDataFrame(rows, "series string, x double, y double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {(r.series, r.column): r.q for r in exact_quantiles(df, ["x", "y"], probs, ["series"], direct).collect()}
    frame = pd.DataFrame(rows, columns=["series", "x", "y"])
    want = {(s if isinstance(s, str) else None, c): np.quantile(g[c].dropna(), probs) for s, g in frame.groupby("series", dropna=False)
            for c in ("x", "y") if g[c].notna().any()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_one_scan_of_the_raw_table(spark):
    from tsforge.sources.series import hourly_by_type
    df = hourly_by_type(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1
