"""Window features and fills against pandas (the reference's semantics) on a series with nulls."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tsforge.functions import windows as W
from tsforge.operators.nulls import handle_missing
from tsforge.operators.sequence import apply_windows
from tsforge.plans.features import FeatureConfig, window_features


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    idx = pd.date_range("2024-01-01", periods=400, freq="h")
    vals = [None if rnd.random() < 0.1 else round(rnd.uniform(1, 100), 2) for _ in idx]
    vals[:4] = [None] * 4
    vals[-3:] = [None] * 3
    pdf = pd.DataFrame({"series": "s", "ts": idx, "value": vals})
    df = spark.createDataFrame(pdf.astype({"value": "float64"}), "series string, ts timestamp, value double")
    return pdf.set_index("ts")["value"].astype("float64"), df


def _close(expected: pd.Series, got: pd.Series):
    assert len(expected) == len(got)
    for e, g in zip(expected, got):
        if e is None or (isinstance(e, float) and (math.isnan(e) or math.isinf(e))):
            assert g is None or (isinstance(g, float) and math.isnan(g)), (e, g)
        else:
            assert g == pytest.approx(e, rel=1e-9, abs=1e-9)


def _spark_col(df, name):
    return df.orderBy("ts").select(f"`{name}`").toPandas()[name]


@pytest.mark.parametrize("chunk", [None, 64])
def test_rolling_and_lags_match_pandas(series, chunk):
    s, df = series
    stats = ["mean", "std", "min", "max", "median", "q25", "q75"]
    out = apply_windows(df, lambda w: W.lag_columns("value", [1, 24], w) + W.rolling_columns("value", [6, 24], stats, w),
                        halo=24, chunk_rows=chunk)
    _close(s.shift(24), _spark_col(out, "value_lag_24h"))
    for n in (6, 24):
        r = s.rolling(n)
        ref = {"mean": r.mean(), "std": r.std(), "min": r.min(), "max": r.max(), "median": r.median(),
               "q25": r.quantile(0.25), "q75": r.quantile(0.75)}
        for st in stats:
            _close(ref[st], _spark_col(out, f"value_rolling_{n}h_{st}"))


@pytest.mark.parametrize("chunk", [None, 128])
def test_ema_matches_pandas(series, chunk):
    s, df = series
    alphas = [0.3, 0.5, 0.7]
    out = W.ema_frame(df, "value", alphas, chunk)
    for a in alphas:
        _close(s.ewm(alpha=a).mean(), _spark_col(out, f"value_ema_alpha_{a}"))


def test_interpolate_and_edges_match_pandas(series):
    s, df = series
    ref = s.interpolate(method="linear").ffill().bfill()
    _close(ref, _spark_col(handle_missing(df, "interpolate", ["value"]), "value"))
    _close(s.ffill().bfill(), _spark_col(handle_missing(df, "forward_fill", ["value"]), "value"))
    _close(s.bfill().ffill(), _spark_col(handle_missing(df, "backward_fill", ["value"]), "value"))


def test_statistical_features_match_pandas(series):
    s, df = series
    cfg = FeatureConfig(target="value", lags=[], windows=[], stats=[], alphas=[], statistical=True)
    out = window_features(df, cfg)
    pad = s.ffill()
    for p in (1, 24, 168):
        ref = (pad / pad.shift(p) - 1).replace([np.inf, -np.inf], np.nan)
        _close(ref, _spark_col(out, f"value_pct_change_{p}h"))
    ref = (s / s.shift(168) - 1).replace([np.inf, -np.inf], np.nan)
    _close(ref, _spark_col(out, "value_vs_same_hour_last_week"))
    z = (s - s.rolling(168).mean()) / s.rolling(168).std()
    _close(z, _spark_col(out, "value_zscore_168h"))
