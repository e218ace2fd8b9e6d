"""Chunk+halo windows and chunked fills must equal the plain per-series window,
including across many chunk boundaries (tiny chunks force them)."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsforge.functions import windows as W
from tsforge.operators.nulls import handle_missing, interpolate_only
from tsforge.operators.sequence import apply_windows, with_row_index


def _series_frame(spark, n=700, null_rate=0.15, seed=7, drop_rate=0.05):
    rnd = random.Random(seed)
    rows = []
    for s in ("a", "b", "c"):
        t0 = pd.Timestamp("2024-02-27 00:00:00")
        for i in range(n if s != "c" else n // 3):
            if rnd.random() < drop_rate:
                continue  # rows removed (outliers): windows are row-based
            v = None if rnd.random() < null_rate else round(rnd.uniform(-5, 50), 2)
            rows.append((s, (t0 + pd.Timedelta(hours=i)).to_pydatetime(), v))
    # leading and trailing null runs in series a
    rows = [(s, t, None) if s == "a" and (t.hour < 3 and t.day == 27) else (s, t, v) for s, t, v in rows]
    return spark.createDataFrame(rows, "series string, ts timestamp, value double")


def _collect(df, cols):
    pdf = df.select("series", "ts", *cols).toPandas().sort_values(["series", "ts"]).reset_index(drop=True)
    return pdf


def _assert_same(a, b, cols):
    assert len(a) == len(b)
    for c in cols:
        for x, y in zip(a[c], b[c]):
            if x is None or (isinstance(x, float) and math.isnan(x)):
                assert y is None or (isinstance(y, float) and math.isnan(y)), c
            else:
                assert y == pytest.approx(x, rel=1e-9, abs=1e-9), c


def test_row_index_is_exact(spark):
    df = _series_frame(spark)
    idx = with_row_index(df).toPandas().sort_values(["series", "ts"])
    for _, g in idx.groupby("series"):
        assert list(g["_idx"]) == list(range(len(g)))


@pytest.mark.parametrize("chunk", [40, 200])
def test_window_features_chunked_equal_plain(spark, chunk):
    df = _series_frame(spark)
    alphas = [0.5, 0.7]

    def build(w):
        return (W.lag_columns("value", [1, 2, 24], w) + W.rolling_columns("value", [6, 24], ["mean", "std", "min", "median"], w)
                + W.ema_columns("value", alphas, w))

    halo = max(24, W.halo_for(alphas=alphas))
    cols = [f"value_lag_{n}h" for n in (1, 2, 24)] + [f"value_rolling_{n}h_{s}" for n in (6, 24) for s in ("mean", "std", "min", "median")] \
        + [f"value_ema_alpha_{a}" for a in alphas]
    plain = _collect(apply_windows(df, build, halo, None), [f"`{c}`" for c in cols])
    chunked = _collect(apply_windows(df, build, halo, chunk), [f"`{c}`" for c in cols])
    _assert_same(plain, chunked, cols)


@pytest.mark.parametrize("method", ["interpolate", "forward_fill", "backward_fill"])
def test_fills_chunked_equal_plain(spark, method):
    df = _series_frame(spark, null_rate=0.4)
    plain = _collect(handle_missing(df, method, ["value"], chunk_rows=None), ["value"])
    chunked = _collect(handle_missing(df, method, ["value"], chunk_rows=16), ["value"])
    _assert_same(plain, chunked, ["value"])


def test_long_null_gap_crosses_chunks(spark):
    rows = [("s", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), float(i) if i in (3, 95) else None) for i in range(120)]
    df = spark.createDataFrame([(s, t.to_pydatetime(), v) for s, t, v in rows], "series string, ts timestamp, value double")
    out = _collect(interpolate_only(df, ["value"], chunk_rows=10), ["value"])
    vals = list(out["value"])
    assert all(v is None or math.isnan(v) for v in vals[:3])           # leading stay null
    assert vals[50] == pytest.approx(50.0)                               # linear across 9 chunks
    assert all(v == pytest.approx(95.0) for v in vals[96:])              # trailing take the last value


def test_row_index_deterministic_with_duplicate_stamps(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", t0 + dt.timedelta(minutes=i // 3), float((i * 7) % 5)) for i in range(300)]  # 3 rows per stamp
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double").repartition(7)
    a = with_row_index(df).toPandas().sort_values(["ts", "value", "_idx"]).reset_index(drop=True)
    b = with_row_index(df.repartition(3)).toPandas().sort_values(["ts", "value", "_idx"]).reset_index(drop=True)
    assert sorted(a["_idx"]) == list(range(300))
    assert list(a["_idx"]) == list(b["_idx"])  # same positions whatever the input partitioning


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_carry_in_levels(spark, monkeypatch, levels):
    """Gaps over chunks, stretches and stretches of stretches; a series without a name too."""
    from tsforge.operators import sequence
    monkeypatch.setattr(sequence, "FAN", 3)
    monkeypatch.setattr(sequence, "LEVELS", levels)
    t0 = pd.Timestamp("2024-01-01")
    rows = [(s, (t0 + pd.Timedelta(hours=i)).to_pydatetime(), float(i) if i in (5, 6, 390) or (s is None and i % 41 == 0) else None)
            for s in ("a", None) for i in range(500)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    for method in ("interpolate", "forward_fill", "backward_fill"):
        plain = _collect(handle_missing(df, method, ["value"], chunk_rows=None), ["value"])
        chunked = _collect(handle_missing(df, method, ["value"], chunk_rows=4), ["value"])
        _assert_same(plain, chunked, ["value"])


def test_no_window_over_all_chunks_of_a_series(spark):
    plan = handle_missing(_series_frame(spark, 60), "interpolate", ["value"], chunk_rows=4)._jdf.queryExecution().optimizedPlan().toString()
    carries = [line for line in plan.split("\n") if "+- Window" in line and ("_cp_" in line or "_cn_" in line)]
    assert any("_stretch1" in line for line in carries)  # the first level's windows hold one stretch of chunks
    assert not any("[_chunk" in line.rsplit(", [", 1)[1] and "_stretch1" not in line for line in carries)


@pytest.mark.parametrize("block", [None, 7, 64])
def test_ema_by_blocks_equals_plain(spark, block):
    """Long gaps, blocks shorter and longer than a weight lasts, a series without a name."""
    df = _series_frame(spark, 500, null_rate=0.3).withColumn("series", F.when(F.col("series") != "b", F.col("series"))) \
        .withColumn("value", F.when((F.dayofyear("ts") < 63) | (F.dayofyear("ts") > 69), F.col("value")))
    alphas = [0.1, 0.5, 0.9]
    names = [f"e{a}" for a in alphas]
    cols = [f"`{n}`" for n in names]
    plain = _collect(apply_windows(df, lambda w: W.ema_columns("value", alphas, w, names), W.halo_for(alphas=alphas), None), cols)
    got = _collect(W.ema_by_blocks(with_row_index(df), "value", alphas, names, block), cols)
    _assert_same(plain, got, names)
    assert got["e0.1"].notna().sum() > 300
