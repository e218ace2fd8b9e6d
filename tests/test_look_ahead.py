"""Fills at scale: a look-up costs a row's work whatever the length of its chunk, and the filled load is made once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tsforge.operators import outliers
from tsforge.operators.sequence import neighbours
from tsforge.plans.preprocess import preprocess

T0 = dt.datetime(2024, 3, 1)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower().replace(" ", "")


@pytest.mark.parametrize("chunk", [None, 4])
def test_no_frame_reaches_to_the_end(spark, chunk):
    values = [None, 1.0, None, None, 4.0, None, None, None, None, None, 10.0, None]
    df = spark.createDataFrame([(s, T0 + dt.timedelta(hours=i), v) for s in ("a", None) for i, v in enumerate(values)],
                               "series string, ts timestamp, value double")
    nb = neighbours(df, ["value"], chunk)
    assert "unboundedfollowing" not in _plan(nb)
    got = {(r["series"], r["_idx"]): (r["_prev_value"], r["_next_value"]) for r in nb.collect()}
    assert len(got) == 2 * len(values)
    for (_, i), (p, n) in got.items():
        at = [k for k, v in enumerate(values) if v is not None]
        prev, nxt = max((k for k in at if k <= i), default=None), min((k for k in at if k >= i), default=None)
        assert (p and (p["p"], p["v"])) == (None if prev is None else (prev, values[prev]))
        assert (n and (n["p"], n["v"])) == (None if nxt is None else (nxt, values[nxt]))


def test_filled_load_is_made_once(spark, monkeypatch):
    load = spark.range(400).select(F.lit("p").alias("series"), (F.lit(T0) + F.expr("make_dt_interval(0, 0, cast(id * 20 as int))")).alias("ts"),
                                   F.when(F.col("id") % 7 != 3, F.col("id") % 11 + F.when(F.col("id") == 50, 900).otherwise(0)).cast("double").alias("kwh"))
    weather = spark.range(133).select((F.lit(T0) + F.expr("make_dt_interval(0, cast(id as int))")).alias("ts"), F.lit(5.0).alias("temperature_c"))
    seen, fences = [], outliers.exact_quantiles
    monkeypatch.setattr(outliers, "exact_quantiles", lambda df, *a: seen.append(_plan(df)) or fences(df, *a))
    processed, _, stats = preprocess(load, weather)
    assert len(seen) == 1 and "window" not in seen[0] and "aggregate" not in seen[0]
    assert stats.first()["outlier_count"] == 1
    assert processed.count() == 132
