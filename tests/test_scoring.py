"""Scenario scoring against values computed by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tsforge.plans.scoring import forecast_summary, heuristic_horizon, heuristic_next_hour, horizon_check

W = "struct<temperature_c:double,humidity_percent:double,wind_speed_kmh:double,precipitation_mm:double,cloud_cover_percent:double,solar_irradiance_wm2:double>"
DAY = [0.5 + 0.25 * k for k in range(18)] + [7.0, 9.0, 8.0, 6.0, 5.5, 4.0]
SINGLE = [1.0, 1.5, 2.0, 2.5, 3.5, 4.0, 5.0, 6.5]
END = dt.datetime(2024, 3, 4, 14)  # a Monday, 14:00


def _sc(spark, rows):
    return spark.createDataFrame(rows, f"scenario string, end_ts timestamp, recent array<double>, weather {W}, horizon int")


def test_next_hour_matches_hand_computation(spark):
    sc = _sc(spark, [("single", END, SINGLE, None, 1), ("day", END, DAY, (18.0, 50.0, 5.0, 1.0, 90.0, 10.0), 24),
                     ("hot", END, SINGLE, (30.0, None, None, None, None, None), 1), ("short", END, [1.0, 2.0], None, 1)])
    out = {r["scenario"]: r for r in heuristic_next_hour(sc).collect()}
    m3, p3 = (4.0 + 5.0 + 6.5) / 3, (2.0 + 2.5 + 3.5) / 3
    hf = 1 + 0.2 * math.sin(2 * math.pi * (14 - 6) / 24)
    assert out["single"]["prediction"] == pytest.approx(m3 * (m3 / p3) * hf)
    assert out["hot"]["weather_factor"] == pytest.approx(1.1)
    assert out["short"]["prediction"] is None and out["short"]["error"]
    dm3, dp3 = (6.0 + 5.5 + 4.0) / 3, (7.0 + 9.0 + 8.0) / 3
    assert out["day"]["prediction"] == pytest.approx(dm3 * (dm3 / dp3) * hf * 1.0)


def test_batch_horizons_and_invalid(spark):
    sc = _sc(spark, [("b0", END, [0.5, 0.75, 1.0, 1.25, 6.0], (19.0, 70.0, None, None, None, None), 12),
                     ("b1", END, [9.0, 8.0, 7.0, 6.0], (21.0, 40.0, None, None, None, None), 12),
                     ("bad", END, [], None, 1000)])
    assert horizon_check(sc).where("error IS NOT NULL").select("scenario").first()[0] == "bad"
    steps = heuristic_horizon(sc, "daily_weekly")
    bad = steps.where("scenario = 'bad'").collect()
    assert len(bad) == 1 and bad[0]["error"] and bad[0]["step"] is None and bad[0]["prediction"] is None
    b0 = steps.where("scenario = 'b0'").orderBy("step").toPandas()
    m3 = (1.0 + 1.25 + 6.0) / 3
    assert len(b0) == 12
    assert b0["prediction"][0] == pytest.approx(max(0.1, m3 * (1 + 0.3 * math.sin(2 * math.pi * (14 - 6) / 24)) * 1.1))
    assert b0["ts"][0] == dt.datetime(2024, 3, 4, 15)
    s = forecast_summary(steps).where("scenario = 'b0'").first()
    assert s["steps"] == 12 and s["peak_hour"] == pytest.approx(round(b0["prediction"].max(), 3))


def test_six_hour_daily_variant(spark):
    sc = _sc(spark, [("six", END, SINGLE, None, 6)])
    out = heuristic_horizon(sc, "daily").orderBy("step").toPandas()
    m3 = (4.0 + 5.0 + 6.5) / 3
    assert list(out["prediction"]) == pytest.approx([m3 * (1 + 0.3 * math.sin(2 * math.pi * i / 24)) for i in range(6)])


def test_nulls_in_the_history_do_not_count(spark):
    sc = _sc(spark, [("gap", END, [1.0, 2.0, 3.0, None], None, 2), ("few", END, [1.0, None, 3.0], None, 2), ("none", END, None, None, 2)])
    out = heuristic_horizon(sc, "daily_weekly").toPandas()
    gap = out[out.scenario == "gap"].sort_values("step")
    assert gap["prediction"].tolist()[0] == pytest.approx(2.0 * (1 + 0.3 * math.sin(2 * math.pi * 8 / 24)) * 1.1)
    assert out[out.scenario != "gap"]["error"].notna().all() and len(out) == 4
