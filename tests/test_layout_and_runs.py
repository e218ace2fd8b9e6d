"""Bucketed frames, streamed merges and runs that are taken up again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tsforge.operators.joins import merge_on_time
from tsforge.plans import models as M
from tsforge.plans import run as R
from tsforge.sources.files import write_bucketed
from tsforge.streaming.hourly import merge_streams, run_appending

T0 = dt.datetime(2024, 1, 1)


def hourly(spark, n, name, start=0, series=True):
    rows = [(("s",) if series else ()) + (T0 + dt.timedelta(hours=i), float(i)) for i in range(start, n)]
    return spark.createDataFrame(rows, ("series string, " if series else "") + f"ts timestamp, {name} double")


def test_bucketed_frames_join_without_a_shuffle(spark, tmp_path):
    load, weather = hourly(spark, 300, "kwh"), hourly(spark, 260, "t", series=False)
    a, b = (write_bucketed(df, f"file://{tmp_path}/{k}", ["ts"], 4) for k, df in enumerate((load, weather)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge_on_time(a, b)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Exchange" in merge_on_time(load, weather)._jdf.queryExecution().executedPlan().toString()
        assert merged.exceptAll(merge_on_time(load, weather)).count() == 0 and merged.count() == 260
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_streams_meet_whichever_comes_first(spark, tmp_path):
    path = f"file://{tmp_path}"
    parts = [(hourly(spark, 50, "kwh"), hourly(spark, 10, "t", series=False)), (hourly(spark, 55, "kwh", 50), hourly(spark, 70, "t", 10, False)),
             (hourly(spark, 80, "kwh", 55), hourly(spark, 75, "t", 70, False))]
    counts = []
    for load, weather in parts:
        for name, df in (("load", load), ("weather", weather)):
            df.write.mode("append").parquet(f"{path}/{name}")
        streams = [spark.readStream.schema(df.schema).parquet(f"{path}/{n}") for n, df in (("load", load), ("weather", weather))]
        counts.append(run_appending(merge_streams(*streams, delay="60 hours"), f"{path}/table", f"{path}/ck").count())
    assert counts == [10, 55, 75]
    got = spark.read.parquet(f"{path}/table")
    assert got.where("kwh = t").count() == 75 and got.select("ts").distinct().count() == 75


def test_a_run_that_broke_off_is_taken_up(spark, tmp_path, monkeypatch):
    rows = [("m", T0 + dt.timedelta(hours=i), 10.0 + i % 24 + (i % 7) / 10) for i in range(900)]
    load = spark.createDataFrame(rows, "series string, ts timestamp, kwh double")
    weather = spark.createDataFrame([(t, float(i % 20), 50.0) for i, (_, t, _) in enumerate(rows)], "ts timestamp, temperature_c double, humidity_percent double")
    presets = [M.TreePreset("small", "gbt", (("maxIter", 3), ("maxDepth", 3), ("seed", 1)))]
    out = f"file://{tmp_path}/run"
    with monkeypatch.context() as broken:
        broken.setattr(M, "evaluate_with_baselines", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            R.run_complete(load, weather, presets, 2, out)
    never = lambda *a, **k: (_ for _ in ()).throw(AssertionError("stage repeated"))
    monkeypatch.setattr(R, "preprocess", never)
    monkeypatch.setattr(R, "engineer_features", never)
    first = sorted(map(tuple, R.run_complete(load, weather, presets, 2, out).collect()), key=str)
    assert len(first) == 4 + 2 and sum(r[-1] for r in first) == 1
    monkeypatch.setattr(M, "evaluate_with_baselines", never)
    assert sorted(map(tuple, R.run_complete(load, weather, presets, 2, out).collect()), key=str) == first
    with pytest.raises(AssertionError, match="repeated"):  # another input is another run
        R.run_complete(load.withColumn("kwh", F.col("kwh") + 1), weather, presets, 2, out)
