"""CSV scans, file checks, sinks and the model registry round trip."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tsforge.sources.files import (LOAD_SCHEMA, datetime_check, read_series_csv, source_profile,
                                   validate_data_file, write_frame, write_summary)


@pytest.fixture
def tmp(tmp_path):
    return str(tmp_path)


def test_csv_scan_profile_and_checks(spark, tmp):
    p = os.path.join(tmp, "load.csv")
    with open(p, "w") as f:
        f.write("timestamp,kwh\n2024-01-01 00:00:00,1.5\n2024-01-01 01:00:00,\n2024-01-01 02:00:00,2.5\n")
    df = read_series_csv(spark, p, LOAD_SCHEMA, series="meter")
    assert df.columns == ["series", "ts", "kwh"]
    prof = source_profile(df).first()
    assert prof["rows"] == 3 and str(prof["start"]) == "2024-01-01 00:00:00"
    assert validate_data_file(spark, p, ["timestamp", "kwh"])
    assert not validate_data_file(spark, p, ["timestamp", "temperature_c"])
    assert not validate_data_file(spark, os.path.join(tmp, "missing.csv"))
    assert not validate_data_file(spark, p.replace(".csv", ".txt"))
    raw = spark.read.option("header", True).csv(p)
    assert datetime_check(raw, "timestamp").first()["valid"]
    assert not datetime_check(raw, "nope").first()["present"]
    bad = spark.createDataFrame([("2024-01-01",), ("not a time",)], "t string")
    assert datetime_check(bad, "t").first()["unparseable"] == 1


def test_jsonl_check(spark, tmp):
    p = os.path.join(tmp, "w.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"timestamp": "2024-01-01", "temperature_c": 3.0}) + "\n")
        f.write(json.dumps({"timestamp": "2024-01-02", "temperature_c": 4.0}) + "\n")
    assert validate_data_file(spark, p, ["timestamp", "temperature_c"])


def test_sinks(spark, tmp):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "series string, x double")
    write_frame(df, os.path.join(tmp, "frame"))
    assert {"series=a", "series=b"} <= set(os.listdir(os.path.join(tmp, "frame")))
    m = spark.createDataFrame([("rf", 1.0), ("naive", 2.0)], "model string, rmse double")
    write_summary(m, os.path.join(tmp, "summary"), {"version": "20240101_000000"})
    meta = spark.read.json(os.path.join(tmp, "summary", "summary_metadata")).first()
    assert meta["total_metrics_count"] == 2 and meta["total_models_count"] == 2


def test_registry_round_trip(spark, tmp):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from tsforge.plans import registry as R
    data = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, label double")
    fitted = {name: Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                                     LinearRegression(regParam=reg)]).fit(data) for name, reg in (("a", 0.0), ("b", 5.0))}
    metrics = spark.createDataFrame([("a", 0.1, 0.2, 1.0, 0.99), ("b", 0.5, 0.9, 3.0, 0.9)],
                                    "model string, mae double, rmse double, mape double, r2 double")
    base = os.path.join(tmp, "registry")
    R.save_models(spark, base, fitted, metrics, ["x"], "20240101_000000")
    assert R.list_models(spark, base).count() == 2
    best = R.best_entry(spark, base, metric="rmse").first()
    assert best["model"] == "a"
    assert R.best_entry(spark, base, metric="r2").first()["model"] == "a"
    model = R.load_model(best["path"])
    assert model.transform(data).count() == 20


def test_broken_saves_are_never_listed(spark, tmp):
    from pyspark.ml import PipelineModel

    from tsforge.plans import registry as R
    base = os.path.join(tmp, "registry")
    assert R.list_models(spark, base).count() == 0
    metrics = spark.createDataFrame([("a", 1.0)], "model string, rmse double")
    with pytest.raises(AttributeError):
        R.save_models(spark, base, {"a": PipelineModel([]), "b": None}, metrics, ["x"], "20240105_000000")
    assert os.listdir(os.path.join(base, "20240105_000000"))  # something was written, nothing is seen
    assert R.list_models(spark, base).count() == 0
    R.save_models(spark, base, {"a": PipelineModel([])}, metrics, ["x"], "20240101_000000")
    assert R.latest_version(spark, base).first().version == "20240101_000000"
    R.save_models(spark, base, {"a": PipelineModel([]), "c": PipelineModel([])}, metrics, ["x"], "20240105_000000")
    again = spark.createDataFrame([("c", 0.5)], "model string, rmse double")
    R.save_models(spark, base, {"c": PipelineModel([])}, again, ["x"], "20240105_000000")  # replaced whole
    got = {(r.version, r.model): r.metrics for r in R.list_models(spark, base).collect()}
    assert got == {("20240101_000000", "a"): {"rmse": 1.0}, ("20240105_000000", "c"): {"rmse": 0.5}}
    assert R.best_entry(spark, base).first().model == "c"


def test_damaged_lines_are_set_aside(spark, tmp):
    from tsforge.sources.files import WEATHER_SCHEMA, checked_series_csv, write_quarantine
    p = os.path.join(tmp, "load.csv")
    lines = ["2024-01-01 00:00:00,1.5", "2024-01-01 01:00:00,", ",3", "then,4", "2024-01-01 02:00:00,many", "2024-01-01 03:00:00", "2024-01-01 04:00:00,1,2", '"2024-01-01 05:00:00","7"']
    with open(p, "w") as f:
        f.write("\n".join(["timestamp,kwh", *lines]) + "\n")
    good, bad = checked_series_csv(spark, p, LOAD_SCHEMA, "m")
    assert [(r.series, str(r.ts), r.kwh) for r in good.orderBy("ts").collect()] == [
        ("m", "2024-01-01 00:00:00", 1.5), ("m", "2024-01-01 01:00:00", None), ("m", "2024-01-01 05:00:00", 7.0)]
    assert sorted((r.reason, r.line) for r in bad.collect()) == sorted([
        ("no time", ",3"), ("time", "then,4"), ("number: kwh", "2024-01-01 02:00:00,many"), ("line", "2024-01-01 03:00:00"), ("line", "2024-01-01 04:00:00,1,2")])
    assert {r.reason: r.lines for r in write_quarantine(bad, os.path.join(tmp, "q")).collect()} == {"no time": 1, "time": 1, "number: kwh": 1, "line": 2}
    w = os.path.join(tmp, "weather.csv")
    with open(w, "w") as f:
        f.write("2024-01-01,1,2,3,4,5,6\n2024-01-02,1,2,x,4,5,y\n")
    good, bad = checked_series_csv(spark, w, WEATHER_SCHEMA, header=False)
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["number: wind_speed_kmh"]


def test_columns_of_late_json_lines_count(spark, tmp):
    p = os.path.join(tmp, "late.jsonl")
    with open(p, "w") as f:
        f.writelines(json.dumps({"timestamp": str(i)}) + "\n" for i in range(500))
        f.write(json.dumps({"timestamp": "x", "kwh": 1.0}) + "\n")
    assert validate_data_file(spark, p, ["timestamp", "kwh"])
    assert not validate_data_file(spark, p, ["timestamp", "other"])
    one = os.path.join(tmp, "one.json")
    with open(one, "w") as f:
        f.write('[\n {"timestamp": "a",\n "kwh": 1}\n]\n')
    assert validate_data_file(spark, one, ["timestamp", "kwh"])
    empty = os.path.join(tmp, "empty.json")
    open(empty, "w").close()
    assert validate_data_file(spark, empty) and not validate_data_file(spark, empty, ["kwh"])
