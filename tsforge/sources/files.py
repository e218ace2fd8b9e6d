"""File scans, checks and sinks.

CSV/JSON inputs are read with a declared schema (no inference); checks return
small result rows instead of printing; sinks write partitioned parquet (or CSV
on request) so downstream jobs prune by series.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tsforge import SERIES, TS
from tsforge.sources.series import WEATHER_COLUMNS
from tsforge.sources.tables import clean_scan

LOAD_SCHEMA = "timestamp string, kwh double"
WEATHER_SCHEMA = "timestamp string, " + ", ".join(f"{c} double" for c in WEATHER_COLUMNS)
ACCEPTED_SUFFIXES = (".csv", ".json", ".jsonl")


def read_series_csv(spark: SparkSession, path: str, schema: str, series: str | None = None,
                    ts_col: str = "timestamp") -> DataFrame:
    """CSV with header -> ``(series, ts, measures...)``; the time text is parsed once."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    out = df.withColumn(TS, F.to_timestamp(ts_col)).drop(ts_col)
    if series is not None:
        out = out.withColumn(SERIES, F.lit(series))
    lead = [c for c in (SERIES, TS) if c in out.columns]
    return clean_scan(out.select(*lead, *[c for c in out.columns if c not in lead]))


def source_profile(df: DataFrame) -> DataFrame:
    """S3: rows, first and last stamp per series (one aggregate)."""
    keys = [SERIES] if SERIES in df.columns else []
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(TS).alias("start"), F.max(TS).alias("end"))


REASON = "reason"


def checked_series_csv(spark: SparkSession, path: str, schema: str, series: str | None = None, ts_col: str = "timestamp",
                       header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1/S2/S4/S5 for files that may be damaged: (good rows as ``read_series_csv`` gives them, quarantine).

    The quarantine holds every other line whole, with what is wrong with it first: ``line`` (too few or too many
    fields), ``no time``, ``time`` (cannot be read as a time stamp), or ``number: <column>``. Empty measures are NULLs, not faults.
    """
    fields = StructType.fromDDL(schema).fields
    text = StructType([StructField(f.name, StringType()) for f in fields] + [StructField("_line", StringType())])
    raw = spark.read.schema(text).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
    stamp = F.expr(f"try_to_timestamp(`{ts_col}`)")
    value = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in fields if f.name != ts_col}
    reason = F.when(F.col("_line").isNotNull(), "line").when(F.coalesce(F.trim(ts_col), F.lit("")) == "", "no time").when(stamp.isNull(), "time")
    for name, x in value.items():
        reason = reason.when(F.col(f"`{name}`").isNotNull() & x.isNull(), f"number: {name}")
    whole = F.coalesce("_line", F.concat_ws(",", *[F.coalesce(F.col(f"`{f.name}`"), F.lit("")) for f in fields]))
    seen = raw.withColumn(REASON, reason)
    key = [] if series is None else [F.lit(series).alias(SERIES)]
    good = seen.where(F.col(REASON).isNull()).select(*key, stamp.alias(TS), *[x.alias(n) for n, x in value.items()])
    return clean_scan(good), seen.where(F.col(REASON).isNotNull()).select(REASON, whole.alias("line"))


def write_quarantine(bad: DataFrame, path: str) -> DataFrame:
    """Write the lines set aside, a folder for each reason; (reason, lines) as they were written."""
    bad.write.mode("overwrite").partitionBy(REASON).parquet(path)
    return bad.sparkSession.read.schema("line string, reason string").parquet(path).groupBy(REASON).agg(F.count(F.lit(1)).alias("lines"))


def validate_data_file(spark: SparkSession, path: str, required_columns: list[str] | None = None) -> bool:
    """The file exists in whatever store the path names, has an accepted suffix and (optionally) all required columns.

    Columns of a CSV file are its header's; those of JSON lines are the keys of any line (one pass over all lines), those
    of a file that is one JSON document the document's. An empty file has none."""
    if not path.endswith(ACCEPTED_SUFFIXES):
        return False
    try:
        empty = spark.read.text(path).isEmpty()
    except AnalysisException:  # no such path
        return False
    if not required_columns:
        return True
    if empty:
        return False
    if path.endswith(".csv"):
        cols = set(spark.read.option("header", True).csv(path).columns)
    else:
        cols = set(spark.read.json(path).columns) - {"_corrupt_record"} or set(spark.read.option("multiLine", True).json(path).columns)
    return set(required_columns) <= cols


def datetime_check(df: DataFrame, col: str) -> DataFrame:
    """One row ``(present, unparseable, valid)``; valid when every non-null value parses."""
    if col not in df.columns:
        return df.sparkSession.createDataFrame([(False, None, False)], "present boolean, unparseable long, valid boolean")
    c = F.col(col)
    bad = F.count_if(c.isNotNull() & F.expr(f"try_to_timestamp(cast(`{col}` as string))").isNull())
    return df.agg(F.lit(True).alias("present"), bad.alias("unparseable")).withColumn("valid", F.col("unparseable") == 0)


def write_frame(df: DataFrame, path: str, fmt: str = "parquet", partition_by_series: bool = True) -> None:
    """Write a stage output; parquet partitioned by series (CSV with header on request)."""
    w = df.write.mode("overwrite")
    if partition_by_series and SERIES in df.columns:
        w = w.partitionBy(SERIES)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """S7/S8 for frames that are joined again and again: written as ``buckets`` sorted files by the hash of ``keys``. Two frames
    written with the same keys and number are joined on them where they lie, without a shuffle (J1, J2)."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_frame(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """A written frame again, columns in the order of ``like`` (a partition column comes back last otherwise)."""
    df = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return df.select(*[F.col(f"`{c}`").cast(like.schema[c].dataType) for c in like.columns]) if like is not None else df


def write_summary(metrics: DataFrame, path: str, extra: dict | None = None) -> None:
    """Metrics as JSON lines (one object per model/fold) plus a metadata object
    with the metric and model counts (counted by Spark, not from a nested key)."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    counts = metrics.agg(F.count(F.lit(1)).alias("total_metrics_count"),
                         F.countDistinct("model").alias("total_models_count"))
    meta = counts.select("*", *[F.lit(json.dumps(v) if isinstance(v, (dict, list)) else v).alias(k)
                                for k, v in (extra or {}).items()])
    meta.write.mode("overwrite").json(f"{path}/summary_metadata")
