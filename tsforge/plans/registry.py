"""Model registry on shared storage (S10-S14): a folder of fitted models and metadata (version, model, path, features,
metrics) for each version.

A version is there once its manifest is: models and metadata are written first, then the manifest under a name that nobody
reads, and one rename makes it seen. What a run that broke off has left is never listed; the same version may be saved again,
and is replaced whole by the next rename."""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.plans.boosting import BoostedTrees

METADATA, MANIFESTS = "metadata", "_manifests"
SCHEMA = "version string, model string, path string, features array<string>, metrics map<string,double>"
VERSION_FORMAT = "%Y%m%d_%H%M%S"


def new_version(now: _dt.datetime | None = None) -> str:
    """S10 version text ``YYYYmmdd_HHMMSS`` (``now`` explicit for reproducible runs)."""
    return (now or _dt.datetime.now(_dt.timezone.utc)).strftime(VERSION_FORMAT)


def save_models(spark: SparkSession, base: str, models: dict[str, PipelineModel | BoostedTrees], metrics: DataFrame,
                features: list[str], version: str) -> DataFrame:
    """Write each model and one metadata row per model below ``base/<version>``, then commit the version.

    ``metrics`` has one row per model (model, mae, rmse, mape, r2); it is joined, not collected."""
    rows, attempt = [], uuid.uuid4().hex
    folder = f"{base.rstrip('/')}/{version}/{attempt}"
    for name, m in models.items():
        path = f"{folder}/{name}"
        m.write().overwrite().save(path)
        rows.append((version, name, path, features))
    meta = spark.createDataFrame(rows, "version string, model string, path string, features array<string>")
    mcols = [c for c in ("mae", "rmse", "mape", "r2") if c in metrics.columns]
    metric_map = F.map_from_arrays(F.array(*[F.lit(c) for c in mcols]), F.array(*[F.col(c).cast("double") for c in mcols]))
    meta = meta.join(metrics.select("model", metric_map.alias("metrics")), "model", "left").select("version", "model", "path", "features", "metrics")
    meta.write.parquet(f"{folder}/{METADATA}")
    _commit(spark, base, version, f"{folder}/{METADATA}", len(rows))
    return spark.read.schema(meta.schema).parquet(f"{folder}/{METADATA}")


def _commit(spark: SparkSession, base: str, version: str, metadata: str, models: int) -> None:
    """Write the manifest aside and rename it into place, over an older one."""
    fs, path = _store(spark, base)
    hidden, seen = path(f"{base.rstrip('/')}/{MANIFESTS}/.{version}-{uuid.uuid4().hex}"), path(f"{base.rstrip('/')}/{MANIFESTS}/{version}.json")
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps({"version": version, "metadata": metadata, "models": models}).encode()))
    out.close()
    if fs.exists(seen):
        fs.delete(seen, False)
    if not fs.rename(hidden, seen):
        raise OSError(f"the manifest of version {version} could not be put into place")


def _store(spark: SparkSession, base: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def list_models(spark: SparkSession, base: str) -> DataFrame:
    """Registered models of committed versions (only real model folders, never auxiliary files)."""
    fs, path = _store(spark, base)
    folder = path(f"{base.rstrip('/')}/{MANIFESTS}")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    if not any(n.endswith(".json") and not n.startswith(".") for n in names):
        return spark.createDataFrame([], SCHEMA)
    # one manifest a version
    found = [r.metadata for r in spark.read.schema("version string, metadata string, models int").json(f"{base.rstrip('/')}/{MANIFESTS}/*.json").collect()]
    return spark.read.schema(SCHEMA).parquet(*found)


def latest_version(spark: SparkSession, base: str) -> DataFrame:
    """The newest version (versions sort as text)."""
    return list_models(spark, base).agg(F.max("version").alias("version"))


def best_entry(spark: SparkSession, base: str, version: str | None = None, metric: str = "rmse") -> DataFrame:
    """The best model of a version (latest when None): min of mae/rmse/mape, max of r2; NULL/NaN never wins."""
    reg = list_models(spark, base)
    if version is None:
        reg = reg.join(latest_version(spark, base), "version")
    else:
        reg = reg.where(F.col("version") == version)
    m = F.col("metrics")[metric]
    reg = reg.where(m.isNotNull() & ~F.isnan(m))
    pick = F.max_by if metric == "r2" else F.min_by
    return reg.groupBy("version").agg(pick(F.struct("model", "path", "features", "metrics"), m).alias("best")).select("version", "best.*")


def load_model(path: str) -> PipelineModel | BoostedTrees:
    """S12."""
    spark = SparkSession.active()
    about = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/about")
    if about.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(about):
        return BoostedTrees.load(spark, path)
    return PipelineModel.load(path)
