"""End-to-end run (M10): preprocess -> features -> baselines + fitted models -> metrics -> CV -> save -> best -> summary.

Every stage is a DataFrame job; stage outputs are checkpointed into the shared
folder (preprocess, training frame) so a lost executor recomputes only its stage.
Only metric rows (one per model and fold) are small results.

A run with a folder can be repeated after it broke off: each stage is committed below a fingerprint of the input's rows
and the configuration, and a later run with the same fingerprint reads the committed stages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.plans import models as M
from tsforge.plans import registry
from tsforge.plans.features import FeatureConfig, engineer_features
from tsforge.plans.metrics import best_model
from tsforge.plans.preprocess import PreprocessConfig, preprocess
from tsforge.session import cut_lineage
from tsforge.sources.files import write_summary


def fingerprint(inputs: list[DataFrame], *settings) -> str:
    """A name for a run: from the number and an order-free hash of the inputs' rows, and the settings."""
    rows = [tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).first()) for df in inputs]
    return hashlib.sha256(repr((rows, [df.dtypes for df in inputs], settings)).encode()).hexdigest()[:24]


class Stages:
    """Stage outputs of runs in a folder. A stage is committed when Spark has put its ``_SUCCESS`` file there."""

    def __init__(self, spark: SparkSession, base: str | None, run: str):
        self.spark, self.base, self.run = spark, base, run

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The committed output of stage ``name``, or what ``build`` gives, written and committed."""
        if self.base is None:
            return cut_lineage(build())
        path = f"{self.base}/{name}/{self.run}"
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            build().write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
        return self.spark.read.parquet(path)


def run_complete(load: DataFrame, weather: DataFrame, presets: list, cv_folds: int = 3, out: str | None = None, version: str | None = None,
                 pre_cfg: PreprocessConfig = PreprocessConfig(), feat_cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Metrics of the baselines and of every preset on the test split, and the CV folds of every preset.

    Output ``(model, fold, n, mae, rmse, mape, r2, best)``; ``fold`` is NULL for the test split, ``best`` marks its
    model of least RMSE. With ``out`` the processed and feature frames, the fitted models with their metadata
    (``registry``) and the run's summary are written there.
    """
    spark, t = load.sparkSession, feat_cfg.target
    stages = Stages(spark, out, fingerprint([load, weather], presets, cv_folds, pre_cfg, feat_cfg) if out else "")
    processed = stages.once("preprocessed", lambda: preprocess(load, weather, pre_cfg)[0])
    eng = stages.once("features", lambda: engineer_features(processed, feat_cfg))

    def fitted() -> DataFrame:
        prepared = M.training_frame(eng, t)  # materialised once; fits, baselines and folds reuse it
        metrics, models, *folds = M.evaluate_with_baselines(eng, t, presets, prepared=prepared, n_splits=cv_folds)
        test = cut_lineage(metrics.withColumn("fold", F.lit(None).cast("int")).select("model", "fold", "n", "mae", "rmse", "mape", "r2"))
        if out is not None:
            registry.save_models(spark, f"{out}/models", models, test, prepared[1], version or registry.new_version())
        return reduce(DataFrame.unionByName, folds, test)

    result = stages.once("metrics", fitted)
    best = best_model(result.where("fold IS NULL"), "rmse").select("best_model")
    if out is not None:
        write_summary(result, f"{out}/summary", {"version": registry.latest_version(spark, f"{out}/models").first()[0], "best_model": best.first()[0],
                                                 "models": [p.name for p in presets]})
    return result.join(F.broadcast(best), F.col("fold").isNull() & (F.col("model") == F.col("best_model")), "left") \
        .withColumn("best", F.col("best_model").isNotNull()).drop("best_model")


def run_on_tables(spark: SparkSession, sf_dir: str, presets: list, out: str | None = None) -> DataFrame:
    from tsforge.sources import series as S
    return run_complete(S.load_series(spark, sf_dir, raw=True), S.weather_series(spark, sf_dir), presets, out=out)
