"""Model training, cross-validation and scoring on pyspark.ml.

Boosted trees of all presets and folds are grown together (``plans/boosting.py``); forests are Spark's
``RandomForestRegressor`` on features of a ``VectorAssembler``, fitted from several threads. Predictions are joined to their actuals by ``(series, ts)`` and all
metrics come from :mod:`tsforge.plans.metrics`. Only metric rows are small
enough to reach the driver; nothing else is collected.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.operators.joins import join_same
from tsforge.operators.nulls import column_medians, rows_with_few_nulls
from tsforge.operators.sequence import IDX, with_row_index
from tsforge.plans.baselines import with_split
from tsforge.plans.boosting import BoostedTrees, Boosting, fit_many
from tsforge.plans.metrics import regression_metrics
from tsforge.session import cut_lineage


@dataclass(frozen=True)
class TreePreset:
    name: str
    kind: str  # "gbt" | "rf"
    params: tuple  # (key, value) pairs for the estimator

    def boosting(self) -> Boosting:
        p = dict(self.params)
        return Boosting(p.get("maxIter", 100), p.get("maxDepth", 6), p.get("stepSize", 0.1), p.get("subsamplingRate", 1.0),
                        float(p.get("featureSubsetStrategy", 1.0)), p.get("l2", 1.0), p.get("leastRows", 1), p.get("seed", 42))


# Fixed presets of the reference: boosted trees 200 x depth 8, rate 0.1, 80 % rows and
# columns, seed 42 (A); same numbers in a second library (B), whose defaults are no row sampling
# unless asked for by interval, no penalty on leaves and 20 rows a leaf; random forest 100 x depth 10, seed 42.
PRESETS = {
    "boosted_a": TreePreset("boosted_a", "gbt", (("maxIter", 200), ("maxDepth", 8), ("stepSize", 0.1),
                                                  ("subsamplingRate", 0.8), ("featureSubsetStrategy", "0.8"), ("seed", 42))),
    "boosted_b": TreePreset("boosted_b", "gbt", (("maxIter", 200), ("maxDepth", 8), ("stepSize", 0.1),
                                                  ("subsamplingRate", 1.0), ("featureSubsetStrategy", "0.8"), ("l2", 0.0), ("leastRows", 20), ("seed", 42))),
    "random_forest": TreePreset("random_forest", "rf", (("numTrees", 100), ("maxDepth", 10),
                                                         ("featureSubsetStrategy", "all"), ("seed", 42))),
}
# Library-wide defaults when a model is built without arguments: 100 trees, depth 6 / 10.
DEFAULT_PRESETS = {
    "boosted_default": TreePreset("boosted_default", "gbt", (("maxIter", 100), ("maxDepth", 6), ("stepSize", 0.1), ("seed", 42))),
    "random_forest_default": TreePreset("random_forest_default", "rf", (("numTrees", 100), ("maxDepth", 10), ("seed", 42))),
}


def evaluate_with_baselines(df: DataFrame, target: str, presets: list[TreePreset], test_size: float = 0.2,
                            prepared: tuple | None = None, n_splits: int = 0) -> tuple:
    """M6 + M7 + M9: fitted presets and the three baselines on the same filtered target and
    the same time split (baselines from the training frame's label, as the reference does).
    Returns ``(metrics, models)``, and with ``n_splits`` the folds' metrics (M8) as a third."""
    from tsforge.plans.baselines import BASELINES, baseline_predictions, to_long
    prepared = prepared or training_frame(df, target, test_size=test_size)
    frame, _ = prepared
    _, long, models, _, *folds = train_and_evaluate(df, target, presets, test_size, prepared=prepared, n_splits=n_splits)
    y = frame.select(SERIES, TS, IDX, "is_test", "label")
    base = to_long(baseline_predictions(y, "label"), "label", [b[0] for b in BASELINES], keep=["is_test"])
    metrics = regression_metrics(long.unionByName(base.where("is_test").drop("is_test")), ["model"])
    return with_failures(metrics, [p.name for p in presets if p.name not in models]), models, *folds


ROWS_PER_PARTITION = 50_000


def sized(df: DataFrame) -> DataFrame:
    """Rows dealt over as many partitions as they fill: forests run one job per level, and empty
    partitions cost more than the rows of a small frame."""
    return cut_lineage(df.repartition(max(1, math.ceil(df.count() / ROWS_PER_PARTITION))))


def _memory_mb(text: str | None, default: int) -> int:
    if not text:
        return default
    t = text.strip().lower()
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    if t[-1] in units:
        return int(float(t[:-1]) * units[t[-1]])
    if t.endswith("b") and t[-2] in units:
        return int(float(t[:-2]) * units[t[-2]])
    return int(int(t) / (1024 * 1024))


def tree_memory_mb(spark) -> int:
    """Per-task budget for split statistics (``maxMemoryInMB``): a quarter of a task's share of
    the heap, between 16 and 256 MB. It sets how many nodes are split per pass, not the splits."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local")
    heap = _memory_mb(conf.get("spark.driver.memory" if local else "spark.executor.memory", None), 1024)
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    return max(16, min(256, heap // (4 * max(1, cores))))


def estimator(preset: TreePreset, features: str = "features", label: str = "label", memory_mb: int = 256):
    return RandomForestRegressor(featuresCol=features, labelCol=label, predictionCol="prediction", maxMemoryInMB=memory_mb, **dict(preset.params))


def feature_columns(df: DataFrame, target: str, exclude: list[str] | None = None) -> list[str]:
    """Every numeric column except the target, keys and ``exclude``."""
    drop = set(exclude or []) | {target, SERIES, TS, IDX, "is_test"}
    numeric = ("double", "int", "bigint", "float", "smallint", "tinyint")
    return [f.name for f in df.schema.fields if f.name not in drop and f.dataType.simpleString() in numeric]


def training_frame(df: DataFrame, target: str, exclude: list[str] | None = None, test_size: float = 0.2,
                   fit_on: str = "all") -> tuple[DataFrame, list[str]]:
    """P9 (target present), P10 (< 50 % null features), M1 (time split), P11 (median fill).

    ``fit_on='all'`` takes medians over all rows as the reference does;
    ``'train'`` over training rows only (no look-ahead).
    """
    # Stage boundary: the feature plan is large and iterative fits read their input
    # many times, so the lineage is cut here (reliable checkpoint, shared folder).
    df = cut_lineage(df.select(*[F.col(f"`{c}`").alias(safe_name(c)) for c in df.columns]))
    feats = feature_columns(df, safe_name(target), exclude)
    kept = rows_with_few_nulls(df.where(F.col(safe_name(target)).isNotNull()), feats, 0.5)
    split = cut_lineage(with_split(kept, test_size))  # on disk: no heap pinned per query
    med = column_medians(split.where(~F.col("is_test")) if fit_on == "train" else split, feats)
    # A column without a single value has no median and no information: it leaves the model.
    usable = [c for c in feats if med[c] is not None]
    filled = split.na.fill({c: med[c] for c in usable}) if usable else split
    return filled.withColumn("label", F.col(safe_name(target)).cast("double")), usable


def safe_name(c: str) -> str:
    """Model frames use dot-free names (``kwh_ema_alpha_0_1``); ML stages resolve dotted names as nested fields."""
    return c.replace(".", "_")


def assembler(feats: list[str]) -> VectorAssembler:
    """M20."""
    return VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")


Model = PipelineModel | BoostedTrees


def fit(train: DataFrame, feats: list[str], preset: TreePreset) -> Model:
    if preset.kind == "gbt":
        return fit_many(train, feats, {"model": (preset.boosting(), F.lit(True))})["model"]
    est = estimator(preset, memory_mb=tree_memory_mb(train.sparkSession))
    return Pipeline(stages=[assembler(feats), est]).fit(sized(train.select(*feats, "label")))


#: Forests that are fitted at the same time.
THREADS = 4


def fit_all(rows: DataFrame, feats: list[str], asked: dict[object, tuple[TreePreset, Column]]) -> tuple[dict[object, Model], dict[object, str]]:
    """(models, failures) of name -> (preset, which rows it learns from). All boosted trees share their jobs; forests run
    from threads. What ends one fit leaves the others alone."""
    models, failed, boosted = {}, {}, {}
    for name, (p, where) in asked.items():
        if p.kind == "gbt":
            try:
                b = p.boosting()
                b.check()
                boosted[name] = (b, where)
            except Exception as e:  # noqa: BLE001 - whatever ends one fit, the other models are still evaluated
                failed[name] = str(e)

    def guarded(run: Callable):
        try:
            return run(), None
        except Exception as e:  # noqa: BLE001 - as above
            return None, str(e)

    def forest(name):
        p, where = asked[name]
        return guarded(lambda: fit(rows.where(where), feats, p))

    forests = [n for n, (p, _) in asked.items() if p.kind != "gbt"]
    with ThreadPoolExecutor(THREADS) as pool:
        run = inheritable_thread_target(rows.sparkSession)(forest)
        waiting = {n: pool.submit(run, n) for n in forests}
        if boosted:
            got, error = guarded(lambda: fit_many(rows, feats, {str(k): v for k, v in enumerate(boosted.values())}))
            for k, n in enumerate(boosted):
                if error is None and str(k) in got:
                    models[n] = got[str(k)]
                else:
                    failed[n] = error or "no rows to learn from"
        for n, f in waiting.items():
            m, error = f.result()
            if error is None:
                models[n] = m
            else:
                failed[n] = error
    return {n: models[n] for n in asked if n in models}, failed


def predictions(model: Model, rows: DataFrame, name: str) -> DataFrame:
    """Long predictions ``(series, ts, model, y_true, y_pred)`` keyed by time, not position."""
    return model.transform(rows).select(SERIES, TS, F.lit(name).alias("model"), F.col("label").alias("y_true"),
                                        F.col("prediction").alias("y_pred"))


def train_and_evaluate(df: DataFrame, target: str, presets: list[TreePreset], test_size: float = 0.2,
                       exclude: list[str] | None = None, prepared: tuple | None = None, n_splits: int = 0):
    """M2-M4, M7, M9: fit each preset on the training rows, score the test rows.

    Returns ``(metrics, long_predictions, models, feature_names)``; with ``n_splits`` the presets' folds (M8) are
    fitted in the same jobs, and their metrics follow as a fifth. ``prepared`` is an existing ``training_frame``
    result (materialised once, reused).
    """
    frame, feats = prepared or training_frame(df, target, exclude, test_size)
    train, test = F.col("is_test") == F.lit(False), frame.where("is_test")
    asked = {(p.name, None): (p, train) for p in presets}
    if n_splits:
        frame = with_folds(frame, n_splits)
        asked |= {(p.name, k): (p, train & _learns(k, n_splits)) for p in presets for k in range(n_splits)}
    models, failed = fit_all(frame, feats, asked)
    for (name, k), error in failed.items():
        warnings.warn(f"model {name}{'' if k is None else f' of fold {k}'} could not be fitted: {error}", stacklevel=2)
    longs = [predictions(m, test, name) for (name, k), m in models.items() if k is None]
    empty = test.select(SERIES, TS, F.lit("").alias("model"), F.col("label").alias("y_true"), F.lit(None).cast("double").alias("y_pred")).limit(0)
    long = reduce(DataFrame.unionByName, longs, empty)
    metrics = with_failures(regression_metrics(long, ["model"]), [n for n, k in failed if k is None])
    out = metrics, long, {n: m for (n, k), m in models.items() if k is None}, feats
    return (*out, _fold_metrics(frame.where(train), models, n_splits)) if n_splits else out


def with_folds(rows: DataFrame, n_splits: int) -> DataFrame:
    """Rows with ``_count``, the training rows of their series, which the folds' bounds follow from."""
    counts = rows.where(F.col("is_test") == F.lit(False)).groupBy(SERIES).agg(F.count(F.lit(1)).alias("_count"))
    return cut_lineage(_by_series(rows, counts))


def _fold_end(k: int, n_splits: int) -> Column:
    return F.col("_count") - (n_splits - k) * F.floor(F.col("_count") / (n_splits + 1))


def _learns(k: int, n_splits: int) -> Column:
    return F.col(IDX) < _fold_end(k, n_splits)


def _held(k: int, n_splits: int) -> Column:
    return ~_learns(k, n_splits) & (F.col(IDX) < _fold_end(k, n_splits) + F.floor(F.col("_count") / (n_splits + 1)))


def _fold_metrics(train: DataFrame, models: dict, n_splits: int) -> DataFrame:
    """Metrics of each model on the rows that its fold holds out; a fold that could not be fitted has no row."""
    scored = [predictions(m, train.where(_held(k, n_splits)), name).withColumn("fold", F.lit(k)) for (name, k), m in models.items() if k is not None]
    empty = train.select(SERIES, TS, F.lit("").alias("model"), F.col("label").alias("y_true"), F.lit(None).cast("double").alias("y_pred"), F.lit(0).alias("fold")).limit(0)
    return regression_metrics(reduce(DataFrame.unionByName, scored, empty), ["model", "fold"]).select("model", "fold", "n", "mae", "rmse", "mape", "r2")


def with_failures(metrics: DataFrame, failed: list[str]) -> DataFrame:
    """M7: a model that could not be fitted has a row of null metrics (and no rows scored)."""
    if not failed:
        return metrics
    rows = metrics.sparkSession.createDataFrame([(f,) for f in failed], "model string")
    return metrics.unionByName(rows.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)


def cv_folds(train: DataFrame, n_splits: int = 3) -> DataFrame:
    """M8: training rows with each expanding-window fold they take part in: ``fold`` and ``held`` (true in the fold's
    test part, which is the n / (splits + 1) rows of the series behind the fold's training rows)."""
    counts = train.groupBy(SERIES).agg(F.count(F.lit(1)).alias("_count"))
    size = F.floor(F.col("_count") / (n_splits + 1))
    rows = _by_series(train, counts).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    end = F.col("_count") - (n_splits - F.col("fold")) * size
    return rows.where(F.col(IDX) < end + size).withColumn("held", F.col(IDX) >= end).drop("_count")


def cross_validate(df: DataFrame, target: str, preset: TreePreset, n_splits: int = 3,
                   exclude: list[str] | None = None, prepared: tuple | None = None) -> DataFrame:
    """M8: expanding-window CV on the training rows; a fresh estimator per fold.
    Returns metrics per fold (fold, n, mae, rmse, mape, r2)."""
    frame, feats = prepared or training_frame(df, target, exclude)
    train = with_folds(frame.where(~F.col("is_test")), n_splits)
    models, failed = fit_all(train, feats, {(preset.name, k): (preset, _learns(k, n_splits)) for k in range(n_splits)})
    for (name, k), error in failed.items():
        warnings.warn(f"model {name} of fold {k} could not be fitted: {error}", stacklevel=2)
    return _fold_metrics(train, models, n_splits)


def feature_importance(model: Model, feats: list[str], spark) -> DataFrame:
    """M5: importances of the tree stage as ``(feature, importance)``."""
    imp = (model.importances() if isinstance(model, BoostedTrees) else model.stages[-1].featureImportances.toArray()).tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(feats, imp)], "feature string, importance double")


def top_k(importance: DataFrame, k: int = 20) -> DataFrame:
    """T4 / V3: the k most important features."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(k)


def group_importance(importance: DataFrame) -> DataFrame:
    """F32 joined to M5: feature count and summed importance per feature group.

    The group table is the fixed list of 14 name fragments (broadcast); a name
    may belong to several groups."""
    from tsforge.plans.features import FEATURE_GROUPS
    spark = importance.sparkSession
    groups = spark.createDataFrame([(g, frag) for g, frags in FEATURE_GROUPS for frag in frags], "group string, fragment string")
    member = (importance.join(F.broadcast(groups), F.col("feature").contains(F.col("fragment")))
                        .select("group", "feature", "importance").distinct())
    return member.groupBy("group").agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("importance"))


# ---------------------------------------------------------------- classical forecasters (re-aimed)
def grouped_regression(train: DataFrame, keys: list[str], xs: list[str], y: str, coef: str = "coef") -> DataFrame:
    """Least squares per group: ``(keys..., coef array<double>)``, the intercept last.

    The sums of products of each group come from one aggregate (map-side combined, so a hot group is one row per
    task); only these few numbers are solved in Python. Columns that do not vary, or depend on others, get the
    solution of least norm. Rows with a NULL input do not count.
    """
    cols = [*xs, None]
    value = lambda c: F.lit(1.0) if c is None else F.col(f"`{c}`").cast("double")
    ok = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in [*xs, y]])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = train.where(ok).groupBy(*keys).agg(
        F.array(*[F.sum(value(cols[i]) * value(cols[j])) for i, j in pairs]).alias("_g"),
        F.array(*[F.sum(value(c) * F.col(f"`{y}`")) for c in cols]).alias("_b"))
    names = [f.name for f in sums.schema if f.name not in ("_g", "_b")]

    def solve(batches):
        for b in batches:
            out = []
            for g, r in zip(b.column("_g").to_pylist(), b.column("_b").to_pylist()):
                m = np.zeros((len(cols), len(cols)))
                for (i, j), v in zip(pairs, g):
                    m[i, j] = m[j, i] = v
                scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
                out.append((np.linalg.lstsq(m / np.outer(scale, scale), np.array(r) / scale, rcond=1e-10)[0] / scale).tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, coef])

    kinds = ", ".join(f"`{n}` {sums.schema[n].dataType.simpleString()}" for n in names)
    return sums.mapInArrow(solve, f"{kinds}, {coef} array<double>")


def _linear(xs: list[str], coef: str = "coef"):
    terms = [F.col(coef)[i] * F.col(f"`{c}`") for i, c in enumerate(xs)]
    return reduce(lambda a, b: a + b, terms, F.col(coef)[len(xs)])


def _valued(df: DataFrame, target: str) -> DataFrame:
    """Rows with a value; without the positions they had among all rows."""
    return df.where(F.col(target).isNotNull()).drop(IDX)


def _by_series(df: DataFrame, per_series: DataFrame) -> DataFrame:
    return join_same(df, per_series, [SERIES], "left")


def _seasonal_frame(df: DataFrame, target: str, season: int) -> DataFrame:
    """Rows with the (1, season) difference ``_d`` of the series, the level ``_base`` it is added to, and lags of ``_d``."""
    from tsforge.operators.sequence import apply_windows

    def diff_cols(w):
        lag = lambda k: F.lag(target, k).over(w)
        return [(F.col(target) - lag(1) - lag(season) + lag(season + 1)).alias("_d"), (lag(1) + lag(season) - lag(season + 1)).alias("_base")]

    d = apply_windows(df, diff_cols, season + 1)
    return apply_windows(d, lambda w: [F.lag("_d", k).over(w).alias(f"_d{k}") for k in (1, season, season + 1)], season + 1)


def seasonal_ar(df: DataFrame, target: str, season: int = 24, test_size: float = 0.2) -> DataFrame:
    """M11 (re-aimed): seasonal autoregression on the differenced series, fitted per series.

    d_t = (1 - B)(1 - B^s) y_t is regressed on d_{t-1}, d_{t-s}, d_{t-s-1} over training rows; one-step forecasts on
    test rows are y_{t-1} + y_{t-s} - y_{t-s-1} + d_hat_t. Returns long predictions.
    """
    lagged = _seasonal_frame(with_split(_valued(df, target), test_size), target, season)
    xs = ["_d1", f"_d{season}", f"_d{season + 1}"]
    scored = _by_series(lagged.where("is_test"), grouped_regression(lagged.where("NOT is_test"), [SERIES], xs, "_d"))
    return scored.select(SERIES, TS, F.lit("seasonal_ar").alias("model"), F.col(target).alias("y_true"),
                         (F.col("_base") + _linear(xs)).alias("y_pred"))


def seasonal_ar_forecast(df: DataFrame, target: str, horizon: int = 24, season: int = 24, step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """``horizon`` steps past each series' end; forecasts feed the next steps. A series' state is its last
    2 * season + 2 values, folded step by step in SQL."""
    rows = with_row_index(_valued(df, target))
    lagged = _seasonal_frame(rows, target, season)
    coef = grouped_regression(lagged, [SERIES], ["_d1", f"_d{season}", f"_d{season + 1}"], "_d")
    need = 2 * season + 2
    last = rows.groupBy(SERIES).agg(F.max(IDX).alias("_last"), F.max(TS).alias("_end"))
    state = _by_series(rows, last).where(F.col(IDX) > F.col("_last") - need).groupBy(SERIES, "_end").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(IDX, target))), lambda e: e[target].cast("double")).alias("_y")).where(F.size("_y") == need)

    def step_on(y, _):
        at = lambda k: F.element_at(y, -k)
        d = lambda k: at(k) - at(k + 1) - at(k + season) + at(k + season + 1)
        c = F.col("coef")
        new = at(1) + at(season) - at(season + 1) + c[0] * d(1) + c[1] * d(season) + c[2] * d(season + 1) + c[3]
        return F.concat(y, F.array(new))

    paths = _by_series(state, coef).withColumn("_y", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_y"), step_on))
    return paths.select(SERIES, "_end", F.posexplode(F.slice("_y", -horizon, horizon)).alias("_k", "y_pred")).select(
        SERIES, (F.col("_k") + 1).cast("long").alias("step"), (F.col("_end") + F.expr(step) * (F.col("_k") + 1)).alias(TS),
        F.lit("seasonal_ar").alias("model"), "y_pred")


# Fixed seasonal periods (hours) of the daily / weekly / yearly components.
FOURIER_PERIODS = [24.0, 168.0, 8766.0]


def _fourier_columns(harmonics: int) -> tuple[list, list[str]]:
    """Trend scaled on the training span, and sine and cosine terms; those of a period longer than the span are 0."""
    t = F.unix_seconds(TS) / 3600.0
    span = F.col("_t1") - F.col("_t0")
    cols, names = [F.when(span > 0, (t - F.col("_t0")) / span).otherwise(0.0).alias("_trend")], ["_trend"]
    for p in FOURIER_PERIODS:
        for k in range(1, harmonics + 1):
            for name, f in (("_s", F.sin), ("_c", F.cos)):
                names.append(f"{name}{int(p)}_{k}")
                cols.append(F.when(span >= p, f(2 * math.pi * k * t / p)).otherwise(0.0).alias(names[-1]))
    return cols, names


def _fourier_fit(train: DataFrame, target: str, harmonics: int, multiplicative: bool) -> tuple[DataFrame, list, list[str]]:
    """Per series: training span, whether it is fitted on logarithms (every training value is positive), coefficients."""
    t = F.unix_seconds(TS) / 3600.0
    span = train.groupBy(SERIES).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"), (F.lit(multiplicative) & (F.min(target) > 0)).alias("_log"))
    cols, names = _fourier_columns(harmonics)
    frame = _by_series(train, span).select(SERIES, F.when(F.col("_log"), F.log(F.when(F.col(target) > 0, F.col(target)))).otherwise(F.col(target)).alias("_y"), *cols)
    return _by_series(span, grouped_regression(frame, [SERIES], names, "_y")), cols, names


def fourier_regression(df: DataFrame, target: str, harmonics: int = 3, multiplicative: bool = True,
                       test_size: float = 0.2) -> DataFrame:
    """M12 (re-aimed): trend + sin/cos harmonics of daily, weekly and yearly periods by least squares per series, on
    log y where every training value of the series is positive. Every test row is scored."""
    split = with_split(_valued(df, target), test_size)
    fitted, cols, names = _fourier_fit(split.where("NOT is_test"), target, harmonics, multiplicative)
    scored = _by_series(split.where("is_test"), fitted).select("*", *cols)
    y = _linear(names)
    return scored.select(SERIES, TS, F.lit("fourier").alias("model"), F.col(target).alias("y_true"), F.when(F.col("_log"), F.exp(y)).otherwise(y).alias("y_pred"))


def fourier_forecast(df: DataFrame, target: str, horizon: int = 24, harmonics: int = 3, multiplicative: bool = True,
                     step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """``horizon`` rows past each series' end from a fit on the whole series."""
    rows = df.where(F.col(target).isNotNull())
    fitted, cols, names = _fourier_fit(rows, target, harmonics, multiplicative)
    end = rows.groupBy(SERIES).agg(F.max(TS).alias("_end"))
    ahead = end.select(SERIES, "_end", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")) \
        .select(SERIES, F.col("step").cast("long").alias("step"), (F.col("_end") + F.expr(step) * F.col("step")).alias(TS))
    y = _linear(names)
    return _by_series(ahead, fitted).select("*", *cols).select(SERIES, "step", TS, F.lit("fourier").alias("model"),
                                                                F.when(F.col("_log"), F.exp(y)).otherwise(y).alias("y_pred"))


def score_latest(model: Model, features: DataFrame, feats: list[str], horizon: int = 24,
                 model_name: str = "model") -> DataFrame:
    """M13 + P11 + P15 + T6: per series the latest feature row; a NULL feature takes the column's median over
    ``features`` (0.0 when it has none), a feature that is absent is 0.0; one prediction clamped at 0 and repeated for every step (reference strategy), stamps
    from the last stamp + 1 h."""
    latest = features.groupBy(SERIES).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in features.columns if c != SERIES]), TS).alias("r")) \
        .select(SERIES, "r.*")
    aligned = latest.select(SERIES, TS, *[(F.col(f"`{c}`") if c in latest.columns else F.lit(0.0)).cast("double").alias(c) for c in feats])
    medians = column_medians(features, [c for c in feats if c in features.columns])
    aligned = aligned.na.fill({c: medians.get(c) or 0.0 for c in feats}).withColumn("label", F.lit(None).cast("double"))
    one = model.transform(aligned).select(SERIES, TS, F.greatest(F.lit(0.0), F.col("prediction")).alias("p"))
    return (one.select(SERIES, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), TS, "p")
               .select(SERIES, "step", (F.col(TS) + F.expr("INTERVAL 1 HOUR") * F.col("step")).alias(TS),
                       F.lit(model_name).alias("model"), F.round(F.col("p") * 1000.0) / 1000.0).toDF(
                   SERIES, "step", TS, "model", "predicted_kwh"))


def forecast_requests(model: Model, sc: DataFrame, feats: list[str], target: str = "kwh", model_name: str = "model") -> DataFrame:
    """Requests -> hourly frames -> time, lag and rolling features -> model -> each request's horizon, in one
    job for the whole batch. ``(scenario, step, ts, model, predicted_kwh, error)``; a request that cannot be scored is one
    row with its error."""
    from tsforge.plans.charts import serving_features
    from tsforge.plans.preprocess import add_time_features
    from tsforge.plans.scoring import checked, request_frame
    frame = serving_features(add_time_features(request_frame(sc, target)), target).drop(IDX)
    first = score_latest(model, frame, feats, 1, model_name).select(F.col(SERIES).alias("scenario"), "predicted_kwh")
    asked = join_same(checked(sc).select("scenario", "end_ts", "horizon", "error"), first, ["scenario"], "left")
    steps = F.when(F.col("error").isNull(), F.sequence(F.lit(1), F.col("horizon").cast("int")))
    return asked.select("scenario", F.explode_outer(steps).alias("step"), "end_ts", "predicted_kwh", "error").select(
        "scenario", "step", (F.col("end_ts") + F.expr("INTERVAL 1 HOUR") * F.col("step")).alias(TS), F.lit(model_name).alias("model"),
        F.when(F.col("error").isNull(), F.col("predicted_kwh")).alias("predicted_kwh"), "error")
