"""Feature composition (F33) and the feature catalogue (F32).

One pass: series length (grouped count, one row per series), the padded target
(bounded carry fill), then all lag/rolling/EMA/statistical columns on ONE window
spec (one exchange + sort), then plain projections for calendar, weather and
interaction columns. Column order follows the reference's eight steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.operators.joins import join_same
from tsforge.functions import windows as W
from tsforge.functions.calendar import calendar_feature_columns
from tsforge.functions.holidays import add_holiday_features
from tsforge.functions.weather import interaction_feature_columns, weather_feature_columns
from tsforge.operators.sequence import DEFAULT_CHUNK_ROWS, IDX, apply_windows, carry_forward, neighbours, with_row_index


@dataclass(frozen=True)
class FeatureConfig:
    target: str = "kwh"
    lags: list = field(default_factory=lambda: list(W.DEFAULT_LAGS))
    windows: list = field(default_factory=lambda: list(W.DEFAULT_WINDOWS))
    stats: list = field(default_factory=lambda: list(W.DEFAULT_STATS))
    alphas: list = field(default_factory=lambda: list(W.DEFAULT_ALPHAS))
    statistical: bool = True
    calendar: bool = True
    weather: bool = True
    interactions: bool = True
    strict_holiday_period: bool = False
    shift: int = 0  # 1: rolling, EMA and statistical features end that many rows earlier and leave out the current target
    chunk_rows: int | None = DEFAULT_CHUNK_ROWS


def series_length(df: DataFrame, out: str = "_n") -> DataFrame:
    """Attach each series' row count (grouped count joined back; no unbounded window)."""
    return join_same(df, df.groupBy(SERIES).agg(F.count(F.lit(1)).alias(out)), [SERIES], "left")


def window_features(df: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """W1-W12 for ``cfg.target`` on a series frame."""
    if cfg.shift:
        return _shifted(df, cfg)
    t = cfg.target
    base = df if cfg.chunk_rows is None or IDX in df.columns else with_row_index(df)
    pad = None
    if cfg.statistical:
        base = series_length(base)
        nb = neighbours(base, [t], cfg.chunk_rows)
        base = nb.select(*base.columns, *([IDX] if IDX not in base.columns else []),
                         F.col("_prev_" + t)["v"].alias("_pad"))
        pad = "_pad"

    held = [f"_ema{i}" for i in range(len(cfg.alphas))]

    def build(w):
        cols = W.lag_columns(t, cfg.lags, w)
        cols += W.rolling_columns(t, cfg.windows, cfg.stats, w)
        if cfg.chunk_rows is None:
            cols += W.ema_columns(t, cfg.alphas, w, held)
        if cfg.statistical:
            cols += W.statistical_columns(t, w, F.col("_n"), pad)
        return cols

    halo = W.halo_for(cfg.lags, cfg.windows, cfg.alphas if cfg.chunk_rows is None else (), cfg.statistical)
    out = apply_windows(base, build, halo, cfg.chunk_rows)
    if held:
        out = out if cfg.chunk_rows is None else W.ema_by_blocks(out, t, cfg.alphas, held)
        out = carry_forward(out, held, [f"{t}_ema_alpha_{a}" for a in cfg.alphas], cfg.chunk_rows)
    return out.drop("_n", "_pad", IDX)


def _shifted(df: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Window features that end ``cfg.shift`` rows earlier (lags already do): computed on the shifted target."""
    t, base = cfg.target, df if cfg.chunk_rows is None or IDX in df.columns else with_row_index(df)
    lags = apply_windows(base, lambda w: [F.col(t).alias("_now"), F.lag(t, cfg.shift).over(w).alias("_past")] + W.lag_columns(t, cfg.lags, w),
                         W.halo_for([*cfg.lags, cfg.shift]), cfg.chunk_rows, keep_index=True)
    out = window_features(lags.withColumn(t, F.col("_past")), replace(cfg, shift=0, lags=[]))
    return out.withColumn(t, F.col("_now")).drop("_now", "_past")


def engineer_features(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), holidays: DataFrame | None = None) -> DataFrame:
    """all features in the reference's order (lag, rolling, EMA, calendar,
    holiday, weather, interaction, statistical)."""
    t = cfg.target
    wf = window_features(df, cfg)
    cols = list(df.columns)
    lag_names = [f"{t}_lag_{n}h" for n in cfg.lags]
    roll_names = [f"{t}_rolling_{n}h_{s}" for n in cfg.windows for s in cfg.stats]
    ema_names = [f"{t}_ema_alpha_{a}" for a in cfg.alphas]
    stat_names = ([f"{t}_vs_same_hour_last_week"] + [f"{t}_pct_change_{p}h" for p in W.STAT_PERIODS]
                  + [f"{t}_zscore_{W.WEEK}h"]) if cfg.statistical else []
    cal = calendar_feature_columns(TS) if cfg.calendar else []
    out = wf.select(*_q(cols + lag_names + roll_names + ema_names), *cal, *_q(stat_names))
    if holidays is not None:
        out = add_holiday_features(out, holidays, cfg.strict_holiday_period)
    wx = weather_feature_columns(out.columns) if cfg.weather else []
    ix = interaction_feature_columns(out.columns) if cfg.interactions else []
    hol = ["is_holiday", "days_to_holiday", "days_from_holiday", "is_holiday_period"] if holidays is not None else []
    cal_names = [c for c in out.columns if c not in cols + lag_names + roll_names + ema_names + stat_names + hol]
    return out.select(*_q(cols + lag_names + roll_names + ema_names + cal_names + hol), *wx, *ix, *_q(stat_names))


def _q(names: list[str]) -> list:
    """Column references that keep dotted names (``kwh_ema_alpha_0.1``) whole."""
    return [F.col(f"`{n}`") for n in names]


# Fixed name fragments of the seven feature groups (a name may sit in several groups).
FEATURE_GROUPS = [
    ("lag_features", ["lag_"]),
    ("rolling_features", ["rolling_"]),
    ("ema_features", ["ema_"]),
    ("calendar_features", ["is_", "week_", "days_"]),
    ("weather_features", ["temp_", "heating_", "cooling_", "weather_", "solar_", "comfort_", "apparent_"]),
    ("interaction_features", ["interaction"]),
    ("statistical_features", ["pct_change", "zscore", "vs_same"]),
]


def feature_catalogue(spark, feature_names: list[str]) -> DataFrame:
    """F32: ``(feature, group)`` rows, one per membership, from a list of feature names."""
    names = spark.createDataFrame([(n, i) for i, n in enumerate(feature_names)], "feature string, position int")
    groups = spark.createDataFrame([(g, frag) for g, frags in FEATURE_GROUPS for frag in frags], "group string, fragment string")
    return (names.join(F.broadcast(groups), F.col("feature").contains(F.col("fragment")))
            .select("feature", "position", "group").distinct())


def feature_names_of(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), base_columns: list[str] | None = None) -> list[str]:
    """The ledger: engineered names (columns not in the input)."""
    base = set(base_columns or [])
    return [c for c in df.columns if c not in base and c not in (SERIES, TS, cfg.target)]
