"""Time-keyed joins (J1, J2, J4, J5, J7). Spark/AQE choose the physical join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge import SERIES, TS


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL is a key like any other (a series without a name is a series); the keys come out once."""
    side = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_same_{k}`")) for k in keys])
    return left.join(side, on, how).drop(*[f"_same_{k}" for k in keys])


def _keys(left: DataFrame, right: DataFrame) -> list[str]:
    return [SERIES, TS] if SERIES in left.columns and SERIES in right.columns else [TS]


def merge_on_time(load: DataFrame, weather: DataFrame, how: str = "inner") -> DataFrame:
    """J1 (inner) / J2 (left): join on ``(series, ts)``, or on ``ts`` when the right side is global."""
    return load.join(weather, _keys(load, weather), how)


def missing_stamps(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected stamps not present (anti-join)."""
    return expected.join(present.select(*_keys(expected, present)).distinct(), _keys(expected, present), "left_anti")


def align_predictions(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """Predictions joined to their actuals by key, never by position."""
    return truth.join(preds, _keys(truth, preds), "inner")
