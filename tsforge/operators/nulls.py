"""Null handling: counts, fills, interpolation, drops and thresholds.

Interpolation and fills look arbitrarily far back/forward; they run through
:func:`tsforge.operators.sequence.neighbours` so a long series is processed in
bounded chunks plus a tiny chunk-level carry table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.operators.quantiles import exact_quantiles
from tsforge.operators.sequence import DEFAULT_CHUNK_ROWS, IDX, neighbours

MISSING_METHODS = ("interpolate", "forward_fill", "backward_fill", "drop")


def value_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    return cols or [c for c in df.columns if c not in (SERIES, TS, IDX)]


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row with ``<col>_nulls`` per column and ``total_nulls``."""
    cols = value_columns(df, cols)
    per = [F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls") for c in cols]
    total = reduce(lambda a, b: a + b, [F.sum(F.col(c).isNull().cast("long")) for c in cols])
    return df.agg(*per, total.alias("total_nulls"))


def _fill(df: DataFrame, cols: list[str], kind: str, chunk_rows: int | None, keep_index: bool = False) -> DataFrame:
    """One neighbour pass, then the value rule of ``kind`` and the edge fill.

    interpolate: inner nulls linear by position, trailing -> previous value;
    the edge fill then gives leading nulls the next value. ffill: previous,
    else next. bfill: next, else previous. edge: same as ffill.
    """
    nb = neighbours(df, cols, chunk_rows)
    outs = []
    for c in df.columns:
        if c not in cols:
            outs.append(F.col(c))
            continue
        p, n = F.col("_prev_" + c), F.col("_next_" + c)
        if kind == "interpolate":
            between = p["v"] + (n["v"] - p["v"]) * (F.col(IDX) - p["p"]) / (n["p"] - p["p"])
            val = (F.when(F.col(c).isNotNull(), F.col(c))
                    .when(p.isNotNull() & n.isNotNull(), between)
                    .when(p.isNotNull(), p["v"])
                    .otherwise(n["v"]))
        elif kind == "bfill":
            val = F.coalesce(n["v"], p["v"])
        else:
            val = F.coalesce(p["v"], n["v"])
        outs.append(val.alias(c))
    if keep_index and IDX not in df.columns:
        outs.append(F.col(IDX))  # positions are unchanged by a fill: later windows reuse them
    return nb.select(*outs)


def forward_fill(df: DataFrame, cols: list[str] | None = None, chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """P3 (+ P6): last non-null value at or before each row; leading nulls take the first value."""
    return _fill(df, value_columns(df, cols), "ffill", chunk_rows)


def backward_fill(df: DataFrame, cols: list[str] | None = None, chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """P4 (+ P6): first non-null value at or after each row; trailing nulls take the last value."""
    return _fill(df, value_columns(df, cols), "bfill", chunk_rows)


def interpolate_only(df: DataFrame, cols: list[str] | None = None,
                     chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """P2 alone: leading nulls stay NULL."""
    cols = value_columns(df, cols)
    nb = neighbours(df, cols, chunk_rows)
    outs = []
    for c in df.columns:
        if c not in cols:
            outs.append(F.col(c))
            continue
        p, n = F.col("_prev_" + c), F.col("_next_" + c)
        between = p["v"] + (n["v"] - p["v"]) * (F.col(IDX) - p["p"]) / (n["p"] - p["p"])
        outs.append(F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNotNull() & n.isNotNull(), between)
                     .when(p.isNotNull(), p["v"]).alias(c))
    return nb.select(*outs)


def drop_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P5: drop rows with any null among ``cols``."""
    return df.na.drop("any", subset=value_columns(df, cols))


def handle_missing(df: DataFrame, method: str = "interpolate", cols: list[str] | None = None,
                   chunk_rows: int | None = DEFAULT_CHUNK_ROWS, keep_index: bool = False) -> DataFrame:
    """The reference's missing-value step: ``method`` then the edge fill (P6), in one neighbour pass."""
    if method not in MISSING_METHODS:
        raise ValueError(f"unknown missing-value method {method!r}")
    cols = value_columns(df, cols)
    if method == "drop":
        return drop_missing(df, cols).drop(IDX)  # nothing is left for the edge fill; positions change
    kind = {"interpolate": "interpolate", "forward_fill": "ffill", "backward_fill": "bfill"}[method]
    return _fill(df, cols, kind, chunk_rows, keep_index)


def rows_with_few_nulls(df: DataFrame, feature_cols: list[str], max_fraction: float = 0.5) -> DataFrame:
    """P10: keep rows whose null count among features is strictly below ``max_fraction * n``."""
    n_null = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in feature_cols])
    return df.where(n_null < F.lit(max_fraction * len(feature_cols)))


def column_medians(src: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians of ``cols`` by distributed selection (one number per column reaches the driver)."""
    found = {r["column"]: r["q"][0] for r in exact_quantiles(src, cols, [0.5], []).collect()}
    return {c: found.get(c) for c in cols}


def median_fill(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill each column with its exact (interpolated) median from ``fit_on`` (default: ``df``).

    The medians (one number per column) are fetched and applied with ``na.fill``, as a fitted imputer would.
    """
    med = column_medians(fit_on if fit_on is not None else df, cols)
    fills = {c: v for c, v in med.items() if v is not None}
    return df.na.fill(fills) if fills else df


def zero_fill(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P12."""
    return df.na.fill(0, subset=value_columns(df, cols))


def with_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Missing column -> constant column; NULL -> default."""
    out = df
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(float(v))) if c in out.columns else F.lit(float(v)))
    return out
