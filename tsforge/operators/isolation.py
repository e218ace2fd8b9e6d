"""Isolation forest on one measure, per series (O3; Liu, Ting and Zhou, ICDM 2008).

* Samples: rows draw by hashes; about twice the sample size of a series' rows join a tree, and the 256 smallest
  hashes per (series, tree) are kept (groups of a few hundred rows, never a whole series).
* Trees: grown per ``(series, tree_id)`` in ``applyInPandas`` (random split between the node's min and max,
  height limit ceil(log2 256)).
* Scores: ``2^(-E[h(x)] / c(sample))``. With one measure the mean path length is a step function of it: the splits of a
  series' trees become one sorted table of steps, and a row's score is that of the last step before its value, found
  by sorting rows and steps together over the cluster. Rows above the series' exact ``1 - contamination`` quantile
  of the scores are outliers.
Seeded and exact for the algorithm, but not bit-equal to other implementations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge import SERIES, TS

EULER = 0.5772156649015329
NODE_SCHEMA = "tree_id long, node long, split double, left long, right long, size long"


def _c(n: float) -> float:
    """Average path length of an unsuccessful search in a BST of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(pdf: pd.DataFrame, seed: int, max_depth: int) -> pd.DataFrame:
    tid = int(pdf["tree_id"].iloc[0])
    rng = np.random.default_rng(seed + tid)
    x = pdf["x"].to_numpy(dtype=float)
    nodes = []  # node, split, left, right, size

    def build(vals: np.ndarray, depth: int) -> int:
        nid = len(nodes)
        nodes.append([nid, np.nan, -1, -1, len(vals)])
        if depth >= max_depth or len(vals) <= 1 or vals.min() == vals.max():
            return nid
        s = rng.uniform(vals.min(), vals.max())
        nodes[nid][1] = s
        nodes[nid][2] = build(vals[vals < s], depth + 1)
        nodes[nid][3] = build(vals[vals >= s], depth + 1)
        return nid

    build(x, 0)
    out = pd.DataFrame(nodes, columns=["node", "split", "left", "right", "size"])
    out.insert(0, "tree_id", tid)
    return out


def _path_lengths(x: np.ndarray, tree: pd.DataFrame) -> np.ndarray:
    split, left, right = (tree[c].to_numpy() for c in ("split", "left", "right"))
    rest = np.array([_c(n) for n in tree["size"].tolist()])  # what a leaf's rows would still need, once per node
    node = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x))
    active = left[node] >= 0
    while active.any():
        node = np.where(active, np.where(x < split[node], left[node], right[node]), node)
        depth = depth + active
        active = left[node] >= 0
    return depth + rest[node]


def _steps(nodes: pd.DataFrame) -> pd.DataFrame:
    """A series' forest as a step function of its measure: from each ``at`` on (the first from -inf), the mean path length.
    A tree of m rows measures paths against the mean path of m rows."""
    grown = [g for _, g in nodes.sort_values(["tree_id", "node"]).groupby("tree_id")]
    at = np.unique(np.append(-np.inf, nodes["split"].dropna().to_numpy()))
    paths = sum(_path_lengths(at, g) / max(_c(int(g["drawn"].iloc[0])), 1e-12) if g["drawn"].iloc[0] > 1 else np.ones(len(at)) for g in grown)
    return pd.DataFrame({"at": at, "score": np.power(2.0, -paths / len(grown))})


def isolation_forest(df: DataFrame, col: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(series, at, score): each series' forest as a step function - a value has the score of the last ``at`` that is not above
    it. With one measure a tree cuts the line into stretches, so a forest does: at most ``trees * (sample - 1)`` steps a series."""
    data = df.where(F.col(col).isNotNull())
    sizes = data.groupBy(F.col(SERIES).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    # A row's draws depend on all of its columns, so repeated stamps draw apart.
    row = F.xxhash64(*[F.col(f"`{c}`") for c in data.columns if data.schema[c].dataType.typeName() not in ("map", "variant")])
    tagged = data.join(sizes, F.col(SERIES).eqNullSafe(F.col("_s"))).drop("_s").withColumn("_row", row)
    # About 2 * sample rows of a series join a tree, however long the series is: of a long one few rows take part at all
    # (one draw for each row), and only those draw for each tree.
    wanted = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("_n"))
    any_tree = F.least(F.lit(1.0), F.lit(float(trees)) * wanted)
    uniform = lambda *x: F.shiftrightunsigned(F.xxhash64(*x), 1) / F.lit(2.0 ** 63)
    part = tagged.where(uniform(F.col("_row"), F.lit(seed), F.lit("row")) <= any_tree)
    picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: uniform(F.col("_row"), t, F.lit(seed)) <= wanted / any_tree)
    draws = part.select(F.col(SERIES), F.col(col).cast("double").alias("x"), F.explode(picks).alias("tree_id"), "_row")
    order = Window.partitionBy(SERIES, "tree_id").orderBy(F.xxhash64("_row", "tree_id", F.lit(seed + 1)), "_row", "x")
    keep = draws.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).select(SERIES, F.col("tree_id").cast("long"), "x")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _grow(pdf, seed, math.ceil(math.log2(max(2, len(pdf)))))
        out.insert(0, SERIES, pdf[SERIES].iloc[0])
        out["drawn"] = len(pdf)
        return out

    def steps(nodes: pd.DataFrame) -> pd.DataFrame:
        out = _steps(nodes)
        out.insert(0, SERIES, nodes[SERIES].iloc[0])
        return out

    return keep.groupBy(SERIES, "tree_id").applyInPandas(grow, f"{SERIES} string, {NODE_SCHEMA}, drawn long") \
        .groupBy(SERIES).applyInPandas(steps, f"{SERIES} string, at double, score double")


def isolation_scores(df: DataFrame, col: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Adds ``anomaly_score`` in (0, 1] for every row with a non-null ``col``; each series has its own forest.

    Rows and steps are sorted together by value over the cluster, and each row takes the score of the last step before
    it (the carry of the fills), so no task holds a series."""
    from tsforge.operators.sequence import neighbours, with_row_index
    data = df.where(F.col(col).isNotNull())
    steps = isolation_forest(df, col, trees, sample, seed)
    x, held = F.col(f"`{col}`").cast("double"), [f"_c{k}" for k in range(len(data.columns))]
    rows = data.select(F.col(SERIES).alias(SERIES), x.alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_score"),
                       F.struct(*[F.col(f"`{c}`").alias(h) for c, h in zip(data.columns, held)]).alias("_row"))
    marks = steps.select(SERIES, F.col("at").alias("_x"), F.lit(0).alias("_kind"), F.col("score").alias("_score"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    sorted_rows = with_row_index(rows.unionByName(marks), order="_x")  # ties by kind: a step begins at its value
    scored = neighbours(sorted_rows, ["_score"]).where("_kind = 1")
    return scored.select(*[F.col("_row")[h].alias(c) for c, h in zip(data.columns, held)], F.col("_prev__score")["v"].alias("anomaly_score"))


def isolation_forest_flags(df: DataFrame, col: str, flag: str = "is_outlier", contamination: float = 0.1,
                           trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Flag rows whose score exceeds their series' ``1 - contamination`` quantile (NULL measure -> false)."""
    from tsforge.operators.quantiles import exact_quantiles
    from tsforge.session import cut_lineage
    df = cut_lineage(df)  # read for the draws, the scores and the NULL rows
    scored = cut_lineage(isolation_scores(df, col, trees, sample, seed))  # scored once, read twice
    cut = exact_quantiles(scored, ["anomaly_score"], [1.0 - contamination], [SERIES]).select(F.col(SERIES).alias("_s"), F.col("q")[0].alias("_cut"))
    rest = df.where(F.col(col).isNull()).withColumn("anomaly_score", F.lit(None).cast("double"))
    out = scored.join(cut, F.col(SERIES).eqNullSafe(F.col("_s")), "left").withColumn(flag, F.col("anomaly_score") > F.col("_cut")).drop("_s", "_cut")
    return out.unionByName(rest.withColumn(flag, F.lit(False)))
