"""Boosted trees: split choices against a brute-force tree, levels on the cluster against whole subtrees in a task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsforge.plans import boosting as B
from tsforge.plans import models as M
from tsforge.plans import registry


def table(n=400, width=5, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    x[:, -1] = x[:, 0]  # a copy of a feature: ties go to the first
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 5, -2) * x[:, 2] + 0.1 * rng.normal(size=n)
    df = pd.DataFrame(x, columns=[f"x{k}" for k in range(width)])
    return df.assign(label=y, series="s", ts=pd.date_range("2024-01-01", periods=n, freq="h"), part=np.arange(n) % 4)


def brute(x, y, depth, l2, least):
    """Every threshold of every feature at every node; (feature, threshold) by node, and leaf values."""
    split, value = {}, {}

    def node(k, rows, level):
        value[k] = y[rows].sum() / (len(rows) + l2)
        best = (0.0, None, None)
        if level < depth:
            for f in range(x.shape[1]):
                for t in np.unique(x[rows, f])[:-1]:
                    left = rows[x[rows, f] <= t]
                    right = rows[x[rows, f] > t]
                    if min(len(left), len(right)) < least:
                        continue
                    gain = y[left].sum() ** 2 / (len(left) + l2) + y[right].sum() ** 2 / (len(right) + l2) - y[rows].sum() ** 2 / (len(rows) + l2)
                    if gain > best[0] * (1 + 1e-9) + 1e-9:
                        best = (gain, f, t)
        if best[1] is not None:
            split[k] = best[1:]
            node(2 * k, rows[x[rows, best[1]] <= best[2]], level + 1)
            node(2 * k + 1, rows[x[rows, best[1]] > best[2]], level + 1)

    node(1, np.arange(len(y)), 0)
    return split, value


def same_trees(a, b):
    assert len(a.trees) == len(b.trees)
    for s, t in zip(a.trees, b.trees, strict=True):
        assert (s["feature"] == t["feature"]).all() and (s["rows"] == t["rows"]).all()
        assert (s["bin"][s["feature"] >= 0] == t["bin"][t["feature"] >= 0]).all()
        assert np.array_equal(s["value"], t["value"])


@pytest.mark.parametrize("least", [1, 20])
def test_first_tree_equals_brute_force(spark, least):
    pdf = table(250)  # fewer rows than bins: every value is a threshold
    feats = [f"x{k}" for k in range(5)]
    p = B.Boosting(trees=1, depth=4, rate=1.0, l2=1.0, least_rows=least)
    m = B.fit_many(spark.createDataFrame(pdf).repartition(3), feats, {"m": (p, F.lit(True))})["m"]
    x, y = pdf[feats].to_numpy(), pdf.label.to_numpy() - pdf.label.mean()
    split, value = brute(x, y, 4, 1.0, least)
    t = m.trees[0]
    inner = {i: (int(t["feature"][i]), t["bin"][i]) for i in np.flatnonzero(t["feature"] >= 0).tolist()}
    assert set(inner) == set(split)
    for k, (f, b) in inner.items():
        assert f == split[k][0] and m.edges[f][b] == pytest.approx(split[k][1])
    leaves = [i for i in np.flatnonzero(t["rows"] > 0).tolist() if i not in inner]
    assert {i: t["value"][i] for i in leaves} == pytest.approx({i: value[i] for i in leaves}, rel=1e-5, abs=1e-6)


def test_splits_from_rows_equal_splits_from_histograms():
    rng = np.random.default_rng(5)
    for n, k, least in ((3, 1, 1), (60, 9, 1), (400, 30, 3), (900, 4, 20)):
        x, q, slot = rng.integers(0, 9, (n, 6)).astype(np.uint8), rng.integers(-50, 50, n).astype(float), np.append(np.arange(k), rng.integers(0, k, n - k))
        x[:, 3] = x[:, 1]
        a = B.best_splits(*B.histograms(x, q, slot, k), 1.0, least)[:3]
        b = B.best_splits_of_rows(x, q, slot, k, 1.0, least)
        assert (a[0] == b[0]).all() and (a[2] == b[2]).all() and (a[1][a[0] >= 0] == b[1][a[0] >= 0]).all()
        assert (a[0] >= 0).any()


def test_levels_on_the_cluster_give_the_same_trees(spark, monkeypatch):
    """Small blocks and no node small enough for one task, other partitions, and a refresh of the margins in between."""
    df = spark.createDataFrame(table())
    feats = [f"x{k}" for k in range(5)]
    fits = {"a": (B.Boosting(trees=5, depth=5, rows=0.8, columns=0.8), F.col("part") < 3),
            "b": (B.Boosting(trees=3, depth=3, l2=0.0, least_rows=20), F.lit(True)), "none": (B.Boosting(), F.col("part") > 9)}
    whole = B.fit_many(df.repartition(2), feats, fits)
    monkeypatch.setattr(B, "BLOCK", 64)
    monkeypatch.setattr(B, "REFRESH", 2)
    level = B.fit_many(df.repartition(5), feats, fits, local_rows=0)
    mixed = B.fit_many(df, feats, fits, local_rows=100)
    assert set(whole) == {"a", "b"}
    for name in whole:
        same_trees(whole[name], level[name])
        same_trees(whole[name], mixed[name])


def test_boosting_learns_and_is_read_back(spark, tmp_path):
    pdf = table(6000)
    df = spark.createDataFrame(pdf)
    feats = [f"x{k}" for k in range(5)]
    m = M.fit(df.where("part < 3"), feats, M.TreePreset("g", "gbt", (("maxIter", 60), ("maxDepth", 5), ("stepSize", 0.2), ("seed", 1))))
    test = m.transform(df.where("part = 3"))
    r2 = test.agg(1 - F.sum((F.col("label") - F.col("prediction")) ** 2) / (F.var_pop("label") * F.count("label"))).first()[0]
    assert r2 > 0.95
    want = pdf.label[pdf.part == 3].to_numpy()
    assert 1 - ((want - m.predict(pdf[pdf.part == 3])) ** 2).sum() / ((want - want.mean()) ** 2).sum() == pytest.approx(r2)
    imp = M.feature_importance(m, feats, spark).toPandas().set_index("feature").importance
    assert imp.sum() == pytest.approx(1) and imp.x0 > 0.3 and imp.x3 < 0.05
    path = f"file://{tmp_path}/m"
    m.write().overwrite().save(path)
    again = registry.load_model(path)
    same_trees(m, again)
    assert np.array_equal(again.predict(pdf), m.predict(pdf))
    assert m.table(spark).where("feature IS NOT NULL").count() == sum(int((t["feature"] >= 0).sum()) for t in m.trees)


def test_bad_parameters_and_no_rows(spark):
    df = spark.createDataFrame(table(20))
    with pytest.raises(ValueError, match="out of range"):
        B.fit_many(df, ["x0"], {"m": (B.Boosting(trees=0), F.lit(True))})
    assert B.fit_many(df.where("part > 9"), ["x0"], {"m": (B.Boosting(), F.lit(True))}) == {}
    one = B.fit_many(df.withColumn("label", F.lit(4.0)), ["x0", "x1"], {"m": (B.Boosting(trees=2), F.lit(True))})["m"]
    assert one.predict(table(20)).tolist() == pytest.approx([4.0] * 20)
