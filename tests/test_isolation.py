"""Isolation forest flags injected extremes and about the contamination share of rows."""

import datetime as dt
import random

from tsforge.operators.outliers import flag_outliers, outlier_stats


def test_isolation_forest_flags_extremes(spark):
    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", t0 + dt.timedelta(hours=i), rnd.gauss(50, 5)) for i in range(600)]
    extremes = {100, 250, 400}
    rows = [(s, t, 500.0 if i in extremes else v) for i, (s, t, v) in enumerate(rows)] + [("s", t0 + dt.timedelta(hours=600), None)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    flagged = flag_outliers(df, "value", "isolation_forest")
    got = {r["ts"] for r in flagged.where("is_outlier").collect()}
    assert {t0 + dt.timedelta(hours=i) for i in extremes} <= got
    st = outlier_stats(flagged, "isolation_forest").first()
    assert 8.0 <= st["outlier_percentage"] <= 11.0          # contamination 0.1 of the non-null rows
    assert flagged.count() == 601                            # the NULL row is kept, not flagged


def test_scores_equal_the_trees(spark):
    """The step function against walking every tree; values on a split, NULL and repeated rows, a series without a name."""
    import numpy as np
    import pandas as pd

    from tsforge.operators import isolation as I
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(hours=i), round(rnd.gauss(m, 3), 1)) for s, m, n in (("a", 10, 900), (None, -50, 300), ("one", 1, 1), ("same", 2, 40)) for i in range(n)]
    rows = [(s, t, 2.0 if s == "same" else v) for s, t, v in rows] + [("a", t0, None), ("a", t0, 10.0), ("a", t0, 10.0)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double").repartition(3)
    steps = I.isolation_forest(df, "value", trees=20, sample=64).toPandas()
    got = I.isolation_scores(df, "value", trees=20, sample=64).toPandas()
    assert len(got) == len(rows) - 1 and got.anomaly_score.notna().all()
    for s, part in got.groupby("series", dropna=False):
        own = steps[steps.series.isna() if s != s or s is None else steps.series == s].sort_values("at")
        want = own.score.to_numpy()[np.searchsorted(own["at"].to_numpy(), part.value.to_numpy(), "right") - 1]
        assert np.abs(part.anomaly_score.to_numpy() - want).max() < 1e-12
    # the steps against the trees they come from
    values = pd.DataFrame({"tree_id": 0, "x": [rnd.gauss(0, 1) for _ in range(60)]})
    trees = []
    for k in range(5):
        tree = I._grow(values.assign(tree_id=k), 3, 6)
        trees.append(tree.assign(drawn=60))
    step = I._steps(pd.concat(trees))
    x = np.concatenate([np.linspace(-4, 4, 400), step["at"].to_numpy()[1:]])
    paths = sum(I._path_lengths(x, t) / I._c(60) for t in trees) / 5
    assert np.abs(step.score.to_numpy()[np.searchsorted(step["at"].to_numpy(), x, "right") - 1] - 2.0 ** -paths).max() < 1e-12
