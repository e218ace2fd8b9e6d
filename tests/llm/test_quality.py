import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tsforge.llm import boosting, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_base_statistics_equal_brute_force(spark, small):
    rows, df = small
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.score(df, labels).collect()}
    assert got == {i: brute(t) for i, t, *_ in rows}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.score(docs, labels).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_verdicts_on_labels_left_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    odd = F.col("doc_id") % 2 == 1
    got = quality.score(docs, labels.where(odd)).join(labels.where(~odd), "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.95
    assert got[got.quality == 1].kept.mean() > 0.97


def test_empty_table_and_clashing_names(spark, nothing, small):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, 0), (10, 1, 0), (17, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(nothing, labels).count() == 0
    _, df = small
    assert quality.score(df.withColumn("quality", F.lit(1)).withColumn("kept", F.lit("x")), labels).count() == df.count()


def test_trees_keep_their_direction_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.random(3000) > 0.8).astype(float)
    trees = boosting.fit(x, y, [1, 1, -1])
    assert ((trees.probability(x) > 0.5) == (y > 0.5)).mean() > 0.95
    for j, sign in enumerate([1, 1, -1]):
        at = np.repeat(rng.random((50, 3)), 20, 0)
        at[:, j] = np.tile(np.linspace(0, 1, 20), 50)
        steps = np.diff(trees.raw(at).reshape(50, 20), axis=1)
        assert (sign * steps >= -1e-12).all()


def test_isotonic_is_rising_and_right_on_average():
    rng = np.random.default_rng(0)
    s = rng.random(2000)
    y = rng.random(2000) < s ** 2
    at, p = boosting.isotonic(s, y)
    assert (np.diff(p) >= 0).all()
    assert abs(np.interp(s, at, p).mean() - y.mean()) < 1e-9
