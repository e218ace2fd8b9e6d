import zlib

import numpy as np
from pyspark.sql import functions as F

from tsforge.llm import toxicity


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id)
    y, p = held.toxic == 1, held.predicted == 1
    print("recall", p[y].mean(), "false", p[~y].mean(), "calibration", held.score.mean(), y.mean())
    assert p[y].mean() > 0.93
    assert p[~y].mean() < 0.03
    assert abs(held.score.mean() - y.mean()) < 0.03


def test_spellings():
    assert toxicity.plain("Id1ot!!") == ("idiot", True)
    assert toxicity.plain("s.c.u.m,") == ("scum", True)
    assert toxicity.plain("Été") == ("été", False)
    assert toxicity.plain("!!") == ("", False)
    assert toxicity.plain("12.5")[1] is False


def test_odd_rows(spark, nothing, small):
    labels = spark.createDataFrame([(3, 1, 1), (None, 1, 1), (10, 1, 0), (17, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(nothing, labels).count() == 0
    rows, df = small
    got = toxicity.score(df.withColumn("toxic", F.lit(9)).withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and np.isfinite(r.score) for r in got)
    assert toxicity.score(df, labels.limit(0)).agg(F.max("score")).first()[0] == 0
