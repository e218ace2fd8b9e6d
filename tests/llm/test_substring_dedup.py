import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tsforge.llm import sketch, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p:p + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("window", "gram"), [(50, 8), (9, 3), (3, 3)])
def test_equals_brute_force(small, window, gram):
    rows, df = small
    got = substring_dedup.dedup(df, window=window, gram=gram).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == brute(rows, window)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = substring_dedup.dedup(df).withColumn("sha", F.sha2("kept", 256)).collect()
    want = brute([(r.doc_id, r.text) for r in df.collect()], 50)
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == want
    assert any(n for _, n, _ in want.values())


def test_empty_table_and_clashing_names(nothing, small):
    assert substring_dedup.dedup(nothing).count() == 0
    _, df = small
    odd = df.withColumn("runs", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("bucket", F.lit(None).cast("int"))
    assert substring_dedup.dedup(odd).count() == df.count()


def test_sketch_loses_no_repeat(spark):
    import numpy as np

    n = 30_000
    df = spark.range(n, numPartitions=7)
    keys = lambda b: iter([b.column("id").to_numpy().astype(np.uint64) % np.uint64(n // 2 + 1000)])
    twice = sketch.build(df, keys, sketch.log2_cells(n))
    seen = np.arange(n // 2 + 1000, dtype=np.uint64)
    hit = twice.may_repeat(seen)
    assert hit[: n - (n // 2 + 1000)].all()  # these occur twice
    assert hit[n - (n // 2 + 1000):].mean() < 0.1


def test_windows_around_one_common_phrase_are_spread(spark, monkeypatch):
    phrase = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(40)) + f" {phrase} " + " ".join(f"b{i}x{k}" for k in range(40))) for i in range(200)]
    rows += [(1000, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(substring_dedup, "BUCKET", 100)
    sent, buckets = substring_dedup.dealt_windows(df)
    n = [r.n for r in sent.where("bucket >= 0").groupBy("bucket").agg((F.sum(F.length("pos")) / 4).alias("n")).collect()]
    assert buckets > 50 and sum(n) > 3000 and max(n) < sum(n) / 10
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(df).collect()}
    assert got == {i: 0 for i in range(200)} | {1000: 110}
