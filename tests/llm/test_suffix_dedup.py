import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsforge.llm import suffix_dedup


def brute(rows, length):
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    seen, out = set(), {}
    for i in sorted(raw):
        t = raw[i]
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            s = t[p:p + length]
            if s in seen:
                gone[p:p + length] = True
            seen.add(s)
        gone = gone[:len(t)]
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[i] = (len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def answer(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n, r.sha) for r in
            df.withColumn("n", F.size("spans").cast("long")).withColumn("sha", F.sha2("kept", 256)).collect()}


@pytest.mark.parametrize(("length", "gram", "bucket"), [(100, 16, 250_000), (100, 16, 40), (20, 5, 30), (9, 4, 2000)])
def test_equals_brute_force(small, length, gram, bucket):
    rows, df = small
    assert answer(suffix_dedup.dedup(df, length=length, gram=gram, bucket_size=bucket)) == brute(rows, length)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert answer(suffix_dedup.dedup(df)) == brute([(r.doc_id, r.text) for r in df.collect()], 100)


def test_a_passage_that_a_third_of_all_documents_share(spark):
    rng = np.random.default_rng(3)
    say = lambda n: "".join(rng.choice(list("abcd "), n))
    passage = say(150)
    rows = [(i, say(60) + (passage if i % 3 == 0 else "") + say(60)) for i in range(150)]
    rows += [(900, "a" * 500), (901, "a" * 350 + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert answer(suffix_dedup.dedup(df, bucket_size=5)) == brute(rows, 100)


def test_empty_table_and_clashing_names(nothing, small):
    assert suffix_dedup.dedup(nothing).count() == 0
    _, df = small
    odd = df.withColumn("spans", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("bucket", F.lit(None).cast("int"))
    assert suffix_dedup.dedup(odd).count() == df.count()


def test_multikey_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 24)).astype(np.uint8)
    rows[100:200] = rows[0:100]
    order, common = suffix_dedup.multikey_order(suffix_dedup._symbols(rows))
    lines = [bytes(rows[i]) for i in order]
    assert lines == sorted(lines)
    for k in range(1, len(lines)):
        same = next((j for j in range(24) if lines[k][j] != lines[k - 1][j]), 24)
        assert common[k] == same


def test_a_frequent_lead_with_different_followers_is_spread(spark):
    rng = np.random.default_rng(5)
    say = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    rows = [(i, "".join(say(90) + " " * 40 for _ in range(6)) + say(60)) for i in range(120)]
    rows += [(900, rows[3][1]), (901, "x" + rows[5][1][50:400])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert answer(suffix_dedup.dedup(df, bucket_size=40)) == brute(rows, 100)
    sent, _ = suffix_dedup.dealt_suffixes(df, bucket_size=40)
    n = [r.n for r in sent.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect()]
    assert max(n) < sum(n) / 10
