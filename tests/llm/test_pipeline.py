import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tsforge.llm import langid, quality

D = "/root/testdata/sf0.01"
W = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_and_names():
    assert [n for n, _ in cp.STAGES] == ["language", "quality", "near_duplicates", "substrings", "packing"]
    assert cp.ORACLE_SQL is None


def near_brute(rows, k=5):
    sets = {}
    for i, t in rows:
        w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    where, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in where[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j < i and 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


def cut_brute(rows):
    words = {i: W.findall(t or "") for i, t in rows}
    text, first, out = dict(rows), {}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p:p + 50]), i)
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - 49):
            if first[tuple(w[p:p + 50])] < i:
                gone.update(range(p, p + 50))
        if not gone:
            out[i] = text[i]
        elif len(gone) < len(w):
            out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


@pytest.fixture(scope="module")
def passed(spark, tmp_path_factory):
    """Each stage's result, written and read again."""
    out, docs = {}, spark.read.parquet(f"{D}/documents.parquet")
    out["documents"] = docs
    for name, stage in cp.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, D).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_each_stage_against_its_input(spark, passed):
    docs = passed["documents"]
    for name in ("language", "quality", "near_duplicates", "substrings"):
        assert passed[name].columns == docs.columns and dict(passed[name].dtypes) == dict(docs.dtypes)
    named = langid.identify(docs)
    assert {i for i, _ in pairs(passed["language"])} == {r.doc_id for r in named.where("lang_pred <> 'und' AND score >= 0.3").collect()}
    verdicts = quality.score(passed["language"], spark.read.parquet(f"{D}/labels.parquet"))
    assert {i for i, _ in pairs(passed["quality"])} == {r.doc_id for r in verdicts.where("kept").collect()}
    assert {i for i, _ in pairs(passed["near_duplicates"])} == near_brute(pairs(passed["quality"]))
    assert dict(pairs(passed["substrings"])) == cut_brute(pairs(passed["near_duplicates"]))
    assert passed["substrings"].where("n_chars <> length(text)").join(docs.where("n_chars = length(text)"), "doc_id").count() == 0
    packed = passed["packing"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in pairs(passed["substrings"])}


def test_clean_documents_stay(spark, passed):
    labels = spark.read.parquet(f"{D}/labels.parquet").where("quality = 1")
    clean = passed["documents"].join(labels, "doc_id", "left_semi").count()
    assert passed["quality"].join(labels, "doc_id", "left_semi").count() > 0.97 * clean


def test_odd_rows_and_clashing_names(spark, small, nothing):
    _, df = small
    docs = df.withColumn("kept", F.lit("x")).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit(None).cast("int")).withColumn("given_0", F.lit("g"))
    for name, stage in cp.STAGES:
        result = stage(spark, docs, D)
        assert name == "packing" or (result.columns == docs.columns and 0 < result.count() <= docs.count())
        empty = stage(spark, nothing, D)
        assert empty.count() == 0
