"""Rows without an id, repeated rows, and the registration of every query."""

import pytest
from pyspark.sql import functions as F

from tests_llm_corpus import corpus, IDS_AND_TEXTS  # noqa: I001
from tsforge.llm import (bpe_chunks, embedding_join, langid, minhash_forest, packing, quality, substring_dedup,
                         suffix_dedup, toxicity)

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = corpus(9, 30)
    return spark.createDataFrame([*rows, (None, "no id " * 40, "en", "s", 1), rows[5], rows[5], rows[11]], IDS_AND_TEXTS).repartition(4), rows


@pytest.mark.parametrize("operator", [
    suffix_dedup.dedup, substring_dedup.dedup, minhash_forest.near_duplicates, bpe_chunks.round_trip_digests, bpe_chunks.encode,
    lambda df: langid.identify(df, epochs=1),
    lambda df: quality.score(df, df.sparkSession.createDataFrame([], LABELS)),
    lambda df: toxicity.score(df, df.sparkSession.createDataFrame([], LABELS))])
def test_one_row_for_each_row_with_an_id(odd, operator):
    df, rows = odd
    got = operator(df).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert sum(r["count"] for r in got) == len(rows) + 3


def test_repeated_rows_are_alike(odd):
    df, rows = odd
    for result in (suffix_dedup.dedup(df), substring_dedup.dedup(df), minhash_forest.near_duplicates(df)):
        assert result.groupBy("doc_id").agg(F.countDistinct(F.to_json(F.struct(*[c for c in result.columns if c not in ("spans", "kept")]))).alias("n")) \
            .where("n > 1").count() == 0


def test_packing_places_repeated_rows_apart(odd):
    df, rows = odd
    packed = packing.pack_documents(df, capacity=64)
    assert packed.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0
    assert packed.select("doc_id").distinct().count() == len(rows)


def test_repeated_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = embedding_join.near_duplicates(df).collect()
    assert sorted(r.vec_id for r in got) == [1, 2] and all(r.kept for r in got)


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("given", "kept"), [("64m", "4194304"), ("67108864b", "4194304"), ("64k", "64k"), ("1000", "1000"), ("2mb", "2mb")])
def test_batches_are_bounded(spark, given, kept):
    from tsforge.llm.tables import bounded_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, given)
    bounded_batches(spark)
    assert spark.conf.get(key) == kept
    spark.conf.set(key, before)


def test_samples_of_very_large_tables_are_not_empty():
    """The share of rows taken for training is kept on 63 bits: counts far beyond any millionth."""
    from tsforge.llm.tables import threshold
    for total in (10, 16_000, 10 ** 6, 2 * 10 ** 9, 10 ** 12, 10 ** 15):
        took = (threshold(16_000, total) + 1) / 2 ** 63 * total
        assert abs(took - min(total, 16_000)) < 16
