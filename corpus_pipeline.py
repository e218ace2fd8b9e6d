"""A training corpus from raw documents, as stages of Spark jobs.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and reads it as the next stage's documents. A stage works on all that its predecessor kept, and
nothing passes the driver. All stages but the last return the columns that they were given.

Rows without a doc_id are left out by the first stage (no later result could name them). Null and empty
texts have no language and go in the first stage. Ties, copies and repeated rows are treated as each operator's
module says; an empty table gives an empty result; extra columns are carried along whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import langid, minhash_forest, packing, quality, substring_dedup
from tsforge.session import shared_path, ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network recognises; texts without a letter go."""
    ship_package(spark)
    return langid.recognised(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted on the labels of documents in ``docs``."""
    ship_package(spark)
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest id."""
    ship_package(spark)
    kept = minhash_forest.near_duplicates(docs, width=5).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of 50 words that a smaller id also holds. A text that loses words is its other
    words joined by one space, any other text stays as it is; a document that loses all its words goes."""
    ship_package(spark)
    others = tuple(c for c in docs.columns if c != "doc_id")
    place = {c: f"given_{k}" for k, c in enumerate(others)}
    given = docs.select("doc_id", *(F.col(c).alias(g) for c, g in place.items()))
    cut = substring_dedup.dedup(given, text_col=place["text"], carry=tuple(place.values()))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(place["text"]))
    cut = cut.where("n_removed = 0 OR n_removed < n_words")
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(place["n_chars"])) if "n_chars" in place else None}
    return cut.select(*(F.col("doc_id") if c == "doc_id" else (new[c] if c in new else F.col(place[c])).cast(docs.schema[c].dataType).alias(c)
                        for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids, with the sequence and offset each is packed at."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [("language", language), ("quality", quality_rules), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", pack)]

#: SQL can express neither the network nor the trees; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
