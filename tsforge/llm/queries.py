"""One registered query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import bpe_chunks, embedding_join, langid, minhash_forest, oracles, packing, page_template, periodic_runs, quality, spelling, substring_dedup, suffix_dedup, toxicity, warc
from tsforge.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents")) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.new_folder(spark)
    warc.write(_table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.round_trip_digests(_table(spark, sf_dir, "documents"))


def op11_fm_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), typo=spelling.crc_typo)


def op12_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_template.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic(_table(spark, sf_dir, "documents"), plant=periodic_runs.echo)
    # the longest run, then the first, then the shortest period
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length",
        (-F.col("best.period")).alias("period"), F.expr("best.length * 1000 DIV -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_byte_network": op3_byte_network,
    "op4_toxicity_trees": op4_toxicity_trees,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc_archives": op6_warc_archives,
    "op7_grid_order_join": op7_grid_order_join,
    "op8_quality_trees": op8_quality_trees,
    "op9_minhash_forest": op9_minhash_forest,
    "op10_bpe_chunk_reuse": op10_bpe_chunk_reuse,
    "op11_fm_spelling": op11_fm_spelling,
    "op12_page_templates": op12_page_templates,
    "op13_periodic_runs": op13_periodic_runs,
}

#: The network, the trees, the tokenizer and the packing are beyond SQL; tests hold those against brute force.
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": oracles.OP1,
    "op5_substring_dedup": oracles.OP5,
    "op6_warc_archives": oracles.OP6,
    "op7_grid_order_join": oracles.OP7,
    "op9_minhash_forest": oracles.OP9,
    "op11_fm_spelling": oracles.OP11,
}
