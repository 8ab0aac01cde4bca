"""The registered queries of this subpackage: thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import oracle
from corvane.llm.decontam import benchmark_hits, contaminated
from corvane.llm.html_extract import extract
from corvane.llm.langid import fold_of, identify, train
from corvane.llm.lm_score import score_corpus
from corvane.llm.mixing import mix
from corvane.llm.quality import quality_report
from corvane.llm.simhash import fingerprint_hex, near_duplicates
from corvane.llm.suffix_dedup import dedup
from corvane.llm.tables import table
from corvane.llm.token_counts import section_tokens
from corvane.llm.token_files import token_digest


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; any other file of the tokenizers library does as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold_of(F.col("doc_id")) != 0))
    held = F.coalesce(fold_of(F.col("id")) == 0, F.lit(False))
    return identify(docs.select("doc_id", "text"), model).select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_digest(table(spark, sf_dir, "documents"), vocabulary())
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("learn", ~held)
    found = score_corpus(docs, "learn").withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return oracle.ORACLES
