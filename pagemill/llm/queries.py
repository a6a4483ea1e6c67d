"""The registered queries of the corpus operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontam, mixing
from pagemill.llm.labelled import fold
from pagemill.llm.license_scan import scan_licenses
from pagemill.llm.near_dup import near_duplicates
from pagemill.llm.neighbours import nearest
from pagemill.llm.passages import repeated_passages
from pagemill.llm.quality import score_quality
from pagemill.llm.surrogates import replace_personal_data
from pagemill.llm.token_files import read_documents, write_tokens
from pagemill.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())
    return read_documents(folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents")).drop("copied", "told")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2).drop("told", "stays")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _predicted(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train=fold(5) != 0)
    return _predicted(scored, fold(5) == 0)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(_table(spark, sf_dir, "documents"), key="pagemill").select("doc_id", "text", "n_replaced")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train=fold(3) != 1)
    return _predicted(scored, fold(3) == 1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontamination, op2_token_files, op3_repeated_passages, op4_near_duplicates, op5_nearest_neighbours, op6_license_scan, op7_source_mix, op8_toxicity, op9_surrogates, op10_quality)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontam.ORACLE, "op7_source_mix": mixing.ORACLE}
