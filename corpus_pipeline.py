"""From raw documents to token files: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontam, mixing
from pagemill.llm.labelled import fold
from pagemill.llm.near_dup import drop_near_duplicates
from pagemill.llm.quality import learn, with_quality
from pagemill.llm.queries import tokenizer_path
from pagemill.llm.skew import unused
from pagemill.llm.storage import Stash
from pagemill.llm.token_files import read_documents, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more.

    Null and empty texts have the score of no difference between good and bad; rows that repeat, tied scores among them, are
    judged alike; an empty table gives an empty one; a column of any name is kept as it is.
    """
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", fold(3) != 1)
    score = unused(docs.columns, "score")
    return with_quality(docs, model, score).where(F.col(score) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id, and of rows with one doc_id and text, one.

    Null texts, texts without words and rows without doc_id are linked with nothing and stay; an empty table gives an
    empty one; a column of any name is kept as it is.
    """
    return drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item.

    Null and empty texts hold none and stay; rows that repeat are judged alike; items that repeat or have no words change
    nothing; without items all documents stay; an empty table gives an empty one; a column of any name is kept as it is.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    Null texts and texts without words are taken 0 times; a null source is a source of its own, the last; rows that
    repeat stand at one place and are taken together; an empty table gives an empty one; a column of any name is kept as it is.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", "row.doc_id", "row.text", "row.source")
    mixed = mixing.mix(rows).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return mixed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, and a row for each document in them.

    Null texts are empty and give the end id alone; null doc_ids come first; rows that repeat are written each; an empty
    table writes no file and gives no row; other columns are not read.
    """
    folder, manifest = write_tokens(docs, tokenizer_path())
    return read_documents(folder, manifest)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix), ("token_files", token_files)]

#: Compression, sketches and tokens are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written as Parquet and read again before the next."""
    stash = Stash(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash.put(name, stage(spark, docs, sf_dir))
    return docs
