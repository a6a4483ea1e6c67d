"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(folds: int, doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """Texts and labels (doc_id, text, y, told) of at most ``per_class`` documents of each label, and how many documents each stands for.

    ``train`` is a condition on doc_id. The documents whose ids have the least MD5 values are
    taken. Rows without doc_id or with a label other than 0 or 1 don't count; of a doc_id with several labels the
    least holds. A doc_id with several texts has a row for each, told apart by ``told``, until ``one_each`` takes one.
    """
    known = labels.where(train & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    order = F.md5(F.col("doc_id").cast("string"))
    parts = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    there = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = parts[0].union(parts[1])
    weight = {y: max(1.0, there.get(y, 0) / per_class) for y in (0, 1)}
    # the sample is bounded by its row count, so it may go to every task
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.select("doc_id", "text", "y", F.xxhash64("text").alias("told")), weight


def one_each(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, told, ...) of a sample's documents with one of each doc_id: one of the least ``told``.

    What is broadcast has a row for each sampled doc_id. Texts are moved only where a doc_id repeats.
    """
    least = rows.groupBy("doc_id").agg(F.min("told").alias("least"), F.count("*").alias("n"))
    if least.where("n > 1").isEmpty():
        return rows
    kept = F.broadcast(least.select(F.col("doc_id").alias("of"), "least"))
    return rows.join(kept, (F.col("doc_id") == F.col("of")) & (F.col("told") == F.col("least")), "left_semi").dropDuplicates(["doc_id"])
