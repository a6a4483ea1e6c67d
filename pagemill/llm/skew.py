"""Joins whose commonest keys are spread over all tasks, and names that clash with no column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.storage import Stash

#: Keys that hold more than one in COMMON of all rows are joined by a broadcast; there are fewer than COMMON of them.
COMMON = 5_000


def join_counted(rows: DataFrame, table: DataFrame, key: str, spread: Iterable[str]) -> DataFrame:
    """``rows``, of which each key may have many, with the columns of ``table``, which has one row for each of some keys.

    ``table`` also has n, the number of ``rows`` of its key, and is read three times. A key of a third of all rows would
    go to one task: the commonest keys, whose number is bounded, are joined by a broadcast, and their
    rows then go through the other join under hashes of their columns ``spread``, whatever these meet there.
    """
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    common = F.col("n") > total // COMMON
    given = [c for c in table.columns if c != key]
    hot = table.where(common).select(F.col(key).alias("hot_key"), F.struct(*given).alias("hot"))
    rest = table.where(~common).select(F.col(key).alias("rest_key"), F.struct(*given).alias("rest"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    dealt = dealt.withColumn("dealt", F.when(F.col("hot_key").isNull(), F.col(key)).otherwise(F.xxhash64(*spread)))
    got = dealt.join(rest, F.col("dealt") == F.col("rest_key"), "left").withColumn("got", F.coalesce("hot", "rest"))
    return got.where(F.col("got").isNotNull()).select(*rows.columns, *[F.col(f"got.{c}").alias(c) for c in given if c != "n"])


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], stash: Stash, key: str) -> DataFrame:
    """``rows`` with, for each name, the sum over all rows before in a total order, without one task that sees them all.

    Rows are dealt by ranges and kept with the number of their range; what precedes a range is summed over the ranges alone.
    """
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = stash.put(key, dealt.select("*", *[v.alias(f"of_{c}") for c, v in sums.items()]))
    ranges = dealt.groupBy("part").agg(*[F.sum(f"of_{c}").alias(f"all_{c}") for c in sums])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("part").alias("range"), *[F.sum(f"all_{c}").over(before).alias(f"before_{c}") for c in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(ranges), F.col("part") == F.col("range"))
    both = {c: F.coalesce(F.col(f"before_{c}"), F.lit(0)) + F.coalesce(F.sum(f"of_{c}").over(inside), F.lit(0)) for c in sums}
    return out.select(*rows.columns, *[v.alias(c) for c, v in both.items()])


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, or if a column has it in any case, the like."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
