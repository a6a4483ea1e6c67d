"""Sequence operators that the layout and table operators are made of, over any relation.

All are window functions over a partition: one shuffle, no driver round trip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], breaks: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def gap_segments(df: DataFrame, by: Sequence[str], start: str, end: str, tie: str, gap: Column, name: str = "segment") -> DataFrame:
    """Number runs of intervals: a run breaks where the next start lies more than ``gap`` beyond the greatest end so far.

    ``gap`` may use the row's own columns. The greatest end is taken over the whole partition, which is exact where gaps are
    not negative: an interval that reaches beyond a break would have prevented it.
    """
    w = Window.partitionBy(*by).orderBy(start, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return _numbered(df.withColumn("__reach", reach), by, [F.col(start), F.col(tie)], F.col("__reach").isNull() | (F.col(start) - F.col("__reach") > gap), name).drop("__reach")


def cluster_1d(df: DataFrame, by: Sequence[str], at: str, tie: str, tolerance: float, name: str = "cluster") -> DataFrame:
    """Number single-linkage clusters of positions: neighbours within ``tolerance`` share one."""
    w = Window.partitionBy(*by).orderBy(at, tie)
    return _numbered(df.withColumn("__prev", F.lag(at).over(w)), by, [F.col(at), F.col(tie)], F.col("__prev").isNull() | (F.col(at) - F.col("__prev") > tolerance), name).drop("__prev")


def coalesce_intervals(df: DataFrame, by: Sequence[str], lo: str, hi: str, tie: str, tolerance: float) -> DataFrame:
    """(by..., lo, hi, n): intervals merged while the next begins within ``tolerance`` of the reach so far."""
    runs = gap_segments(df, by, lo, hi, tie, F.lit(tolerance), "__run")
    return runs.groupBy(*by, "__run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n")).drop("__run")


def asof_last(points: DataFrame, marks: DataFrame, by: Sequence[str], point: str, mark: str, values: Sequence[str], tie: str) -> DataFrame:
    """``points`` with ``values`` of the last mark at or before each; of marks at one place, the one with the greatest ``tie``.

    Both sides are stacked and carried forward by a window, so the join shuffles each side once and never multiplies rows.
    """
    p = points.select(*by, F.col(point).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(marks.schema[tie].dataType).alias("__tie"), F.struct("*").alias("__row"), F.lit(None).cast(marks.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    m = marks.select(*by, F.col(mark).alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("__row"), F.struct(*values).alias("__v"))
    w = Window.partitionBy(*by).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(m).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").select("__row.*", *[F.col(f"__v.{v}").alias(v) for v in values])


def anchor_fold(df: DataFrame, by: Sequence[str], at: str, tolerance: float, name: str = "anchor") -> DataFrame:
    """(by..., at, anchor): each position with its group's first one, where a group ends beyond ``tolerance`` of its first.

    The distinct positions of a partition are folded in order within the JVM; equal positions share an anchor.
    """
    g = df.groupBy(*by).agg(F.array_sort(F.collect_set(at)).alias("__xs"))
    kind = df.schema[at].dataType
    step = lambda s, x: F.struct(F.when(s["a"].isNull() | (x - s["a"] > tolerance), x).otherwise(s["a"]).alias("a"), F.when(s["a"].isNull() | (x - s["a"] > tolerance), F.concat(s["all"], F.array(x))).otherwise(s["all"]).alias("all"))
    anchors = F.aggregate("__xs", F.struct(F.lit(None).cast(kind).alias("a"), F.array().cast(f"array<{kind.simpleString()}>").alias("all")), step)["all"]
    return g.select(*by, F.explode(anchors).alias(name))
