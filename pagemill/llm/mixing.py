"""Mixing sources to target weights by nested hash thresholds; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.skew import running
from pagemill.llm.storage import Stash

#: A document's place in its source's order: 60 bits, refined LEVELS times by LEVEL bits.
BITS, LEVEL, LEVELS = 60, 12, 3
#: No document is taken more often than this.
REPEATS = 3
#: The table of sources goes to every task if it has at most so many rows; a larger one is joined by shuffling.
SOURCES = 100_000


def _size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(doc_id: str = "doc_id", text: str = "text") -> Column:
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long")


def _targets(sizes: DataFrame, weights: dict[str | None, float] | None, stash: Stash) -> DataFrame:
    """(source, source_size, target): targets by weight, none above REPEATS times its source's size.

    Sources are filled in the order in which a rising level per unit of weight meets their limits:
    those before the first that the level leaves below its limit stop there, and the rest share
    what remains by weight, which is where resharing the excess again and again ends. There may be very
    many sources: ranks and sums are running sums over ranges of them.
    """
    if weights is None:
        s = running(stash.put("sizes", sizes), [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, stash, "ranks")
        s = s.withColumn("w", (F.col("rank") % 3 + 1).cast("double")).drop("rank")
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        s = sizes.withColumn("w", weight)
    s = s.withColumn("most", (F.col("source_size") * REPEATS).cast("double"))
    by = [F.when(F.col("w") > 0, F.col("most") / F.nullif("w", F.lit(0.0))).asc_nulls_last(), F.col("source").asc_nulls_last()]
    s = stash.put("levels", running(s, by, {"n": F.lit(1), "full": F.col("most"), "weighed": F.col("w")}, stash, "filled"))
    every = s.agg(F.sum("source_size").cast("double").alias("total"), F.sum("w").alias("w")).first()
    level = (F.lit(every.total) - F.col("full")) / F.nullif(F.lit(every.w) - F.col("weighed"), F.lit(0.0))
    stops = F.coalesce(level * F.col("w") > F.col("most"), F.lit(True))
    first = s.where(~stops).agg(F.min(F.struct("n", level.alias("level"))).alias("open")).first().open
    # behind the first that stays below its limit, all share its level
    reached = F.col("n") < F.lit(first.n) if first else F.lit(True)
    return s.select("source", "source_size", F.when(F.col("w") == 0, F.lit(0.0)).when(reached, F.col("most")).otherwise(F.lit(first.level if first else 0.0) * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, stash: Stash, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(of, source_size, target, whole, below) of sized rows (source, size, place), hinted for joining with rows by source.

    Each document is taken ``whole`` times, and once more if its place is under ``below``. Each
    level sums sizes by source and bucket of places, keeps the bucket in which the budget ends, and
    looks into that bucket alone at the next level; in the last one the nearer end is taken.
    """
    plan = _targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, stash).withColumnRenamed("source", "of")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif("source_size", F.lit(0)))).otherwise(F.lit(0)).cast("long"))
    plan = stash.put("plan", plan.withColumn("budget", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")).withColumn("below", F.lit(0).cast("long")))
    small = plan.count() <= SOURCES
    hinted = lambda p: F.broadcast(p) if small else p
    width = BITS
    for level in range(LEVELS):
        width -= LEVEL
        p = plan.select("of", "below", "budget")
        inside = sized.where("size > 0").join(hinted(p), F.col("source").eqNullSafe(F.col("of"))).where((F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.lit(1 << (width + LEVEL))))
        hist = inside.groupBy("of", "budget", F.shiftright(F.col("place") - F.col("below"), width).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("of").orderBy("bucket"))
        edge = hist.withColumn("upto", upto).where(F.col("upto") > F.col("budget")).groupBy(F.col("of").alias("edge_of")).agg(F.min(F.struct("bucket", "upto", "words")).alias("e"))
        plan = plan.join(edge, F.col("of").eqNullSafe(F.col("edge_of")), "left").drop("edge_of")
        before = (F.col("e.upto") - F.col("e.words")).cast("double")
        start = F.col("below") + F.coalesce(F.shiftleft(F.col("e.bucket"), width), F.lit(0))
        if not level:  # rounding may leave a budget of all there is
            start = F.when(F.col("e").isNull() & (F.col("budget") > 0), F.lit(1 << BITS)).otherwise(start)
        if level == LEVELS - 1:
            near = (F.col("budget") - before) * 2 >= F.col("e.words")
            start = start + F.when(F.coalesce(near, F.lit(False)), F.lit(1 << width)).otherwise(F.lit(0))
        plan = stash.put("plan", plan.withColumns({"below": start.cast("long"), "budget": F.col("budget") - F.coalesce(before, F.lit(0.0))}).drop("e"))
    return hinted(plan.select("of", "source_size", "target", "whole", "below"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken: how often the mix takes each document.

    A document's size is its number of runs of anything but ASCII white space (null text: 0).
    Sources in code-point order, null last, weigh 1, 2, 3 and so on again, or as ``weights`` says
    (0 for a source that it doesn't name); all sizes are shared by weight, no source above three
    times its own. Within a source the documents stand in the order of an MD5 of doc_id and text,
    so a larger budget takes a superset, and reruns agree. Equal rows stand at one place, and are
    taken together. Documents without words are taken 0 times. Columns of ``docs`` named as the new
    ones are replaced; an empty table gives an empty one.
    """
    stash = Stash(docs.sparkSession, "mix")
    sized = stash.put("sized", docs.select("source", _size().alias("size"), _place().alias("place")))
    plan = thresholds(sized, stash, weights)
    stash.drop("sized")
    made = ["size", "source_size", "target", "copies", "taken"]
    keep = [c for c in docs.columns if c not in made]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), _size().alias("size"), _place().alias("place"))
    rows = rows.join(plan, F.col("doc.source").eqNullSafe(F.col("of")))
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("place") < F.col("below")).cast("long")).otherwise(F.lit(0)).cast("long")
    return rows.withColumn("copies", copies).select("doc.*", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


#: DuckDB: the same buckets of the last level, summed at once.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w,
         (3 * sum(size))::DOUBLE AS most
  FROM d GROUP BY source),
o AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, row_number() OVER by_limit AS n,
         coalesce(sum(most) OVER (by_limit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
         sum(w) OVER (by_limit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s WINDOW by_limit AS (ORDER BY most / w, source NULLS LAST)),
l AS (SELECT *, (total - filled) / rest AS level, ((total - filled) / rest) * w > most AS stops FROM o),
f AS (SELECT min(n) FILTER (NOT stops) AS n1, arg_min(level, n) FILTER (NOT stops) AS level1 FROM l),
t AS (
  SELECT source, source_size, CASE WHEN n < coalesce(n1, n + 1) THEN most ELSE level1 * w END AS target FROM l, f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
h AS (
  SELECT p.source, d.place >> 24 AS bucket, sum(d.size) AS words, any_value(p.target - (p.whole * p.source_size)::DOUBLE) AS budget
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WHERE d.size > 0 GROUP BY p.source, d.place >> 24),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM h),
e AS (
  SELECT source, min(bucket) AS bucket, arg_min((budget - (upto - words)::DOUBLE) * 2 >= words, bucket) AS near
  FROM c WHERE upto > budget GROUP BY source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * CASE WHEN d.size = 0 THEN 0 ELSE p.whole + CASE WHEN (d.place >> 24) < e.bucket + CASE WHEN e.near THEN 1 ELSE 0 END THEN 1 ELSE 0 END END)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
