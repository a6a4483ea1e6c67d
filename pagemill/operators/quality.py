"""Quality and routing of pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import is_furniture, ratio

PAGE = ("doc_id", "page_no")
# Where glyphs' text can come from; separators that the interpreter adds are not counted.
SOURCES = ("tounicode", "cidmap", "encoding", "differences", "predefined", "ucs2", "pdfdoc", "fallback", "legacy", "none")
# A document keeps so many warnings, the last of which says that there were more; a detail so many bytes.
CAP, DETAIL = 4096, 256


def page_signal(pages: DataFrame) -> DataFrame:
    """``pages`` (null_slot, text, text_error, n_images) with ``signal``: empty, degraded, text or image_only."""
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == ""
    # fixed values: the signals
    signal = F.when(F.col("null_slot"), "empty").when(F.col("text_error").isNotNull(), "degraded").when(~blank, "text").when(F.col("n_images") > 0, "image_only").otherwise("empty")
    return pages.withColumn("signal", signal)


def decode_counters(glyphs: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    """Characters by where their text comes from, and those without any, of each page."""
    text = glyphs.where("s is not null and s <> '' and s <> '\\n' and enc_source <> 'separator'")
    n, missing = F.length("s"), F.length("s") - F.length(F.replace("s", F.lit("�"), F.lit("")))
    sums = [F.sum(F.when(F.col("enc_source") == s, n).otherwise(0)).alias(s) for s in SOURCES]
    return text.groupBy(*by).agg(*sums, F.sum(missing).alias("unmapped"), F.sum(n).alias("total"))


def decode_ratios(counters: DataFrame) -> DataFrame:
    """``counters`` with shares of characters: without an encoding, from a fallback or CID map, and unmapped; 0 of nothing is 0."""
    total = F.col("total")
    return counters.withColumns({"missing_ratio": ratio(F.col("none"), total), "fallback_ratio": ratio(F.col("fallback") + F.col("cidmap"), total), "unmapped_ratio": ratio(F.col("unmapped"), total)})


def document_summary(pages: DataFrame, counters: DataFrame) -> DataFrame:
    """Of each document: pages by signal, and ratios from sums over its pages, never from its pages' ratios."""
    tally = lambda s: F.count_if(F.col("signal") == s).alias(f"n_{s}")
    p = page_signal(pages).groupBy("doc_id").agg(F.count("*").alias("n_pages"), *map(tally, ("text", "image_only", "empty", "degraded")))
    c = decode_ratios(counters.groupBy("doc_id").agg(*[F.sum(x).alias(x) for x in (*SOURCES, "unmapped", "total")]))
    out = p.join(c.select("doc_id", "missing_ratio", "fallback_ratio", "unmapped_ratio"), "doc_id", "left")
    return out.na.fill(0.0, ["missing_ratio", "fallback_ratio", "unmapped_ratio"])


def image_coverage(images: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, n_images, coverage): images' area over the media box's, 1 at most; 0 of an empty box."""
    box = F.col("media_box")
    area = (box[2] - box[0]) * (box[3] - box[1])
    i = images.groupBy(*PAGE).agg(F.count("*").alias("n_images"), F.sum(F.abs(F.col("w") * F.col("h"))).alias("covered"))
    out = pages.select(*PAGE, area.alias("area")).join(i, [*PAGE], "left")
    return out.select(*PAGE, F.coalesce("n_images", F.lit(0).cast("long")).alias("n_images"), F.when(F.col("area") > 0, F.least(F.lit(1.0), F.coalesce(F.col("covered"), F.lit(0.0)) / F.nullif("area", F.lit(0.0)))).otherwise(0.0).alias("coverage"))


def sparse_pages(words: DataFrame, bottom: Column, top: Column) -> DataFrame:
    """(doc_id, page_no): pages whose only text is one to three tokens of a page number in the outer tenths of the page."""
    edge = (top - bottom) * 0.1
    at = (F.col("y") <= bottom + edge) | (F.col("y") + F.col("h") >= top - edge)
    g = words.groupBy(*PAGE).agg(F.count("*").alias("n"), F.bool_and(is_furniture(F.col("s")) & at).alias("all"), F.bool_or(F.col("s").rlike(r"\p{Nd}")).alias("digit"))
    return g.where("n <= 3 and all and digit").select(*PAGE)


def page_summary(pages: DataFrame, words: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page_no, has_text, word_count, image_count, coverage)."""
    w = words.groupBy(*PAGE).agg(F.count("*").alias("word_count"))
    out = image_coverage(images, pages).join(w, [*PAGE], "left")
    n = F.coalesce("word_count", F.lit(0).cast("long"))
    return out.select(*PAGE, (n > 0).alias("has_text"), n.alias("word_count"), F.col("n_images").alias("image_count"), "coverage")


def routing_warnings(pages: DataFrame, summary: DataFrame) -> DataFrame:
    """Warnings image_only of pages with images, without words and with blank strict text."""
    hit = page_signal(pages).join(summary, [*PAGE]).where("not has_text and image_count > 0 and text_error is null and (text is null or trim(text) = '')")
    return hit.select(*PAGE, F.lit("image_only").alias("code"), F.lit("page has images but no extractable text").alias("message"), F.lit("").alias("detail"))


def clamp_detail(s: Column) -> Column:
    """At most DETAIL bytes of a text, cut between characters."""
    cut = F.make_valid_utf8(F.substring(F.encode(s, "utf-8"), 1, DETAIL).cast("string"))
    return F.when(F.octet_length(s) <= DETAIL, s).otherwise(F.regexp_replace(cut, "�+$", ""))


def warning_set(warnings: DataFrame, cap: int = CAP) -> DataFrame:
    """A document's distinct warnings by page, code and detail; beyond the cap, one says that there were more."""
    w = warnings.withColumn("detail", clamp_detail(F.coalesce("detail", F.lit("")))).dropDuplicates([*PAGE, "code", "message", "detail"])
    by = Window.partitionBy("doc_id")
    n = w.withColumns({"n": F.count("*").over(by), "r": F.row_number().over(by.orderBy("page_no", "code", "detail", "message"))})
    keep = n.where((F.col("n") <= cap) | (F.col("r") < cap))
    more = n.where((F.col("n") > cap) & (F.col("r") == cap)).withColumns({"page_no": F.lit(0), "code": F.lit("truncated"), "message": F.lit("more warnings were dropped"), "detail": F.lit("")})
    return keep.unionByName(more).drop("n", "r")


def document_scoped(warnings: DataFrame) -> DataFrame:
    return warnings.where("page_no = 0")


def page_scoped(warnings: DataFrame) -> DataFrame:
    return warnings.where("page_no > 0")
