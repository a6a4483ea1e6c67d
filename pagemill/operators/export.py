"""Exports: pages for retrieval, and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.quality import page_signal

PAGE = ("doc_id", "page_no")


def chunks(pages: DataFrame) -> DataFrame:
    """``pages`` (text, label, page from 0, ...) as rows with content, page_label (the page's number where there is none) and signal."""
    p = page_signal(pages).withColumn("page_label", F.coalesce("label", (F.col("page") + 1).cast("string")))
    return p.withColumnRenamed("text", "content").drop("label", "null_slot", "text_error", "n_images")


def _finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def box(height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """[x0, top, x1, bottom] with the origin at the top left; what isn't finite is 0."""
    return F.array(_finite(x), _finite(height - y - h), _finite(x + w), _finite(height - y))


def page_json(words: DataFrame, height: float) -> DataFrame:
    """(doc_id, page_no, json): a page's lines, each with its box and spans."""
    at = lambda: box(F.lit(height), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    w = words.withColumn("bbox", at())
    span = F.array_sort(F.collect_list(F.struct("word_no", F.col("s").alias("text"), "font", F.col("font_size").alias("size"), "bbox")))
    line = w.groupBy(*PAGE, "line_no").agg(span.alias("spans"))
    edge = lambda i, f: f(F.transform("spans", lambda s: s["bbox"][i]))
    line = line.withColumn("bbox", F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max)))
    page = line.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_no", "bbox", "spans"))).alias("lines"))
    return page.select(*PAGE, F.to_json(F.struct(F.col("page_no").alias("page"), F.lit("top-left").alias("coord_origin"), "lines")).alias("json"))


def document_json(pages: DataFrame, fonts: DataFrame, links: DataFrame, warnings: DataFrame) -> DataFrame:
    """(doc_id, json): pages with their warnings, fonts, links, and the warnings that belong to no page."""
    per = warnings.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("code", "message", "detail"))).alias("warnings"))
    p = pages.join(per, [*PAGE], "left")
    p = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "json", "warnings"))).alias("pages"), F.count("*").alias("page_count"))
    f = fonts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", "name", "subtype", "embedded", "pages"))).alias("fonts"))
    k = links.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("from_page", "ordinal", "uri", "to_page"))).alias("links"))
    left = warnings.join(pages.select(*PAGE), [*PAGE], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "code", "message", "detail"))).alias("warnings"))
    out = p.join(f, "doc_id", "left").join(k, "doc_id", "left").join(left, "doc_id", "left")
    return out.select("doc_id", F.to_json(F.struct("page_count", "pages", "fonts", "links", "warnings")).alias("json"))


def document_text(pages: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, text, text_error): the strict texts of a document's pages one after the other; the first page that can't be read ends it with an error and no text."""
    first = F.min(F.when(F.col("text_error").isNotNull(), F.struct("page_no", "text_error")))["text_error"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda e: F.coalesce(e["text"], F.lit(""))), "")
    return pages.groupBy(by).agg(text.alias("text"), first.alias("text_error")).withColumn("text", F.when(F.col("text_error").isNull(), F.col("text")).otherwise(""))
