"""Document structure: links, destinations, outlines, labels, fonts, form fields, attachments."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import page_label
from pagemill.operators.seq import asof_last

#: Bits of a form field's flags.
READ_ONLY, RADIO, PUSH, COMBO = 1, 1 << 15, 1 << 16, 1 << 17
DEPTH = 1024


def page_labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, page_no, label): the last range that starts at or before a page (``start`` counts from 0) labels it; pages without one have their number."""
    r = ranges.select("doc_id", (F.col("start") + 1).alias("from"), "ordinal", "prefix", "style", "st")
    got = asof_last(pages.select("doc_id", "page_no"), r, ["doc_id"], "page_no", "from", ["from", "prefix", "style", "st"], "ordinal")
    n = F.coalesce("st", F.lit(1)) + F.col("page_no") - F.col("from")
    return got.select("doc_id", "page_no", F.when(F.col("from").isNull(), F.col("page_no").cast("string")).otherwise(page_label(F.col("style"), F.col("prefix"), n)).alias("label"))


def font_inventory(uses: DataFrame) -> DataFrame:
    """(doc_id, name, subtype, embedded, pages, first_seq): a document's fonts; the first use gives the subtype, any use embeds."""
    return uses.groupBy("doc_id", "name").agg(F.min_by("subtype", "seq").alias("subtype"), F.bool_or("embedded").alias("embedded"), F.array_sort(F.collect_set("page_no")).alias("pages"), F.min("seq").alias("first_seq"))


def field_type(ft: Column, flags: Column) -> Column:
    """What kind of form field a type and its flags make."""
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    button = F.when(has(PUSH), "button").when(has(RADIO), "radio").otherwise("checkbox")
    return F.when(ft == "Btn", button).when(ft == "Ch", F.when(has(COMBO), "combo").otherwise("list")).when(ft == "Tx", "text").otherwise("unknown")


def field_value(kind: Column, values: Column) -> Column:
    """A field's value as text: several choices joined by commas, an unset box Off."""
    text = F.array_join(F.coalesce(values, F.array().cast("array<string>")), ", ")
    return F.when(kind.isin("checkbox", "radio") & (text == ""), "Off").otherwise(text)


def links(annotations: DataFrame, destinations: DataFrame, page_map: DataFrame) -> DataFrame:
    """(doc_id, from_page, ordinal, uri, to_page): link annotations in order; a destination that leads nowhere leaves to_page null.

    A destination is given by name, of which the first entry holds, or by the object of its page.
    """
    named = destinations.where("tree = 'Dests'").groupBy(F.col("doc_id").alias("n_doc"), F.col("name").alias("n_name")).agg(F.min_by("dest_obj", "ordinal").alias("by_name"))
    a = annotations.where("type = 'Link'").join(named, (F.col("doc_id") == F.col("n_doc")) & (F.col("dest_name") == F.col("n_name")), "left")
    a = a.withColumn("obj", F.coalesce("by_name", "dest_obj"))
    p = page_map.select(F.col("doc_id").alias("d"), F.col("obj").alias("o"), F.col("page_no").alias("to_page"))
    return a.join(p, (F.col("doc_id") == F.col("d")) & (F.col("obj") == F.col("o")), "left").select("doc_id", F.col("page_no").alias("from_page"), "ordinal", "uri", "to_page")


def tree_paths(nodes: DataFrame, sep: str = ".") -> DataFrame:
    """(doc_id, node_id, depth, path) of the nodes (doc_id, node_id, parent_id, title) that a root leads to, DEPTH levels deep at most.

    A document's tree is walked in one task, as it was read from one file; documents don't wait for each other.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}

    def walk(table: pa.Table) -> pa.Table:
        below: dict = {}
        for node, parent, title in zip(*(table.column(c).to_pylist() for c in ("node_id", "parent_id", "title")), strict=True):
            below.setdefault(parent, []).append((node, title))
        found, level = [], [(node, title) for node, title in below.get(None, [])]
        for depth in range(DEPTH + 1):
            found += [(node, depth, path) for node, path in level]
            level = [(node, None if path is None or title is None else f"{path}{sep}{title}") for up, path in level if up is not None for node, title in below.get(up, [])]
            if not level:
                break
        ids, depths, paths = zip(*found, strict=True) if found else ((), (), ())
        doc = table.column("doc_id")
        return pa.table({"doc_id": pa.array([doc[0].as_py()] * len(ids), doc.type), "node_id": pa.array(ids, table.column("node_id").type), "depth": pa.array(depths, pa.int32()), "path": pa.array(paths, pa.string())})

    need = nodes.select("doc_id", "node_id", "parent_id", "title")
    return need.groupBy("doc_id").applyInArrow(walk, f"doc_id {kinds['doc_id']}, node_id {kinds['node_id']}, depth int, path string")


def attachment_names(files: DataFrame) -> DataFrame:
    """``files`` (uf, f, key) with ``name``: the Unicode name, else the plain one, else the key."""
    empty = lambda c: F.nullif(c, F.lit(""))
    return files.withColumn("name", F.coalesce(empty(F.col("uf")), empty(F.col("f")), F.col("key")))


def latest_objects(entries: DataFrame) -> DataFrame:
    """Of each object (doc_id, obj_id) the entry of the newest revision."""
    by = Window.partitionBy("doc_id", "obj_id").orderBy(F.col("revision").desc())
    return entries.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")
