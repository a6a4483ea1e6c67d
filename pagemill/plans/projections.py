"""Glyph relations made from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines of a page; points of a line, a character and a glyph's height.
PAGE_LINES, LEADING, ADVANCE, HEIGHT, TOP, LEFT = 40, 18, 6, 12, 760, 72


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_glyphs(docs: DataFrame) -> DataFrame:
    """A glyph for each blank-separated token of each line, on pages of 40 lines."""
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    toks = lines.select("doc_id", "source", "line_no", F.posexplode(F.split("line", " ", -1)).alias("tok_no", "s"))
    w = Window.partitionBy("doc_id", "line_no").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, -1)
    toks = toks.withColumn("offset", F.coalesce(F.sum(F.length("s") + 1).over(w), F.lit(0))).where("s <> ''")
    num = lambda c: F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    return toks.select(
        "doc_id",
        (F.floor(F.col("line_no") / PAGE_LINES) + 1).cast("int").alias("page_no"),
        (F.col("line_no").cast("long") * 1000000 + F.col("tok_no")).alias("seq"),
        "s",
        F.col("source").alias("font"),
        F.lit(float(HEIGHT)).alias("font_size"),
        num(LEFT + ADVANCE * F.col("offset")).alias("x"),
        num(TOP - LEADING * (F.col("line_no") % PAGE_LINES)).alias("y"),
        num(ADVANCE * F.length("s")).alias("w"),
        F.lit(float(HEIGHT)).alias("h"),
        F.lit(0.0).alias("rotation"),
        F.lit("tounicode").alias("enc_source"),
        "line_no",
        "tok_no",
    )


#: The same glyphs for DuckDB, as a chain of common table expressions that ends with ``g``.
GLYPHS_SQL = """
l AS (SELECT doc_id, source, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line
      FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, source, line_no, generate_subscripts(a, 1) - 1 AS tok_no, unnest(a) AS s
      FROM (SELECT doc_id, source, line_no, string_split(line, ' ') AS a FROM l)),
o AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM k),
g AS (SELECT doc_id, (line_no // 40 + 1)::INT AS page_no, line_no * 1000000 + tok_no AS seq, s, source AS font, line_no, tok_no,
             (72 + 6 * ofs)::DOUBLE AS x, (760 - 18 * (line_no % 40))::DOUBLE AS y, (6 * length(s))::DOUBLE AS w
      FROM o WHERE s <> '')
"""

#: Words of ``g``: every line is one band.
WORDS_SQL = (
    GLYPHS_SQL
    + """,
b AS (SELECT *, CASE WHEN max(x + w) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL
                       OR x - max(x + w) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > greatest(w * 0.3, 12 * 0.15) THEN 1 ELSE 0 END AS brk FROM g),
n AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) - 1 AS word_no FROM b),
words AS (SELECT doc_id, page_no, line_no, word_no::INT AS word_no, string_agg(s, '' ORDER BY tok_no) AS s, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, any_value(font) AS font
      FROM n GROUP BY doc_id, page_no, line_no, word_no)
"""
)


def event_points(events: DataFrame) -> DataFrame:
    """(page, seq, x, s): events as points on their user's axis, in microseconds."""
    return events.select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("x"), F.col("event_type").alias("s"))


def price_points(lineitem: DataFrame) -> DataFrame:
    """(grp, seq, at, order_no, line_no): extended prices as positions on their supplier's axis."""
    return lineitem.select(F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("at"), F.col("l_orderkey").alias("order_no"))


def ship_intervals(lineitem: DataFrame) -> DataFrame:
    """(grp, seq, lo, hi): days from shipping on, as many as the quantity, on the supplier's axis."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return lineitem.select(F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), day.alias("lo"), (day + F.col("l_quantity").cast("long")).alias("hi"))


SHIP_SQL = """(SELECT l_suppkey AS grp, l_orderkey * 10 + l_linenumber AS seq, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS lo,
 date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS hi FROM lineitem)"""


def _pdf(lines: list[str]) -> bytes:
    """A file with forty lines a page, set by a simple font in compressed content."""
    import zlib

    pages = [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)]
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    widths = " ".join(["500"] * 224)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>".encode(), f"<< /Type /Font /Subtype /TrueType /BaseFont /Body /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [{widths}] >>".encode()]
    for i, page in enumerate(pages):
        runs = [b"(" + line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")" for line in page]
        body = zlib.compress(b"BT /F1 12 Tf 18 TL 72 760 Td " + b" Tj ".join(runs[:1]) + b" Tj " + b"".join(r + b" ' " for r in runs[1:]) + b"ET", 1)
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * i} 0 R >>".encode(), f"<< /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream"]
    out, at = bytearray(b"%PDF-1.4\n"), []
    for n, o in enumerate(objects, 1):
        at.append(len(out))
        out += f"{n} 0 obj\n".encode() + o + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{a:010d} 00000 n \n".encode() for a in at)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())


def document_files(docs: DataFrame) -> DataFrame:
    """(path, content): each document as a PDF file."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("path"), pa.array([_pdf(t.split("\n")) for t in batch.column("text").to_pylist()], pa.binary())], ["path", "content"])

    return docs.select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text")).repartition("path").mapInArrow(run, "path string, content binary")
