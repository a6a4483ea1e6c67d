"""Registered queries over files of many forms, made of the driver's documents and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import export, layout, quality, structure
from pagemill.plans import files as W
from pagemill.plans import projections as P
from pagemill.plans.catalogue import query
from pagemill.plans.projections import table
from pagemill.sources import pdf

_LINES = "l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))"
_PAGES = f"{_LINES}, p AS (SELECT doc_id, i // 40 AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id, i // 40)"


def _texts(spark: SparkSession, sf_dir: str, make, passwords: tuple[str, ...] = ()) -> DataFrame:
    """(path, page_no, text, text_error) of documents as files that ``make`` makes."""
    pages = pdf.parse(W.files(table(spark, sf_dir, "documents"), make), "page", passwords)
    return pages.select("path", "page_no", F.md5("text").alias("text"), "text_error")


def _pages_sql(form: str, more: str = "text") -> str:
    return f"WITH {_PAGES} SELECT doc_id::VARCHAR AS path, (page + 1)::INT AS page_no, md5({more}) AS text, NULL::VARCHAR AS text_error, ({form})::INT AS form FROM p"


@query(_pages_sql("doc_id % 4"))
def q_pdf_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6 to 9, 11, 13: object and cross-reference streams, revisions, hybrid files, deep page trees."""
    return _texts(spark, sf_dir, lambda d, lines: W.contained(lines, d % 4)).withColumn("form", (F.col("path").cast("long") % 4).cast("int"))


@query(_pages_sql("doc_id % 6"))
def q_pdf_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1 to 8: contents behind LZW, base 85, hexadecimal, run lengths, and both kinds of predictors."""

    def make(d: int, lines: list[str]) -> bytes:
        return W.classic(W.page_objects(lines, lambda page, i: W.filtered(W.set_lines(page), d % 6)))

    return _texts(spark, sf_dir, make).withColumn("form", (F.col("path").cast("long") % 6).cast("int"))


def _lock(d: int) -> int:
    """The newest revision's key takes many rounds, so few files have it."""
    return 4 if d % 500 == 4 else (0, 1, 2, 3, 5)[d % 5]


@query(_pages_sql("CASE WHEN doc_id % 500 = 4 THEN 4 ELSE [0, 1, 2, 3, 5][(doc_id % 5 + 1)::INT] END"))
def q_pdf_encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3, CRY-1 to 5: files under passwords, by RC4 and AES, with keys of each size, and one that crypt filters leave plain."""
    got = _texts(spark, sf_dir, lambda d, lines: W.encrypted(lines, _lock(d)), ("wrong", W.PASSWORD, W.OWNER))
    d = F.col("path").cast("long")
    form = F.when(d % 500 == 4, 4).otherwise(F.element_at(F.array(*map(F.lit, (0, 1, 2, 3, 5))), (d % 5 + 1).cast("int")))
    return got.withColumn("form", form)


def _plain(lines: list[str]) -> list[str]:
    """Lines of ASCII with full-width digits, which legacy charsets hold."""
    wide = {48 + i: 0xFF10 + i for i in range(10)}
    return ["".join(c if " " <= c <= "~" else "?" for c in line).translate(wide) for line in lines]


def _fonted(d: int, lines: list[str]) -> bytes:
    form, which = d % 7, d // 7
    return W.in_font(_plain(lines) if form in (4, 5) else lines, form, which % 4 if form == 4 else which % 2)


_WIDE = "translate(array_to_string(list_transform(string_split(line, ''), lambda c: CASE WHEN c >= ' ' AND c <= '~' THEN c ELSE '?' END), ''), '0123456789', '０１２３４５６７８９')"
_FONT_LINES = f"{_LINES.replace('l AS', 'r AS', 1)}, l AS (SELECT doc_id, i, CASE WHEN doc_id % 7 IN (4, 5) THEN {_WIDE} ELSE line END AS line FROM r)"
_SOURCES = ("tounicode", "tounicode", "differences", "ucs2", "predefined", "cidmap", "encoding")


@query(
    f"""WITH {_FONT_LINES}, p AS (SELECT doc_id, i // 40 AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id, i // 40)
SELECT doc_id::VARCHAR AS path, (page + 1)::INT AS page_no, md5(text) AS text, NULL::VARCHAR AS text_error, (doc_id % 7)::INT AS form FROM p"""
)
def q_pdf_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-1 to 9, INT-5: text set in fonts with maps, glyph names, two-byte codes, legacy charsets, and a character collection."""
    return _texts(spark, sf_dir, _fonted).withColumn("form", (F.col("path").cast("long") % 7).cast("int"))


@query(
    f"""WITH {_FONT_LINES}
SELECT doc_id::VARCHAR AS path, {list(_SOURCES)}[(doc_id % 7 + 1)::INT] AS enc_source, sum(length(line))::BIGINT AS n, max(72 + 6 * length(line) - 6)::DOUBLE AS last_x FROM l WHERE line <> '' GROUP BY doc_id"""
)
def q_pdf_font_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-14, INT-3, 5: where the same files' characters come from, and how far their widths reach."""
    g = pdf.parse(W.files(table(spark, sf_dir, "documents"), _fonted), "glyph")
    return g.groupBy("path", "enc_source").agg(F.count("*").alias("n"), F.round(F.max("x"), 6).alias("last_x"))


@query(
    f"""WITH {_LINES}
SELECT doc_id::VARCHAR AS path, (i // 40 + 1)::INT AS page_no, (760 - 18 * (i % 40))::DOUBLE AS y, length(replace(line, ' ', ''))::BIGINT AS n, (72 + 6 * (length(line) - length(ltrim(line, ' '))))::DOUBLE AS x,
       (66 + 6 * length(rtrim(line, ' ')))::DOUBLE AS last_x, 0.0::DOUBLE AS rotation, md5(replace(line, ' ', '')) AS s, (length(line) - length(replace(line, ' ', '')) + 1)::BIGINT AS n_breaks
FROM l WHERE replace(line, ' ', '') <> ''"""
)
def q_pdf_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INT-1, 3, 6, 7, 10, 11: pages turned by quarters, drawn by forms with matrices, with kerns for blanks."""
    g = pdf.baselines(W.files(table(spark, sf_dir, "documents"), lambda d, lines: W.turned(lines, d % 4 * 90)))
    at = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return g.where("n > 0").select("path", "page_no", "y", "n", at("x"), at("last_x"), at("rotation"), F.md5("s").alias("s"), "n_breaks")


@query(f"WITH {_PAGES} SELECT doc_id::VARCHAR AS path, md5(string_agg(text, '' ORDER BY page)) AS text, NULL::VARCHAR AS text_error FROM p GROUP BY doc_id")
def q_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INT-13: the text of whole files."""
    pages = pdf.parse(P.document_files(table(spark, sf_dir, "documents")), "page")
    return export.document_text(pages, "path").select("path", F.md5("text").alias("text"), "text_error")


def _structured(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    return pdf.parse(W.files(table(spark, sf_dir, "documents"), W.structured), relation)


_NODES = "l AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS k FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), d AS (SELECT *, (k + 39) // 40 AS n FROM l), p AS (SELECT doc_id, n, unnest(range(n)) AS i FROM d)"


@query(
    f"""WITH {_NODES}
SELECT doc_id::VARCHAR AS path, 'link' AS kind, (i + 1)::INT AS place, ((i + 1) % n + 1)::VARCHAR AS value FROM p
UNION ALL SELECT doc_id::VARCHAR, 'address', (i + 1)::INT, 'http://x/' || doc_id || '/' || i FROM p
UNION ALL SELECT doc_id::VARCHAR, 'outline', (i + 1)::INT, '0 page ' || i FROM p
UNION ALL SELECT doc_id::VARCHAR, 'outline', (i + 1)::INT, '1 é' || i FROM p
UNION ALL SELECT doc_id::VARCHAR, 'label', (i + 1)::INT, CASE i WHEN 0 THEN 'i' WHEN 1 THEN 'ii' ELSE 'A-' || (i + 1) END FROM p
UNION ALL SELECT doc_id::VARCHAR, 'field', (i + 1)::INT, 'form.f' || i || '=v' || doc_id FROM p
UNION ALL SELECT doc_id::VARCHAR, 'file', 0, 'ü' || doc_id % 10 || ' text/plain ' || md5(text) FROM d
UNION ALL SELECT doc_id::VARCHAR, 'title', 0, doc_id::VARCHAR FROM d
UNION ALL SELECT doc_id::VARCHAR, 'created', 0, '2024-01-02 03:04:05' FROM d
UNION ALL SELECT doc_id::VARCHAR, 'metadata', 0, '<x:xmpmeta id=''' || doc_id || '''/>' FROM d"""
)
def q_pdf_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1 to 7, 9 to 13: links, addresses, outline, labels, fields, attachments, information and metadata of files."""
    from pagemill.functions.text import pdf_date

    of = lambda relation: _structured(spark, sf_dir, relation)
    row = lambda df, kind, place, value: df.select("path", F.lit(kind).alias("kind"), place.cast("int").alias("place"), value.alias("value"))
    notes, nodes, fields, attached, docs = (of(r) for r in ("annotation", "outline_node", "form_field", "attachment", "document"))
    page = F.col("page_no")
    link = F.col("type") == "Link"
    labels = structure.page_labels(of("page").withColumnRenamed("path", "doc_id"), of("label_range").withColumnRenamed("path", "doc_id")).withColumnRenamed("doc_id", "path")
    value = structure.field_value(structure.field_type(F.col("ft"), F.col("ff")), F.col("v"))
    parts = [
        row(notes.where(link & F.col("uri").isNull()), "link", page, F.col("to_page").cast("string")),
        row(notes.where(link & F.col("uri").isNotNull()), "address", page, F.col("uri")),
        row(nodes, "outline", page, F.concat_ws(" ", F.col("depth").cast("string"), "title")),
        row(labels, "label", page, F.col("label")),
        row(fields, "field", page, F.concat_ws("=", "name", value)),
        row(structure.attachment_names(attached), "file", F.lit(0), F.concat_ws(" ", "name", "mime", F.md5("data"))),
        row(docs, "title", F.lit(0), F.col("info")["Title"]),
        row(docs, "created", F.lit(0), F.date_format(pdf_date(F.col("info")["CreationDate"]), "yyyy-MM-dd HH:mm:ss")),
        row(docs, "metadata", F.lit(0), F.decode("xmp", "utf-8")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    f"""WITH {_NODES}
SELECT doc_id::VARCHAR AS path, 'dictionary' AS kind, (n + 3)::BIGINT AS n, 0::BIGINT AS n_empty FROM d
UNION ALL SELECT doc_id::VARCHAR, 'stream', (n + 2)::BIGINT, 0::BIGINT FROM d"""
)
def q_pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-8, 14: the objects of files that keep most of them in an object stream."""
    o = pdf.parse(W.files(table(spark, sf_dir, "documents"), lambda d, lines: W.contained(lines, 0)), "object")
    return o.groupBy("path", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("value").isin("{}", "")).alias("n_empty"))


_ITEMS = "i AS (SELECT l_suppkey AS grp, l_linenumber * 10 AS x, l_orderkey % 700 AS y, l_quantity::BIGINT AS w, l_partkey % 50 + 1 AS h FROM lineitem)"


@query(
    f"""WITH {_ITEMS}
SELECT grp::VARCHAR AS path, 'rect' AS kind, count(*) AS n, sum(2 * x + 10)::DOUBLE AS a, sum(2 * y + 20)::DOUBLE AS b, sum(2 * (x + w) + 10)::DOUBLE AS c, sum(2 * (y + h) + 20)::DOUBLE AS d FROM i GROUP BY grp
UNION ALL SELECT grp::VARCHAR, 'stroke', count(*), sum(2 * x + 10)::DOUBLE, sum(2 * y + 20)::DOUBLE, sum(2 * (x + w) + 10)::DOUBLE, sum(2 * y + 20)::DOUBLE FROM i GROUP BY grp
UNION ALL SELECT grp::VARCHAR, 'image', 2 * count(*), sum(2 * x + 10)::DOUBLE * 2, sum(2 * y + 20)::DOUBLE * 2, sum(2 * w)::DOUBLE * 2, sum(2 * h)::DOUBLE * 2 FROM i GROUP BY grp"""
)
def q_pdf_graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INT-7 to 9, 14: a supplier's items as rectangles, strokes, and images both named and inline, on a page scaled by two."""
    li = table(spark, sf_dir, "lineitem")
    num = lambda c: c.cast("long").cast("string")
    x, y, w, h = F.col("l_linenumber") * 10, F.col("l_orderkey") % 700, F.col("l_quantity"), F.col("l_partkey") % 50 + 1
    at, wide, high = F.concat_ws(" ", num(x), num(y)), num(w), num(h)
    drawn = F.concat_ws(" ", at, wide, high, F.lit("re f"), at, F.lit("m"), num(x + w), num(y), F.lit("l S q"), wide, F.lit("0 0"), high, at, F.lit("cm /Im Do BI /W 1 /H 1 ID x EI Q"))
    sheets = li.groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.array_join(F.collect_list(drawn), "\n").alias("text"))

    def make(d: int, lines: list[str]) -> bytes:
        content = ("2 0 0 2 10 20 cm\n" + "\n".join(lines)).encode()
        image = W.stream(b"\0", "/Type /XObject /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /DCTDecode")
        objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>", 5: image}
        return W.classic(objects | {3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /XObject << /Im 5 0 R >> >> >>", 4: W.flat(content)})

    files = W.files(sheets, make)
    kinds = (("rect", "rect", ("min_x", "min_y", "max_x", "max_y")), ("stroke", "stroke", ("x0", "y0", "x1", "y1")), ("image", "image_draw", ("x", "y", "w", "h")))
    drawn = pdf.parse_drawn(files, tuple(relation for _, relation, _ in kinds))
    of = lambda i: F.coalesce(*[F.when(F.col("relation") == relation, F.col(columns[i])) for _, relation, columns in kinds])
    name = F.coalesce(*[F.when(F.col("relation") == relation, kind) for kind, relation, _ in kinds])
    return drawn.groupBy("path", name.alias("kind")).agg(F.count("*").alias("n"), *[F.sum(of(i)).alias(to) for i, to in enumerate("abcd")])


# layout in columns

_SHEETS = "c AS (SELECT c_custkey // 40 AS doc_id, c_custkey % 40 AS row, string_split(c_name, '#')[1] || ' ' || string_split(c_name, '#')[2] AS a, c_mktsegment || ' ' || floor(c_acctbal)::BIGINT AS b FROM customer)"


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on sheets of forty: names to the left of a gutter, segments and balances to the right, a glyph for each character."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    side = lambda i, x, s: F.struct(F.lit(i).alias("side"), F.lit(x).cast("double").alias("x0"), s.alias("text"))
    sides = F.array(side(0, 40, F.concat_ws(" ", F.split("c_name", "#")[0], F.split("c_name", "#")[1])), side(1, 330, F.concat_ws(" ", "c_mktsegment", F.floor("c_acctbal").cast("string"))))
    g = c.select(F.floor(k / 40).alias("doc_id"), (k % 40).alias("row"), F.inline(sides)).select("*", F.posexplode(F.split("text", "")).alias("i", "s")).where("s <> ' ' and s <> ''")
    lit = lambda v, name: F.lit(v).alias(name)
    return g.select("doc_id", lit(1, "page_no"), (F.col("row") * 1000 + F.col("side") * 500 + F.col("i")).alias("seq"), "s", lit("F", "font"), lit(10.0, "font_size"), (F.col("x0") + F.col("i") * 5).alias("x"), (F.lit(760.0) - F.col("row") * 14).alias("y"), lit(5.0, "w"), lit(10.0, "h"), lit(0.0, "rotation"), lit("tounicode", "enc_source"))


@query(
    f"""WITH {_SHEETS}
SELECT doc_id, 0 AS column_no, (760 - row * 14)::DOUBLE AS y, a AS s, 40.0::DOUBLE AS x, 2::BIGINT AS n_words FROM c UNION ALL SELECT doc_id, 1, (760 - row * 14)::DOUBLE, b, 330.0, 2 FROM c"""
)
def q_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-9 to 14: lines on either side of a gutter."""
    return layout.lines(layout.words(_sheets(spark, sf_dir))).select("doc_id", "column_no", "y", "s", "x", "n_words")


@query(
    f"""WITH {_SHEETS}
SELECT doc_id, 0 AS column_no, string_agg(a, chr(10) ORDER BY row) AS s, count(*) AS n_lines FROM c GROUP BY doc_id UNION ALL SELECT doc_id, 1, string_agg(b, chr(10) ORDER BY row), count(*) FROM c GROUP BY doc_id"""
)
def q_column_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-11, 12, 15: a block for each column."""
    return layout.blocks(layout.lines(layout.words(_sheets(spark, sf_dir)))).select("doc_id", "column_no", "s", "n_lines")
