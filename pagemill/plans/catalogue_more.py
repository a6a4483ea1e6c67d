"""Registered queries of text, structure, table and export operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import export, layout, quality, seq, structure, tables
from pagemill.plans import projections as P
from pagemill.plans.catalogue import _PAGES_SQL, SQL, _glyphs, _routed, query
from pagemill.plans.projections import GLYPHS_SQL, SHIP_SQL, WORDS_SQL, table
from pagemill.sources import pdf

# text


@query(
    """SELECT doc_id, length(replace(replace(replace(text, 'ff', 'ﬀ'), 'fi', 'ﬁ'), 'st', 'ﬆ')) AS n_ligated, md5(text) AS folded FROM documents"""
)
def q_ligature_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-15: ligatures, set into the texts first, folded back."""
    d = table(spark, sf_dir, "documents")
    set_ = F.col("text")
    for a, b in (("ff", "ﬀ"), ("fi", "ﬁ"), ("st", "ﬆ")):
        set_ = F.replace(set_, F.lit(a), F.lit(b))
    return d.select("doc_id", set_.alias("t")).select("doc_id", F.length("t").cast("long").alias("n_ligated"), F.md5(T.fold_ligatures(F.col("t"))).alias("folded"))


@query(
    r"""SELECT conv_id, turn, regexp_matches(text, '\p{L}') AS has_letter, regexp_matches(text, '[\x{0900}-\x{0DFF}]') AS has_indic, regexp_matches(text, '\p{Latin}') AS has_latin,
regexp_matches(text, '^\p{Nd}+$') AS all_digits, regexp_matches(text, '^[\p{Han}\p{Hiragana}\p{Katakana}]') AS spaceless FROM conversations"""
)
def q_script_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-16: scripts of the turns of conversations."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.has_letter(t).alias("has_letter"), T.has_indic(t).alias("has_indic"), T.has_latin(t).alias("has_latin"), T.is_all_digits(t).alias("all_digits"), T.is_spaceless(t).alias("spaceless"))


@query(
    r"""WITH t AS (SELECT p_partkey, p_name || ' ..... ' || p_size AS spaced, replace(p_name, ' ', '....') AS fused, p_retailprice::VARCHAR AS price FROM part)
SELECT p_partkey, replace(spaced, ' .....', '') AS spaced, CASE WHEN regexp_matches(fused, '\p{L}\.{3,}\p{L}') THEN replace(fused, '.', '') ELSE fused END AS fused FROM t"""
)
def q_dot_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRD-6: dot leaders set between names and sizes, and taken out again."""
    p = table(spark, sf_dir, "part")
    spaced, fused = F.concat("p_name", F.lit(" ..... "), F.col("p_size").cast("string")), F.replace("p_name", F.lit(" "), F.lit("...."))
    return p.select("p_partkey", tables.without_leaders(spaced).alias("spaced"), tables.without_leaders(fused).alias("fused"))


@query(
    """SELECT o_orderkey, o_orderdate - INTERVAL 90 MINUTE AS at, o_orderdate::DATE::TIMESTAMP AS day, date_trunc('year', o_orderdate) AS year FROM orders"""
)
def q_pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12: dates written as date strings, with an offset, without a time, and with a year alone."""
    d = F.col("o_orderdate").cast("timestamp")
    ntz = lambda c: c.cast("timestamp_ntz")
    full, day, year = F.concat(F.lit("D:"), F.date_format(d, "yyyyMMddHHmmss"), F.lit("+01'30'")), F.concat(F.lit("D:"), F.date_format(d, "yyyyMMdd")), F.date_format(d, "yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", ntz(T.pdf_date(full)).alias("at"), ntz(T.pdf_date(day)).alias("day"), ntz(T.pdf_date(year)).alias("year"))


# quality


@query(
    f"""WITH {_PAGES_SQL},
w AS (SELECT doc_id, page_no, 'image_only' AS code, 'page has images' AS message, signal AS detail FROM signal WHERE n_images > 0
      UNION ALL SELECT doc_id, page_no, 'unmapped', 'characters without a mapping', CASE WHEN unmapped > 9 THEN 'many' ELSE 'few' END FROM c WHERE unmapped > 0
      UNION ALL SELECT doc_id, 0, 'degraded', 'a page could not be read', '' FROM signal WHERE signal = 'degraded'),
u AS (SELECT DISTINCT * FROM w), r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, code, detail, message) AS k FROM u)
SELECT doc_id, page_no, code, message, detail FROM r WHERE n <= 3 OR k < 3
UNION ALL SELECT doc_id, 0, 'truncated', 'more warnings were dropped', '' FROM r WHERE n > 3 AND k = 3"""
)
def q_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUA-8, 9: the set of a document's warnings, capped at three."""
    pages, glyphs = _routed(spark, sf_dir)
    signal = quality.page_signal(pages)
    lit = lambda code, message: [F.lit(code).alias("code"), F.lit(message).alias("message")]
    images = signal.where("n_images > 0").select("doc_id", "page_no", *lit("image_only", "page has images"), F.col("signal").alias("detail"))
    lost = quality.decode_counters(glyphs).where("unmapped > 0").select("doc_id", "page_no", *lit("unmapped", "characters without a mapping"), F.when(F.col("unmapped") > 9, "many").otherwise("few").alias("detail"))
    bad = signal.where("signal = 'degraded'").select("doc_id", F.lit(0).alias("page_no"), *lit("degraded", "a page could not be read"), F.lit("").alias("detail"))
    return quality.warning_set(images.unionByName(lost).unionByName(bad), cap=3)


@query(
    f"""WITH {GLYPHS_SQL},
e AS (SELECT doc_id, line_no, y, CASE WHEN length(s) <= 4 THEN (length(s) * 7)::VARCHAR ELSE s END AS t FROM g),
a AS (SELECT doc_id, line_no, count(*) AS n, bool_and(regexp_matches(t, '^[0-9.\\-/()\\[\\]–—]{{1,4}}$') AND (y <= 79.2 OR y + 12 >= 712.8)) AS ok, bool_or(regexp_matches(t, '[0-9]')) AS digit FROM e GROUP BY doc_id, line_no)
SELECT doc_id, line_no::INT AS page_no FROM a WHERE n <= 3 AND ok AND digit"""
)
def q_sparse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUA-7: lines as pages; tokens of up to four characters, as numbers, may be all that a page holds."""
    short = F.length("s") <= 4
    w = _glyphs(spark, sf_dir).select("doc_id", F.col("line_no").cast("int").alias("page_no"), F.when(short, (F.length("s") * 7).cast("string")).otherwise(F.col("s")).alias("s"), "y", "h")
    return quality.sparse_pages(w, F.lit(0.0), F.lit(792.0))


@query(
    f"""WITH {GLYPHS_SQL},
a AS (SELECT doc_id, line_no, bool_and(length(s) > 4) AS ok FROM g GROUP BY doc_id, line_no)
SELECT doc_id, line_no::INT AS page_no, 'image_only' AS code, 'page has images but no extractable text' AS message, '' AS detail FROM a WHERE ok"""
)
def q_routing_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUA-4, 6: lines as pages, and tokens of more than four characters as images; pages without words are warned of."""
    g = _glyphs(spark, sf_dir).withColumn("page_no", F.col("line_no").cast("int"))
    image = F.length("s") > 4
    boxes = g.select("doc_id", "page_no").distinct().withColumn("media_box", F.array(*map(F.lit, (0.0, 0.0, 612.0, 792.0))))
    summary = quality.page_summary(boxes, g.where(~image), g.where(image).select("doc_id", "page_no", "w", "h"))
    pages = g.groupBy("doc_id", "page_no").agg(F.array_join(F.collect_list(F.when(~image, F.col("s"))), " ").alias("text"), F.count_if(image).alias("n_images"), F.lit(None).cast("string").alias("text_error"), F.lit(False).alias("null_slot"))
    return quality.routing_warnings(pages, summary)


@query(
    f"""WITH {GLYPHS_SQL},
i AS (SELECT doc_id, page_no, count(*) AS n, sum(w * 12 * 20) AS area FROM g WHERE s LIKE '%|%' GROUP BY doc_id, page_no),
w AS (SELECT doc_id, page_no, count(*) AS n FROM g WHERE s NOT LIKE '%|%' GROUP BY doc_id, page_no),
p AS (SELECT DISTINCT doc_id, page_no FROM g)
SELECT doc_id, page_no, coalesce(w.n, 0) > 0 AS has_text, coalesce(w.n, 0) AS word_count, coalesce(i.n, 0) AS image_count, least(1.0, coalesce(area, 0) / 484704.0) AS coverage
FROM p LEFT JOIN i USING (doc_id, page_no) LEFT JOIN w USING (doc_id, page_no)"""
)
def q_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUA-4, 5: words, images and their coverage; tokens with | stand for images."""
    g = _glyphs(spark, sf_dir)
    image = F.col("s").contains("|")
    pages = g.select("doc_id", "page_no").distinct().withColumn("media_box", F.array(*map(F.lit, (0.0, 0.0, 612.0, 792.0))))
    images = g.where(image).select("doc_id", "page_no", "w", (F.col("h") * 20).alias("h"))
    return quality.page_summary(pages, g.where(~image), images)


# structure


@query(
    """WITH p AS (SELECT o_custkey AS doc_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS page_no FROM orders),
r AS (SELECT c_custkey AS doc_id, n_nationkey * 2 AS start, n_nationkey AS ordinal, n_name AS prefix, n_nationkey % 6 AS style FROM customer JOIN nation ON n_nationkey % 5 = c_custkey % 5),
j AS (SELECT p.doc_id, p.page_no, r.start + 1 AS frm, r.prefix, r.style, p.page_no - r.start AS n FROM p ASOF LEFT JOIN r ON p.doc_id = r.doc_id AND p.page_no >= r.start + 1)
SELECT doc_id, page_no, CASE WHEN frm IS NULL THEN page_no::VARCHAR
  WHEN style = 1 THEN prefix || n WHEN style = 4 THEN prefix || repeat(chr((65 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::INT)
  WHEN style = 5 THEN prefix || repeat(chr((97 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::INT)
  WHEN style IN (2, 3) THEN prefix || (CASE WHEN style = 2 THEN upper(x) ELSE x END) ELSE prefix END AS label
FROM (SELECT *, repeat('x', (n // 10)::INT) || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][(n % 10 + 1)::INT] AS x FROM j)"""
)
def q_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-7: a customer's orders as pages, labelled by ranges that nations give."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    pages = orders.select(F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page_no"))
    style = F.element_at(F.array(*map(F.lit, ("", "D", "R", "r", "A", "a"))), F.col("n_nationkey") % 6 + 1)
    ranges = customer.join(nation, F.col("n_nationkey") % 5 == F.col("c_custkey") % 5).select(F.col("c_custkey").alias("doc_id"), (F.col("n_nationkey") * 2).alias("start"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("prefix"), style.alias("style"), F.lit(None).cast("int").alias("st"))
    return structure.page_labels(pages, ranges)


@query(
    f"""WITH {GLYPHS_SQL}
SELECT doc_id // 50 AS doc_id, font AS name, arg_min(CASE WHEN length(s) % 2 = 0 THEN 'Type0' ELSE 'TrueType' END, doc_id * 1000000000 + seq) AS subtype, bool_or(length(s) > 14) AS embedded,
       array_to_string(list_sort(list(DISTINCT page_no)), ',') AS pages, min(doc_id * 1000000000 + seq) AS first_seq FROM g GROUP BY doc_id // 50, font"""
)
def q_font_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-8: fonts of documents, fifty taken as one; a source stands for a font."""
    g = _glyphs(spark, sf_dir)
    uses = g.select(F.floor(F.col("doc_id") / 50).alias("doc_id"), F.col("font").alias("name"), F.when(F.length("s") % 2 == 0, "Type0").otherwise("TrueType").alias("subtype"), (F.length("s") > 14).alias("embedded"), "page_no", (F.col("doc_id") * 1000000000 + F.col("seq")).alias("seq"))
    return structure.font_inventory(uses).withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query(
    """WITH f AS (SELECT p_partkey, ['Btn', 'Ch', 'Tx', 'Sig'][(p_partkey % 4 + 1)::INT] AS ft, (p_size % 8) * 32768 + p_size % 2 AS ff, CASE WHEN p_size % 3 = 0 THEN '' ELSE replace(p_name, ' ', ', ') END AS v FROM part),
k AS (SELECT *, CASE ft WHEN 'Btn' THEN CASE WHEN ff & 65536 <> 0 THEN 'button' WHEN ff & 32768 <> 0 THEN 'radio' ELSE 'checkbox' END WHEN 'Ch' THEN CASE WHEN ff & 131072 <> 0 THEN 'combo' ELSE 'list' END WHEN 'Tx' THEN 'text' ELSE 'unknown' END AS kind FROM f)
SELECT p_partkey, kind, ff & 1 = 1 AS read_only, CASE WHEN kind IN ('checkbox', 'radio') AND v = '' THEN 'Off' ELSE v END AS value FROM k"""
)
def q_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10: kinds and values of form fields that parts give."""
    ft = F.element_at(F.array(*map(F.lit, ("Btn", "Ch", "Tx", "Sig"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    ff = (F.col("p_size") % 8) * 32768 + F.col("p_size") % 2
    f = table(spark, sf_dir, "part").select("p_partkey", structure.field_type(ft, ff).alias("kind"), (ff.bitwiseAND(F.lit(structure.READ_ONLY)) != 0).alias("read_only"), F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.split("p_name", " ")).alias("v"))
    return f.select("p_partkey", "kind", "read_only", structure.field_value(F.col("kind"), F.col("v")).alias("value"))


@query(
    """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name FROM pages),
n AS (SELECT doc, name, min(page_id) AS obj FROM (SELECT page_id, page_id // 25 AS doc, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) || CASE WHEN page_id % 3 = 0 THEN '' ELSE '!' END AS name FROM pages) GROUP BY doc, name)
SELECT page_id // 25 AS doc_id, page_id AS from_page, count(*) AS n, count(obj) AS n_resolved, sum(obj)::BIGINT AS to_sum FROM a LEFT JOIN n ON n.doc = a.page_id // 25 AND n.name = a.name GROUP BY page_id"""
)
def q_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1, 2, 3, 4: links by named destination, of which the first entry holds; other pages' names are not asked for, and unresolved ones stay."""
    p = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 25).alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("i", "name"))
    notes = p.select("doc_id", F.col("page_id").alias("page_no"), F.col("i").alias("ordinal"), F.lit("Link").alias("type"), F.lit(None).cast("string").alias("uri"), F.col("name").alias("dest_name"), F.lit(None).cast("long").alias("dest_obj"))
    other = F.when(F.col("page_id") % 3 == 0, F.col("name")).otherwise(F.concat("name", F.lit("!")))
    dests = p.select("doc_id", F.lit("Dests").alias("tree"), F.col("page_id").alias("ordinal"), other.alias("name"), F.col("page_id").alias("dest_obj"))
    where = p.select("doc_id", F.col("page_id").alias("obj"), F.col("page_id").alias("page_no")).distinct()
    return structure.links(notes, dests, where).groupBy("doc_id", "from_page").agg(F.count("*").alias("n"), F.count("to_page").alias("n_resolved"), F.sum("to_page").alias("to_sum"))


@query(
    """WITH RECURSIVE n AS (SELECT p_brand AS doc_id, p_partkey AS node_id, CASE WHEN r = 1 THEN NULL ELSE first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) END AS top, r, p_partkey, p_name AS title
       FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)),
m AS (SELECT a.doc_id, a.node_id, b.node_id AS parent_id, a.title FROM n a LEFT JOIN n b ON a.doc_id = b.doc_id AND b.r = a.r // 2),
t AS (SELECT doc_id, node_id, 0 AS depth, title AS path FROM m WHERE parent_id IS NULL
      UNION ALL SELECT m.doc_id, m.node_id, t.depth + 1, t.path || '.' || m.title FROM t JOIN m ON m.doc_id = t.doc_id AND m.parent_id = t.node_id)
SELECT doc_id, node_id, depth, path FROM t"""
)
def q_outline_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5, 6, 9: paths of a tree of nodes; a brand's parts are a heap."""
    n = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("node_id"), F.col("p_name").alias("title"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("r"))
    up = n.select(F.col("doc_id").alias("d"), F.col("node_id").alias("parent_id"), F.col("r").alias("up"))
    nodes = n.join(up, (F.col("doc_id") == F.col("d")) & (F.floor(F.col("r") / 2) == F.col("up")), "left").select("doc_id", "node_id", "parent_id", "title")
    return structure.tree_paths(nodes)


# tables


def _ship_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a supplier's sheet: shipments in two directions."""
    i = P.ship_intervals(table(spark, sf_dir, "lineitem"))
    return i.select("grp", F.when(F.col("seq") % 2 == 0, "h").otherwise("v").alias("orient"), (F.col("seq") % 997).cast("double").alias("at"), (F.col("lo") % 500).cast("double").alias("lo"), (F.col("lo") % 500 + F.col("hi") - F.col("lo")).cast("double").alias("hi"))


_EDGES_SQL = f"e AS (SELECT grp, CASE WHEN seq % 2 = 0 THEN 'h' ELSE 'v' END AS orient, (seq % 997)::DOUBLE AS pos, (lo % 500)::DOUBLE AS lo, (lo % 500 + hi - lo)::DOUBLE AS hi FROM {SHIP_SQL})"


@query(
    f"""WITH {_EDGES_SQL}
SELECT v.grp, round(v.pos, 2) AS x, round(h.pos, 2) AS top, count(*) AS n FROM e v JOIN e h ON v.grp = h.grp AND v.orient = 'v' AND h.orient = 'h'
 AND h.pos BETWEEN v.lo - 3 AND v.hi + 3 AND v.pos BETWEEN h.lo - 3 AND h.hi + 3 GROUP BY v.grp, v.pos, h.pos"""
)
def q_edge_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TAB-4: crossings of a sheet's edges."""
    return tables.crossings(_ship_edges(spark, sf_dir), ("grp",)).groupBy("grp", "x", "top").agg(F.count("*").alias("n"))


@query(
    f"""WITH i AS (SELECT grp, min(lo) AS lo, max(hi) AS hi, row_number() OVER (PARTITION BY grp ORDER BY min(lo)) AS cell_no FROM {SHIP_SQL} GROUP BY grp, lo // 30),
w AS (SELECT DISTINCT grp, lo + (hi - lo) / 2.0 AS cx FROM {SHIP_SQL})
SELECT grp, cell_no, count(*) AS n FROM (SELECT w.grp, cx, min(cell_no) AS cell_no FROM w JOIN i ON w.grp = i.grp AND cx BETWEEN lo AND hi GROUP BY w.grp, cx) GROUP BY grp, cell_no"""
)
def q_word_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRD-3: shipments' middles in cells of thirty days; the first cell that holds one has it."""
    i = P.ship_intervals(table(spark, sf_dir, "lineitem"))
    g = i.groupBy("grp", F.floor(F.col("lo") / 30).alias("m")).agg(F.min("lo").alias("x0"), F.max("hi").alias("x1"))
    cells = g.select("grp", F.row_number().over(Window.partitionBy("grp").orderBy("x0")).alias("cell_no"), "x0", "x1", F.lit(0.0).alias("top"), F.lit(1.0).alias("bottom"))
    words = i.select("grp", (F.col("lo") + (F.col("hi") - F.col("lo")) / 2).alias("x0")).distinct().select("grp", "x0", F.col("x0").alias("x1"), F.lit(0.5).alias("top"), F.lit(0.5).alias("bottom"), F.col("x0").alias("word_id"))
    return tables.cells_of_words(words, cells, ("grp",)).groupBy("grp", "cell_no").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT l_suppkey AS grp, l_orderkey AS k, l_extendedprice AS pos FROM lineitem),
m AS (SELECT DISTINCT grp, pos FROM p WHERE k % 2 = 0), q AS (SELECT DISTINCT grp, pos FROM p WHERE k % 2 = 1)
SELECT grp, pos AS at, CASE WHEN pos - l <= 4 THEN l END AS left_at FROM (SELECT m.grp, m.pos, max(q.pos) AS l FROM m LEFT JOIN q ON q.grp = m.grp AND q.pos <= m.pos GROUP BY m.grp, m.pos)"""
)
def q_nearest_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRD-4's core: the nearest placed position to the left."""
    p = P.price_points(table(spark, sf_dir, "lineitem"))
    side = lambda odd: p.where(F.col("order_no") % 2 == odd).select("grp", "at").distinct()
    return tables.nearest_left(side(0), side(1).withColumn("tie", F.col("at")), ["grp"], "at", "tie")


@query(
    """WITH c AS (SELECT l_orderkey AS t, l_linenumber AS r, unnest([0, 1, 2, 3]) AS col, unnest([l_returnflag, CASE WHEN l_discount > 0.08 THEN l_linestatus ELSE '' END, '', CASE WHEN l_tax > 0.07 THEN 'x' ELSE ' ' END]) AS text FROM lineitem),
b AS (SELECT t, col, bool_and(trim(text) = '') AS blank, count(DISTINCT r) AS rows FROM c GROUP BY t, col)
SELECT t, max(rows) AS n_rows, count(*) AS n_cols, count(*) FILTER (blank) AS n_blank, count(*) FILTER (blank) / count(*) >= 0.6 AS phantom, CASE WHEN count(*) FILTER (blank) / count(*) >= 0.6 THEN 'low' ELSE 'high' END AS confidence FROM b GROUP BY t"""
)
def q_grid_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRD-11, 13: orders as grids of lines, doubtful where most columns are blank."""
    li = table(spark, sf_dir, "lineitem")
    cell = lambda i, t: F.struct(F.lit(i).alias("col"), t.alias("text"))
    row = F.array(cell(0, F.col("l_returnflag")), cell(1, F.when(F.col("l_discount") > 0.08, F.col("l_linestatus")).otherwise("")), cell(2, F.lit("")), cell(3, F.when(F.col("l_tax") > 0.07, "x").otherwise(" ")))
    return tables.grid_quality(li.select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("row"), F.inline(row)), ["t"])


@query(
    """WITH c AS (SELECT l_orderkey AS t, unnest([0, 1, 2]) AS col, unnest([0.0, 100.0, 104.0 + l_quantity]) AS x0, unnest([100.0, 104.0 + l_quantity, 300.0]) AS x1, unnest([l_returnflag, '', l_linestatus]) AS text FROM lineitem),
k AS (SELECT t, col, min(x0) AS x0, max(x1) AS x1, bool_and(text = '') AS blank FROM c GROUP BY t, col), m AS (SELECT t, median(x1 - x0) AS mid FROM k WHERE NOT blank GROUP BY t)
SELECT t, col, blank AND ((x1 - x0 > 0 AND x1 - x0 < 16 AND x1 - x0 < 0.25 * mid) OR EXISTS (SELECT 1 FROM k f WHERE f.t = k.t AND NOT f.blank AND k.x0 <= f.x0 + 4 AND k.x1 >= f.x1 - 4 AND k.x1 - k.x0 > f.x1 - f.x0)) AS gutter FROM k JOIN m USING (t)"""
)
def q_gutter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRD-7: blank columns that are gutters; a line's quantity is the width of one."""
    q = F.col("l_quantity") + 104
    cell = lambda i, a, b, t: F.struct(F.lit(i).alias("col"), a.cast("double").alias("x0"), b.cast("double").alias("x1"), t.alias("text"))
    row = F.array(cell(0, F.lit(0), F.lit(100), F.col("l_returnflag")), cell(1, F.lit(100), q, F.lit("")), cell(2, q, F.lit(300), F.col("l_linestatus")))
    return tables.gutter_columns(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), F.inline(row)), ["t"]).select("t", "col", "gutter")


# export


@query(
    """WITH l AS (SELECT doc_id, source, lang, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS line, len(a) AS n FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS a FROM documents)),
p AS (SELECT doc_id, any_value(source) AS source, any_value(lang) AS lang, i // 40 AS page, max((n + 39) // 40) AS total_pages, string_agg(line, chr(10) ORDER BY i) AS content FROM l GROUP BY doc_id, i // 40)
SELECT p.doc_id, page::INT AS page, (page + 1)::VARCHAR AS page_label, total_pages::INT AS total_pages, CASE WHEN trim(content) <> '' THEN 'text' ELSE 'empty' END AS signal, source, lang, content, quality FROM p LEFT JOIN labels USING (doc_id)"""
)
def q_rag_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-3: a row for each page with what a retrieval index needs."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.split("text", "\n", -1).alias("a"))
    n = F.ceil(F.size("a") / P.PAGE_LINES).cast("int")
    pages = d.select("doc_id", "source", "lang", n.alias("total_pages"), F.explode(F.sequence(F.lit(0), n - 1)).alias("page"), "a")
    pages = pages.select("doc_id", "source", "lang", "total_pages", "page", F.array_join(F.slice("a", F.col("page") * P.PAGE_LINES + 1, F.lit(P.PAGE_LINES)), "\n").alias("text"), F.lit(None).cast("string").alias("label"))
    chunks = export.chunks(pages.withColumns({"null_slot": F.lit(False), "text_error": F.lit(None).cast("string"), "n_images": F.lit(0)}))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return chunks.join(labels, "doc_id", "left").select("doc_id", "page", "page_label", "total_pages", "signal", "source", "lang", "content", "quality")


_JSON_SQL = f"""{WORDS_SQL},
jn AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1 AS k FROM words),
jl AS (SELECT doc_id, page_no, k, '[' || min(x) || ',' || min(780 - y) || ',' || max(x + w) || ',' || max(792 - y) || ']' AS bbox,
              string_agg('{{"word_no":' || word_no || ',"text":' || to_json(s) || coalesce(',"font":' || to_json(font), '') || ',"size":12.0,"bbox":[' || x || ',' || (780 - y) || ',' || (x + w) || ',' || (792 - y) || ']}}', ',' ORDER BY word_no) AS spans
       FROM jn GROUP BY doc_id, page_no, k),
jp AS (SELECT doc_id, page_no, '{{"page":' || page_no || ',"coord_origin":"top-left","lines":[' || string_agg('{{"line_no":' || k || ',"bbox":' || bbox || ',"spans":[' || spans || ']}}', ',' ORDER BY k) || ']}}' AS json FROM jl GROUP BY doc_id, page_no)"""


@query(f"WITH {_JSON_SQL} SELECT doc_id, page_no, json FROM jp")
def q_debug_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-1: a page's lines and spans as JSON, in top-left coordinates."""
    return export.page_json(layout.words(_glyphs(spark, sf_dir)), 792.0)


def _order_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders' lines as rows of words in three columns, and the number of each order's last row."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.row_number().over(order) - 1).alias("r"), "l_returnflag", "l_linestatus", "l_partkey")
    y = lambda r: (F.lit(700) - r * 20).cast("double")
    word = lambda i, x, s: F.struct(F.lit(i).alias("word_no"), F.lit(x).alias("x"), s.alias("s"), (F.length(s) * 6).cast("double").alias("w"))
    cells = F.array(word(0, 5.0, F.col("l_returnflag")), word(1, 105.0, F.col("l_linestatus")), word(2, 130.0, F.lit("ok")), word(3, 205.0, F.col("l_partkey").cast("string")))
    words = li.select("doc_id", "page_no", F.col("r").alias("band_no"), F.inline(cells), y(F.col("r") + 0.75).alias("y"), F.lit(10.0).alias("h"), F.lit("F").alias("font"), F.lit(10.0).alias("font_size"))
    n = li.groupBy("doc_id", "page_no").agg(F.max("r").alias("n"))
    return words, n


@query(
    """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS row, l_returnflag, l_linestatus, l_partkey FROM lineitem)
SELECT l_orderkey AS doc_id, 0 AS table_no, row::INT AS row, unnest([0, 1, 2]) AS col, unnest([l_returnflag, l_linestatus || ' ok', l_partkey::VARCHAR]) AS text FROM r"""
)
def q_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TAB-1 to 7, GRD-1 to 5, 10: orders set as ruled tables of three columns, and read back from rules and words."""
    words, n = _order_words(spark, sf_dir)
    y = lambda r: (F.lit(700) - r * 20).cast("double")
    across = F.transform(F.sequence(F.lit(0), F.col("n") + 1), lambda i: F.struct(F.lit(0.0).alias("x0"), y(i).alias("y0"), F.lit(300.0).alias("x1"), y(i).alias("y1")))
    down = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.struct((j * 100).cast("double").alias("x0"), F.lit(700.0).alias("y0"), (j * 100).cast("double").alias("x1"), y(F.col("n") + 1).alias("y1")))
    strokes = n.select("doc_id", "page_no", F.inline(F.concat(across, down)))
    rects = strokes.limit(0).select("doc_id", "page_no", *[F.lit(0.0).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    return tables.table_cells(tables.tables(words, strokes, rects)).select("doc_id", "table_no", "row", "col", "text")


@query(
    """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS row, l_returnflag, l_linestatus, l_partkey FROM lineitem)
SELECT l_orderkey AS doc_id, 0 AS table_no, row::INT AS row, unnest([0, 1, 2]) AS col, unnest([l_returnflag, l_linestatus || ' ok', l_partkey::VARCHAR]) AS text FROM r"""
)
def q_filled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TAB-1, 5 to 7, 11: orders as a fill for each cell, without a stroke, below a title's fill and above a note's, which are no rows."""
    words, n = _order_words(spark, sf_dir)
    title = n.select("doc_id", "page_no", F.lit(-1).cast("long").alias("band_no"), F.lit(0).alias("word_no"), F.lit(5.0).alias("x"), F.lit("Title").alias("s"), F.lit(30.0).alias("w"), F.lit(705.0).alias("y"), F.lit(10.0).alias("h"), F.lit("F").alias("font"), F.lit(10.0).alias("font_size"))
    words = words.withColumn("band_no", F.col("band_no").cast("long")).unionByName(title)
    box = lambda x0, y0, x1, y1: F.struct(x0.cast("double").alias("min_x"), y0.cast("double").alias("min_y"), x1.cast("double").alias("max_x"), y1.cast("double").alias("max_y"))
    low = lambda i: F.lit(680) - i * 20
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.array(*[box(F.lit(100 * j), low(i), F.lit(100 * j + 100), low(i) + 20) for j in range(3)])))
    banners = F.array(box(F.lit(0), F.lit(700), F.lit(300), F.lit(720)), box(F.lit(0), low(F.col("n") + 1), F.lit(300), low(F.col("n"))))
    rects = n.select("doc_id", "page_no", F.inline(F.concat(cells, banners)))
    strokes = rects.limit(0).select("doc_id", "page_no", *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return tables.table_cells(tables.tables(words, strokes, rects)).select("doc_id", "table_no", "row", "col", "text")


# files

_LINES_OF_PAGES = """l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"""


@query(
    f"""WITH {_LINES_OF_PAGES}
SELECT doc_id::VARCHAR AS path, (i // 40 + 1)::INT AS page_no, md5(string_agg(line, chr(10) ORDER BY i)) AS text, 0 AS rotate, 612.0::DOUBLE AS width, NULL::VARCHAR AS text_error FROM l GROUP BY doc_id, i // 40"""
)
def q_pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, 4 to 6, 8, 10 to 13, FLT-1, 2, DEC-4, INT-1, 7, 12: documents written as PDF files, and their pages' plain text read back."""
    pages = pdf.parse(P.document_files(table(spark, sf_dir, "documents")), "page")
    return pages.select("path", "page_no", F.md5("text").alias("text"), "rotate", F.col("media_box")[2].alias("width"), "text_error")


@query(
    f"""WITH {_LINES_OF_PAGES}
SELECT doc_id::VARCHAR AS path, (i // 40 + 1)::INT AS page_no, (760 - 18 * (i % 40))::DOUBLE AS y, length(line) AS n, min(72.0)::DOUBLE AS x, (66 + 6 * length(line))::DOUBLE AS last_x, md5(line) AS s, 'encoding' AS enc_source
FROM l WHERE line <> '' GROUP BY doc_id, i, line"""
)
def q_pdf_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INT-2 to 5: the same files' glyphs, line by line."""
    g = pdf.parse(P.document_files(table(spark, sf_dir, "documents")), "glyph")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "s"))), lambda e: e["s"]), "")
    g = g.groupBy("path", "page_no", "y").agg(F.count("*").alias("n"), F.round(F.min("x"), 6).alias("x"), F.round(F.max("x"), 6).alias("last_x"), F.md5(text).alias("s"), F.max("enc_source").alias("enc_source"))
    return g.select("path", "page_no", "y", "n", "x", "last_x", "s", "enc_source")


@query(
    f"""WITH {_JSON_SQL},
wa AS ({SQL["q_warnings"]}),
wp AS (SELECT doc_id, page_no, string_agg('{{"code":' || to_json(code) || ',"message":' || to_json(message) || ',"detail":' || to_json(detail) || '}}', ',' ORDER BY code, message, detail) AS t FROM wa GROUP BY doc_id, page_no),
pp AS (SELECT doc_id, count(*) AS n, string_agg('{{"page_no":' || page_no || ',"json":' || to_json(json) || coalesce(',"warnings":[' || t || ']', '') || '}}', ',' ORDER BY page_no) AS t FROM jp LEFT JOIN wp USING (doc_id, page_no) GROUP BY doc_id),
ff AS (SELECT doc_id, font, min(seq) AS first_seq, to_json(list_sort(list(DISTINCT page_no))) AS pages FROM g GROUP BY doc_id, font),
fd AS (SELECT doc_id, string_agg('{{"first_seq":' || first_seq || coalesce(',"name":' || to_json(font), '') || ',"subtype":"TrueType","embedded":false,"pages":' || pages || '}}', ',' ORDER BY first_seq) AS t FROM ff GROUP BY doc_id),
ka AS (SELECT page_id AS doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS uri FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages)),
kd AS (SELECT doc_id, string_agg('{{"from_page":1,"ordinal":' || i || ',"uri":' || to_json(uri) || '}}', ',' ORDER BY i) AS t FROM ka GROUP BY doc_id),
wd AS (SELECT doc_id, string_agg('{{"page_no":' || page_no || ',"code":' || to_json(code) || ',"message":' || to_json(message) || ',"detail":' || to_json(detail) || '}}', ',' ORDER BY page_no, code, message, detail) AS t
       FROM wa WHERE NOT EXISTS (SELECT 1 FROM jp WHERE jp.doc_id = wa.doc_id AND jp.page_no = wa.page_no) GROUP BY doc_id)
SELECT pp.doc_id, '{{"page_count":' || n || ',"pages":[' || pp.t || ']' || coalesce(',"fonts":[' || fd.t || ']', '') || coalesce(',"links":[' || kd.t || ']', '') || coalesce(',"warnings":[' || wd.t || ']', '') || '}}' AS json
FROM pp LEFT JOIN fd USING (doc_id) LEFT JOIN kd USING (doc_id) LEFT JOIN wd USING (doc_id)"""
)
def q_document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-2: documents as JSON, with pages, fonts, links and warnings."""
    docs = table(spark, sf_dir, "documents")
    g = P.document_glyphs(docs)
    pages = export.page_json(layout.words(g), 792.0)
    fonts = structure.font_inventory(g.select("doc_id", F.col("font").alias("name"), F.lit("TrueType").alias("subtype"), F.lit(False).alias("embedded"), "page_no", "seq"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("from_page"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ordinal", "uri"), F.lit(None).cast("int").alias("to_page"))
    return export.document_json(pages, fonts, p, q_warnings(spark, sf_dir))
