"""Registered queries over the driver's tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import layout, quality, seq
from pagemill.plans import projections as P
from pagemill.plans.projections import GLYPHS_SQL, SHIP_SQL, WORDS_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.document_glyphs(table(spark, sf_dir, "documents"))


# layout


@query(f"WITH {WORDS_SQL} SELECT doc_id, page_no, line_no, word_no, s, x, y, w, font FROM words")
def q_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-1, 2, 6, 7, 8: words of glyphs. A band's top tells the line it came from."""
    w = layout.words(layout.drop_skew(_glyphs(spark, sf_dir)))
    line = (F.col("page_no") - 1) * P.PAGE_LINES + ((P.TOP - F.col("y")) / P.LEADING).cast("int")
    return w.select("doc_id", "page_no", line.cast("long").alias("line_no"), "word_no", "s", "x", "y", "w", "font")


_LINES_SQL = (
    WORDS_SQL
    + """,
lines AS (SELECT doc_id, page_no, line_no, string_agg(s, ' ' ORDER BY word_no) AS s, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, count(*) AS n_words, arg_min(font, word_no) AS font
          FROM words GROUP BY doc_id, page_no, line_no)
"""
)


@query(f"WITH {_LINES_SQL} SELECT doc_id, page_no, s, x, y, w, n_words, font FROM lines")
def q_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-9, 14, 16: lines of words, where no gutter shows."""
    return layout.lines(layout.words(_glyphs(spark, sf_dir))).select("doc_id", "page_no", "s", "x", "y", "w", "n_words", "font")


@query(
    f"""WITH {_LINES_SQL},
e AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY y DESC) AS above FROM lines),
f AS (SELECT *, sum(CASE WHEN above - (y + 12) > 0.6 * 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY y DESC) AS block_no FROM e)
SELECT doc_id, page_no, block_no::INT AS block_no, string_agg(s, chr(10) ORDER BY y DESC) AS s, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + 12) - min(y) AS h, count(*) AS n_lines
FROM f GROUP BY doc_id, page_no, block_no"""
)
def q_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-15: blocks of lines."""
    return layout.blocks(layout.lines(layout.words(_glyphs(spark, sf_dir)))).select("doc_id", "page_no", "block_no", "s", "x", "y", "w", "h", "n_lines")


@query(
    f"""WITH {GLYPHS_SQL}
SELECT doc_id, page_no, y::BIGINT AS position, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y::BIGINT DESC)::INT AS ordinal, string_agg(s, '' ORDER BY x, seq) AS s, count(*) AS n
FROM g GROUP BY doc_id, page_no, y"""
)
def q_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-18: rows of glyphs by baseline."""
    return layout.text_rows(_glyphs(spark, sf_dir))


@query(
    f"""WITH {GLYPHS_SQL}
SELECT doc_id, page_no, x::BIGINT AS position, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY x::BIGINT)::INT AS ordinal, string_agg(s, '' ORDER BY y DESC, seq) AS s, count(*) AS n
FROM g GROUP BY doc_id, page_no, x"""
)
def q_text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-19: columns of glyphs by left edge."""
    return layout.text_columns(_glyphs(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {GLYPHS_SQL},
v AS (SELECT doc_id, page_no, y, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y DESC) AS i, string_agg(s, '' ORDER BY seq) AS s FROM g GROUP BY doc_id, page_no, y),
r AS (SELECT doc_id, page_no, i, y AS head, 0 AS run_no FROM v WHERE i = 1
      UNION ALL
      SELECT v.doc_id, v.page_no, v.i, CASE WHEN r.head - v.y < 5 THEN r.head ELSE v.y END, r.run_no + CASE WHEN r.head - v.y < 5 THEN 0 ELSE 1 END
      FROM r JOIN v ON v.doc_id = r.doc_id AND v.page_no = r.page_no AND v.i = r.i + 1)
SELECT doc_id, page_no, run_no::INT AS run_no, string_agg(s, '' ORDER BY i) AS s, max(head) AS y FROM r JOIN v USING (doc_id, page_no, i) GROUP BY doc_id, page_no, run_no"""
)
def q_styled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-17: runs of one style."""
    return layout.styled_runs(_glyphs(spark, sf_dir)).select("doc_id", "page_no", "run_no", "s", "y")


def _stamped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages whose first line is set aslant, as a stamp would be."""
    g = _glyphs(spark, sf_dir)
    g = g.withColumn("rotation", F.when(F.col("line_no") % P.PAGE_LINES == 0, 45.0).otherwise(0.0))
    return g, g.select("doc_id", "page_no").distinct()


@query(
    f"""WITH {GLYPHS_SQL},
p AS (SELECT DISTINCT doc_id, page_no FROM g), n AS (SELECT doc_id, max(page_no) AS n FROM p GROUP BY doc_id),
t AS (SELECT doc_id, n, unnest(range(0, least(n, 16))) AS i FROM n),
s AS (SELECT DISTINCT doc_id, (1 + round(i * (n - 1) / greatest(least(n, 16) - 1, 1)))::INT AS page_no FROM t),
c AS (SELECT doc_id, page_no, unnest(string_split(s, '')) AS c FROM g WHERE line_no % 40 = 0 AND (doc_id, page_no) IN (SELECT doc_id, page_no FROM s)),
a AS (SELECT doc_id, page_no, string_agg(c, '' ORDER BY c) AS signature FROM c GROUP BY doc_id, page_no),
v AS (SELECT doc_id, signature, count(*) AS k FROM a GROUP BY doc_id, signature),
b AS (SELECT doc_id, signature, k FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, signature DESC) = 1)
SELECT doc_id, signature FROM b JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) USING (doc_id) WHERE k >= 0.5 * n AND length(signature) >= 5"""
)
def q_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-1, 3, 4, 5: documents with a watermark."""
    return layout.watermarks(*_stamped(spark, sf_dir))


# sequences


@query(
    """WITH e AS (SELECT user_id AS page, event_id AS seq, epoch_us(ts) AS x FROM events),
b AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL OR x - max(x) OVER (PARTITION BY page ORDER BY x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3600000000 THEN 1 ELSE 0 END AS brk FROM e WINDOW w AS (PARTITION BY page ORDER BY x, seq))
SELECT page, seq, x, (sum(brk) OVER (PARTITION BY page ORDER BY x, seq))::BIGINT AS segment FROM b"""
)
def q_gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-8's core, on events: sessions that a gap of an hour ends."""
    e = P.event_points(table(spark, sf_dir, "events"))
    return seq.gap_segments(e, ["page"], "x", "x", "seq", F.lit(3_600_000_000)).select("page", "seq", "x", "segment")


@query(
    """WITH p AS (SELECT l_suppkey AS grp, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice AS pos FROM lineitem),
b AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR pos - lag(pos) OVER w > 3 THEN 1 ELSE 0 END AS brk FROM p WINDOW w AS (PARTITION BY grp ORDER BY pos, seq)),
c AS (SELECT *, sum(brk) OVER (PARTITION BY grp ORDER BY pos, seq ROWS UNBOUNDED PRECEDING) AS cluster FROM b)
SELECT grp, cluster::BIGINT AS cluster, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM c GROUP BY grp, cluster"""
)
def q_cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TAB-2: clusters of positions within 3 of a neighbour."""
    c = seq.cluster_1d(P.price_points(table(spark, sf_dir, "lineitem")), ["grp"], "at", "seq", 3.0)
    return c.groupBy("grp", "cluster").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))


@query(
    f"""WITH i AS (SELECT * FROM {SHIP_SQL}),
b AS (SELECT *, max(hi) OVER (PARTITION BY grp ORDER BY lo, seq, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo - reach > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY lo, seq, hi ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT grp, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM c GROUP BY grp, run"""
)
def q_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TAB-3: intervals joined where they touch within 3."""
    return seq.coalesce_intervals(P.ship_intervals(table(spark, sf_dir, "lineitem")), ["grp"], "lo", "hi", "seq", 3)


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS page, epoch_us(ts) AS x FROM events),
r AS (SELECT page, min(x) AS anchor FROM e GROUP BY page
      UNION ALL
      SELECT n.page, n.x FROM (SELECT r.page, min(e.x) AS x FROM r JOIN e ON e.page = r.page AND e.x > r.anchor + 21600000000 GROUP BY r.page, r.anchor) n)
SELECT page, anchor FROM r"""
)
def q_anchor_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY-7's core, on events: bands that reach six hours from their first event."""
    return seq.anchor_fold(P.event_points(table(spark, sf_dir, "events")), ["page"], "x", 21_600_000_000)


# quality

_PAGES_SQL = (
    GLYPHS_SQL
    + """,
pages AS (SELECT doc_id, page_no, string_agg(s, ' ' ORDER BY seq) AS text, count(*) FILTER (s LIKE '%|%') AS n_images, count(*) FILTER (s LIKE '%@%') > 0 AS bad FROM g GROUP BY doc_id, page_no),
signal AS (SELECT doc_id, page_no, n_images, CASE WHEN bad THEN 'degraded' WHEN trim(text) <> '' THEN 'text' WHEN n_images > 0 THEN 'image_only' ELSE 'empty' END AS signal FROM pages),
d AS (SELECT doc_id, page_no, s, CASE WHEN regexp_matches(s, '[0-9]') THEN 'cidmap' WHEN regexp_matches(s, '[^ -~]') THEN 'fallback' WHEN regexp_matches(s, '[A-Z]') THEN 'none' ELSE 'tounicode' END AS src FROM g),
c AS (SELECT doc_id, page_no, sum(length(s))::BIGINT AS total, sum(CASE WHEN src = 'none' THEN length(s) ELSE 0 END)::BIGINT AS missing,
             sum(CASE WHEN src IN ('cidmap', 'fallback') THEN length(s) ELSE 0 END)::BIGINT AS fall, sum(length(s) - length(replace(s, 'é', '')))::BIGINT AS unmapped FROM d GROUP BY doc_id, page_no)
"""
)


def _routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages and glyphs on which every branch of the routing shows: tokens with | stand for images, with @ for an error, é for a character without a mapping."""
    g = _glyphs(spark, sf_dir)
    s = F.col("s")
    src = F.when(s.rlike("[0-9]"), "cidmap").when(s.rlike("[^ -~]"), "fallback").when(s.rlike("[A-Z]"), "none").otherwise("tounicode")
    pages = g.groupBy("doc_id", "page_no").agg(
        # a token that isn't blank, if there is one, is all of a text that the routing looks at
        F.max("s").alias("text"), F.count_if(s.contains("|")).alias("n_images"), F.when(F.bool_or(s.contains("@")), "bad operand").alias("text_error"), F.lit(False).alias("null_slot")
    )
    return pages, g.withColumns({"enc_source": src, "s": F.translate("s", "é", "�")})


@query(f"WITH {_PAGES_SQL} SELECT doc_id, page_no, n_images, signal FROM signal")
def q_page_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUA-1: what each page holds."""
    return quality.page_signal(_routed(spark, sf_dir)[0]).select("doc_id", "page_no", "n_images", "signal")


@query(f"WITH {_PAGES_SQL} SELECT doc_id, page_no, total, missing / total AS missing_ratio, fall / total AS fallback_ratio, unmapped / total AS unmapped_ratio FROM c")
def q_decode_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-14, QUA-2: where each page's characters come from."""
    c = quality.decode_ratios(quality.decode_counters(_routed(spark, sf_dir)[1]))
    return c.select("doc_id", "page_no", "total", "missing_ratio", "fallback_ratio", "unmapped_ratio")


@query(
    f"""WITH {_PAGES_SQL},
t AS (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (signal = 'text') AS n_text, count(*) FILTER (signal = 'image_only') AS n_image_only, count(*) FILTER (signal = 'empty') AS n_empty, count(*) FILTER (signal = 'degraded') AS n_degraded FROM signal GROUP BY doc_id),
u AS (SELECT doc_id, sum(missing) / sum(total) AS missing_ratio, sum(fall) / sum(total) AS fallback_ratio, sum(unmapped) / sum(total) AS unmapped_ratio FROM c GROUP BY doc_id)
SELECT * FROM t JOIN u USING (doc_id)"""
)
def q_document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUA-3: what each document holds."""
    pages, glyphs = _routed(spark, sf_dir)
    return quality.document_summary(pages, quality.decode_counters(glyphs))


@query(
    """WITH w AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
l AS (SELECT page_id, href, CASE WHEN starts_with(href, 'http') THEN 'uri' WHEN starts_with(href, '#') THEN 'dest' ELSE 'goto' END AS kind FROM w)
SELECT page_id, kind, count(*) AS n, count(DISTINCT href) AS n_targets FROM l GROUP BY page_id, kind"""
)
def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-3: links of each page, by where they lead."""
    hrefs = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    kind = F.when(F.col("href").startswith("http"), "uri").when(F.col("href").startswith("#"), "dest").otherwise("goto")
    return hrefs.groupBy("page_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("href").alias("n_targets"))
