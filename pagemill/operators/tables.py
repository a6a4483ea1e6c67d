"""Ruled tables: edges, crossings, cells, components and grids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagemill.functions.page_layout import Word
from pagemill.functions.page_tables import page_tables
from pagemill.functions.text import is_dot_leader, strip_leaders
from pagemill.operators import seq

# Tolerances in points.
SNAP, LEAST_BEFORE, LEAST_AFTER = 3.0, 1.0, 3.0
LINE_STEP, WELD_GAP = 5.0, 4.0
GUTTER, GUTTER_SHARE, NESTED = 16.0, 0.25, 3.0
PHANTOM = 0.6
#: Points of a strip: edges and words meet cells only within strips that both touch.
STRIP = 64.0
PAGE = ("doc_id", "page_no")


def edges(strokes: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, page_no, orient, at, lo, hi) in top-origin coordinates: strokes along their longer axis, and the four sides of rectangles."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    flat = dx >= dy
    s = strokes.select(
        *PAGE,
        F.when(flat, "h").otherwise("v").alias("orient"),
        F.when(flat, -mid("y0", "y1")).otherwise(mid("x0", "x1")).alias("at"),
        F.when(flat, F.least("x0", "x1")).otherwise(-F.greatest("y0", "y1")).alias("lo"),
        F.when(flat, F.greatest("x0", "x1")).otherwise(-F.least("y0", "y1")).alias("hi"),
    )
    side = lambda o, at, lo, hi: F.struct(F.lit(o).alias("orient"), at.alias("at"), lo.alias("lo"), hi.alias("hi"))
    x0, x1, t, b = F.col("min_x"), F.col("max_x"), -F.col("max_y"), -F.col("min_y")
    r = rects.select(*PAGE, F.inline(F.array(side("h", t, x0, x1), side("h", b, x0, x1), side("v", x0, t, b), side("v", x1, t, b))))
    return s.unionByName(r).where(F.col("hi") - F.col("lo") >= LEAST_BEFORE)


def snapped(e: DataFrame) -> DataFrame:
    """Edges with ``at`` moved to the mean of its cluster: edges of one direction within SNAP of a neighbour."""
    c = seq.cluster_1d(e, [*PAGE, "orient"], "at", "lo", SNAP)
    mean = F.avg("at").over(Window.partitionBy(*PAGE, "orient", "cluster"))
    return c.withColumn("at", mean).drop("cluster")


def joined(e: DataFrame) -> DataFrame:
    """Collinear edges merged where they touch within SNAP; those that stay short go."""
    out = seq.coalesce_intervals(e, [*PAGE, "orient", "at"], "lo", "hi", "hi", SNAP).drop("n")
    return out.where(F.col("hi") - F.col("lo") >= LEAST_AFTER)


def _strip(at: Column) -> Column:
    return F.floor(at / STRIP)


def _strips(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(_strip(lo), _strip(F.greatest(lo, hi))))


def crossings(e: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    """(by..., x, top, v_at, h_at): where a vertical and a horizontal edge meet within SNAP.

    A horizontal edge stands in one strip of heights, and a vertical one in each that it reaches, so edges are compared within a strip only.
    """
    v = e.where("orient = 'v'").select(*by, F.col("at").alias("x"), F.col("lo").alias("v_lo"), F.col("hi").alias("v_hi"), _strips(F.col("lo") - SNAP, F.col("hi") + SNAP).alias("strip"))
    h = e.where("orient = 'h'").select(*by, F.col("at").alias("top"), F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"), _strip(F.col("at")).alias("strip"))
    met = v.join(h, [*by, "strip"]).where((F.col("top") >= F.col("v_lo") - SNAP) & (F.col("top") <= F.col("v_hi") + SNAP) & (F.col("x") >= F.col("h_lo") - SNAP) & (F.col("x") <= F.col("h_hi") + SNAP))
    return met.select(*by, F.round("x", 2).alias("x"), F.round("top", 2).alias("top"), "v_lo", "v_hi", "h_lo", "h_hi")


def cells_of_words(words: DataFrame, cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``words`` with the first cell (least cell_no) that holds their centre, edges included; words outside all cells go.

    A centre stands in one strip, and a cell in each that it reaches; of the cells that hold a centre, an aggregate keeps the first.
    """
    cx, cy = F.col("x0") + (F.col("x1") - F.col("x0")) / 2, F.col("top") + (F.col("bottom") - F.col("top")) / 2
    w = words.select(F.struct(*words.columns).alias("word"), *by, "word_id", cx.alias("cx"), cy.alias("cy"), _strip(cx).alias("strip"))
    c = cells.select(*by, "cell_no", F.col("x0").alias("c_x0"), F.col("x1").alias("c_x1"), F.col("top").alias("c_top"), F.col("bottom").alias("c_bottom"), _strips(F.col("x0"), F.col("x1")).alias("strip"))
    met = w.join(c, [*by, "strip"]).where("cx between c_x0 and c_x1 and cy between c_top and c_bottom")
    return met.groupBy(*by, "word_id").agg(F.min(F.struct("cell_no", "word")).alias("first")).select("first.word.*", "first.cell_no")


def nearest_left(misses: DataFrame, placed: DataFrame, by: list[str], at: str, tie: str) -> DataFrame:
    """``misses`` with the placed position at or before each that is nearest, if within WELD_GAP."""
    got = seq.asof_last(misses, placed.withColumn("left_at", F.col(at)), by, at, at, ["left_at"], tie)
    return got.withColumn("left_at", F.when(F.col(at) - F.col("left_at") <= WELD_GAP, F.col("left_at")))


def cell_text(words: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., text): a cell's words, line by line where tops differ by more than LINE_STEP, each from left to right."""
    down = Window.partitionBy(*by).orderBy("top", "x0", "word_id")
    w = words.withColumn("step", F.when(F.col("top") - F.lag("top").over(down) > LINE_STEP, 1).otherwise(0)).withColumn("line", F.sum("step").over(down))
    return w.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x0", "word_id", "s"))), lambda e: e["s"]), " ").alias("text"))


def without_leaders(text: Column) -> Column:
    """A cell's text without dot leaders; one of nothing but dots stays."""
    words = F.split(text, " ")
    kept = F.filter(words, lambda w: ~is_dot_leader(w))
    return strip_leaders(F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " "))


def gutter_columns(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., col, x0, x1, blank, gutter): columns of cells (row, col, x0, x1, text).

    A blank column is a gutter if it is narrow, both absolutely and beside the median width of the columns with
    text, or if it spans one of them.
    """
    col = cells.groupBy(*by, "col").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.bool_and(F.trim("text") == "").alias("blank"))
    width = F.col("x1") - F.col("x0")
    mid = col.where("not blank").groupBy(*by).agg(F.median(width).alias("mid"), F.collect_list(F.struct("x0", "x1")).alias("full"))
    out = col.join(mid, by, "left")
    spans = F.exists("full", lambda f: (F.col("x0") <= f["x0"] + 4) & (F.col("x1") >= f["x1"] - 4) & (width > f["x1"] - f["x0"]))
    narrow = (width > 0) & (width < GUTTER) & (width < GUTTER_SHARE * F.col("mid"))
    return out.select(*by, "col", "x0", "x1", "blank", F.coalesce(F.col("blank") & (narrow | spans), F.lit(False)).alias("gutter"))


def grid_quality(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_rows, n_cols, n_blank, phantom, confidence): a table is doubtful if at least 0.6 of its columns are blank."""
    col = cells.groupBy(*by, "col").agg(F.bool_and(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.countDistinct("row").alias("rows"))
    out = col.groupBy(*by).agg(F.max("rows").alias("n_rows"), F.count("*").alias("n_cols"), F.count_if("blank").alias("n_blank"))
    phantom = F.col("n_blank") / F.col("n_cols") >= PHANTOM
    return out.withColumns({"phantom": phantom, "confidence": F.when(phantom, "low").otherwise("high")})


_TABLE = "table_no int, x0 double, top double, x1 double, bottom double, confidence string, warnings array<string>, cells array<array<string>>"


#: Pages of a batch of tables on its way to the JVM.
BATCH = 1000


def _values(batch: pa.RecordBatch, name: str) -> list:
    c = batch.column(name)
    return c.to_pylist() if c.null_count or not pa.types.is_floating(c.type) else c.to_numpy().tolist()


def _pages(batches):
    """(key, words, strokes, rects) of each page, of rows in which a page's stand together, its words in order."""
    key, words, strokes, rects = None, [], [], []
    for batch in batches:
        kinds, s, x, y, w, h, font, size = (_values(batch, c) for c in ("kind", "s", "x", "y", "w", "h", "font", "font_size"))
        pages = list(zip(*(_values(batch, c) for c in PAGE), strict=True))
        for i, page in enumerate(pages):
            if page != key:
                if key is not None:
                    yield key, words, strokes, rects
                key, words, strokes, rects = page, [], [], []
            if kinds[i] == 0:
                words.append(Word(s[i], x[i], y[i], w[i], h[i], font[i], size[i]))
            else:
                (strokes if kinds[i] == 1 else rects).append((x[i], y[i], w[i], h[i]))
    if key is not None:
        yield key, words, strokes, rects


def _found(schema: pa.Schema):
    def run(batches):
        columns: list[list] = [[] for _ in schema]

        def made() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            for c in columns:
                c.clear()
            return out

        for n, (page, words, strokes, rects) in enumerate(_pages(batches), 1):
            for i, t in enumerate(page_tables(words, strokes, rects)):
                for c, v in zip(columns, (*page, i, *t.region, t.confidence, t.warnings, t.grid), strict=True):
                    c.append(v)
            if n % BATCH == 0:
                yield made()
        yield made()

    return run


def tables(words: DataFrame, strokes: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_no, region, confidence, warnings, cells): the ruled tables of each page.

    A page's words and rules meet in one task; pages are the unit of work, and no page depends on another. Pages go to Python
    many at a time, sorted, as a group for each would take longer than its tables.
    """

    def rows(df: DataFrame, kind: int, *columns: Column | str) -> DataFrame:
        ids = [F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no")]
        named = zip(("band_no", "word_no", "s", "x", "y", "w", "h", "font", "font_size"), columns, strict=True)
        return df.select(*ids, F.lit(kind).alias("kind"), *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in named])

    none = lambda kind: F.lit(None).cast(kind)
    mark = lambda *box: (none("long"), none("long"), none("string"), *box, none("string"), F.lit(0.0))
    long = lambda c: F.col(c).cast("long")
    both = rows(words, 0, long("band_no"), long("word_no"), "s", "x", "y", "w", "h", "font", "font_size")
    both = both.unionByName(rows(strokes, 1, *mark("x0", "y0", "x1", "y1"))).unionByName(rows(rects, 2, *mark("min_x", "min_y", "max_x", "max_y")))
    both = both.repartition(*PAGE).sortWithinPartitions(*PAGE, "kind", "band_no", "word_no").drop("band_no", "word_no")
    kind = StructType.fromDDL(f"doc_id long, page_no int, {_TABLE}")
    return both.mapInArrow(_found(to_arrow_schema(kind)), kind)


def table_cells(found: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_no, row, col, text): one row for each cell."""
    row = found.select(*PAGE, "table_no", F.posexplode("cells").alias("row", "r"))
    return row.select(*PAGE, "table_no", "row", F.posexplode("r").alias("col", "text"))
