"""Layout operators over glyph relations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import schema as S
from pagemill.functions import page_layout as L

#: A glyph is skew beyond so many degrees off the nearest axis.
SKEW = 10.0
#: A watermark stands on so many sampled pages, shares at least so much of them, and has so many characters.
SAMPLE, SHARE, CHARS = 16, 0.5, 5
PAGE = ("doc_id", "page_no")


def is_skew(rotation: Column) -> Column:
    d = F.abs(rotation) % 90
    return F.coalesce(F.least(d, 90 - d) > SKEW, F.lit(False))


def drop_skew(glyphs: DataFrame) -> DataFrame:
    """Glyphs along the axes."""
    return glyphs.where(~is_skew(F.col("rotation")))


def sampled_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no): at most SAMPLE pages of each document, evenly spaced, both ends included."""
    n = pages.groupBy("doc_id").agg(F.max("page_no").alias("n"))
    c = F.least("n", F.lit(SAMPLE))
    at = F.transform(F.sequence(F.lit(0), c - 1), lambda i: (1 + F.round(i * (F.col("n") - 1) / F.greatest(c - 1, F.lit(1)))).cast("int"))
    return n.select("doc_id", F.explode(F.array_distinct(at)).alias("page_no"))


def watermarks(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, signature): the skew text that stands on at least half of a document's sampled pages.

    A page's signature is its skew glyphs' characters, without white space, in sorted order.
    """
    sample = sampled_pages(pages)
    chars = drop_blank(glyphs.where(is_skew(F.col("rotation")))).join(sample, [*PAGE], "left_semi")
    one = chars.groupBy(*PAGE).agg(F.array_join(F.array_sort(F.flatten(F.collect_list(F.split(F.regexp_replace("s", r"\s", ""), "")))), "").alias("signature"))
    n = sample.groupBy("doc_id").agg(F.count("*").alias("n"))
    votes = one.groupBy("doc_id", "signature").agg(F.count("*").alias("c"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("c", "signature")).alias("b")).join(n, "doc_id")
    return best.where((F.col("b.c") >= SHARE * F.col("n")) & (F.length("b.signature") >= CHARS)).select("doc_id", F.col("b.signature").alias("signature"))


def drop_blank(glyphs: DataFrame) -> DataFrame:
    return glyphs.where(F.col("s").isNotNull() & (F.trim("s") != ""))


def drop_watermarks(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Glyphs without the skew ones of documents that carry a watermark."""
    marked = watermarks(glyphs, pages).select("doc_id").withColumn("marked", F.lit(True))
    return glyphs.join(marked, "doc_id", "left").where(F.col("marked").isNull() | ~is_skew(F.col("rotation"))).drop("marked")


def quantized(v: Column) -> Column:
    return F.round(v / L.GRID)


def _words(table: pa.Table) -> pa.Table:
    table = table.sort_by("seq")
    col = lambda c: table.column(c).to_numpy(zero_copy_only=False)
    found = L.page_lines(table.column("s").to_pylist(), col("x"), col("y"), col("w"), col("h"), table.column("font").to_pylist(), col("font_size"))
    rows = []
    at: dict[int, int] = {}
    for n, line in enumerate(found):
        for word in line.words:
            k = at[line.band] = at.get(line.band, -1) + 1
            rows.append((line.band, k, n, line.column, line.block, word.s, word.x, word.y, word.w, word.h, word.font, word.size))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 12
    kinds = [pa.int32()] * 5 + [pa.string()] + [pa.float64()] * 4 + [pa.string(), pa.float64()]
    names = ["band_no", "word_no", "line_no", "column_no", "block_no", "s", "x", "y", "w", "h", "font", "font_size"]
    page = [pa.array([table.column(c)[0].as_py()] * len(rows), t) for c, t in zip(PAGE, (pa.int64(), pa.int32()), strict=True)]
    return pa.table([*page, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*PAGE, *names])


def words(glyphs: DataFrame) -> DataFrame:
    """Words with their bands, lines, columns and blocks; a page's glyphs meet in one task."""
    need = glyphs.select(*PAGE, "seq", "s", "font", "font_size", "x", "y", "w", "h")
    return need.groupBy(*PAGE).applyInArrow(_words, S.WORD)


#: Characters of scripts that are set without blanks between words.
SPACELESS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"


def lines(words_: DataFrame) -> DataFrame:
    """Lines of words: text joined by blanks (but between spaceless characters), and the box around them."""
    one = F.array_sort(F.collect_list(F.struct("word_no", "s", "x", "y", "w", "h", "font", "font_size")))
    # dealt by page, as blocks are then, so that they need no other shuffle
    g = words_.repartition(*PAGE).groupBy(*PAGE, "line_no", "column_no", "block_no").agg(one.alias("ws"))
    tight = lambda a, b: a.rlike(SPACELESS + "$") & b.rlike("^" + SPACELESS)
    text = F.array_join(F.transform("ws", lambda w, i: F.when((i == 0) | tight(F.get("ws", i - 1)["s"], w["s"]), w["s"]).otherwise(F.concat(F.lit(" "), w["s"]))), "")
    first = F.get("ws", F.lit(0))
    right, top, low = (F.array_max(F.transform("ws", lambda w: w["x"] + w["w"])), F.array_max(F.transform("ws", lambda w: w["y"] + w["h"])), F.array_min(F.transform("ws", lambda w: w["y"])))
    return g.select(*PAGE, "line_no", "column_no", "block_no", text.alias("s"), first["x"].alias("x"), low.alias("y"), (right - first["x"]).alias("w"), (top - low).alias("h"), first["font"].alias("font"), first["font_size"].alias("font_size"), F.size("ws").cast("long").alias("n_words"))


def blocks(lines_: DataFrame) -> DataFrame:
    """Blocks of lines: text joined by line breaks from top to bottom, and the box around them."""
    one = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "line_no", "s", "font", "font_size")))
    g = lines_.groupBy(*PAGE, "block_no", "column_no").agg(one.alias("ls"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("t"), F.count("*").alias("n_lines"))
    return g.select(*PAGE, "block_no", "column_no", F.array_join(F.transform("ls", lambda e: e["s"]), "\n").alias("s"), "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("t") - F.col("y")).alias("h"), F.get("ls", F.lit(0))["font"].alias("font"), F.get("ls", F.lit(0))["font_size"].alias("font_size"), "n_lines")


def styled_runs(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_no, run_no, s, font, font_size, x, y): glyphs in reading order merged while font, size (0.1) and baseline (5) keep to the run's first glyph."""

    def fold(table: pa.Table) -> pa.Table:
        rows = table.sort_by("seq").to_pylist()
        runs: list[dict] = []
        for g in rows:
            head = runs[-1] if runs else None
            if head and head["s"] and g["font"] == head["font"] and abs(g["font_size"] - head["font_size"]) < 0.1 and abs(g["y"] - head["y"]) < 5:
                head["parts"].append(g["s"] or "")
            else:
                runs.append({**g, "parts": [g["s"] or ""]})
        out = [{"doc_id": r["doc_id"], "page_no": r["page_no"], "run_no": i, "s": "".join(r["parts"]), "font": r["font"], "font_size": r["font_size"], "x": r["x"], "y": r["y"]} for i, r in enumerate(runs)]
        kinds = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("run_no", pa.int32()), ("s", pa.string()), ("font", pa.string()), ("font_size", pa.float64()), ("x", pa.float64()), ("y", pa.float64())])
        return pa.Table.from_pylist(out, kinds)

    need = glyphs.select(*PAGE, "seq", "s", "font", "font_size", "x", "y")
    return need.groupBy(*PAGE).applyInArrow(fold, f"{S.PAGE}, run_no int, s string, font string, font_size double, x double, y double")


def text_rows(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_no, position, s): glyphs by whole-number baseline from the top, each row from left to right."""
    return _by(glyphs, F.col("y"), F.struct("x", (-F.col("y")).alias("y"), "seq", "s"), descending=True)


def text_columns(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_no, position, s): glyphs by whole-number left edge, each column from the top."""
    return _by(glyphs, F.col("x"), F.struct((-F.col("y")).alias("y"), "x", "seq", "s"), descending=False)


def _by(glyphs: DataFrame, key: Column, order: Column, descending: bool) -> DataFrame:
    g = glyphs.groupBy(*PAGE, key.cast("long").alias("position")).agg(F.array_sort(F.collect_list(order)).alias("g"))
    at = F.col("position").desc() if descending else F.col("position")
    return g.select(*PAGE, "position", F.row_number().over(Window.partitionBy(*PAGE).orderBy(at)).alias("ordinal"), F.array_join(F.transform("g", lambda e: e["s"]), "").alias("s"), F.size("g").cast("long").alias("n"))


def upright(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Glyphs with those of pages turned a quarter to the left set upright; other pages' pass through untouched."""
    real = F.coalesce((F.col("s") != "") & (F.col("s") != "\n"), F.lit(False))
    turned = F.abs(F.col("rotation") - 90) <= L.TURNED
    n = glyphs.groupBy(*PAGE).agg(F.count_if(real).alias("n"), F.count_if(real & turned).alias("t")).where((F.col("t") >= L.TURN_LEAST) & (F.col("t") * 2 > F.col("n")))
    boxed = n.select(*PAGE).join(pages.select(*PAGE, "media_box"), [*PAGE]).select(*PAGE, F.col("media_box")[1].alias("low"), F.col("media_box")[2].alias("right"))
    columns = ["x", "y", "w", "h", "font_size", "rotation"]

    def turn(table: pa.Table) -> pa.Table:
        got = L.upright(*(table.column(c).to_numpy(zero_copy_only=False) for c in columns), table.column("low")[0].as_py(), table.column("right")[0].as_py())
        for c, v in zip(columns, got, strict=True):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(v))
        return table.drop_columns(["low", "right"])

    done = glyphs.join(boxed, [*PAGE]).groupBy(*PAGE).applyInArrow(turn, glyphs.schema)
    return glyphs.join(boxed.select(*PAGE), [*PAGE], "left_anti").unionByName(done)
