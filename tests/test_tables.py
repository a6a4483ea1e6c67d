import pytest

from pagemill.functions.page_layout import Word
from pagemill.functions.page_tables import lattice, merged, page_edges, page_tables
from pagemill.operators import layout, tables
from pagemill.sources import pdf
from tests.pdf_files import one_page


def grid_strokes(xs, ys):
    return [(x, ys[0], x, ys[-1]) for x in xs] + [(xs[0], y, xs[-1], y) for y in ys]


def word(s, x, y, w=None, h=10):
    return Word(s, x, y, 5.0 * len(s) if w is None else w, h, "F", 10.0)


@pytest.mark.parametrize("n,m", [(1, 2), (2, 1), (3, 4), (10, 6)])
def test_fully_ruled_grid(n, m):
    xs, ys = [50 * i for i in range(m + 1)], [700 - 20 * i for i in range(n + 1)]
    words = [word(f"r{i}c{j}", xs[j] + 5, ys[i + 1] + 5) for i in range(n) for j in range(m)]
    (t,) = page_tables(words, grid_strokes(xs, ys), [])
    assert t.grid == [[f"r{i}c{j}" for j in range(m)] for i in range(n)] and t.confidence == "high"
    assert t.region == (0, -700, 50 * m, -700 + 20 * n)


def test_rules_drawn_twice_and_in_pieces_make_one_lattice():
    rects = [(50 * j + d, 600 + 20 * i, 50 * j + 50 + d, 620 + 20 * i) for i in range(3) for j in range(3) for d in (0, 1.5)]
    assert len(lattice(merged(page_edges([], rects)))) == 9


def test_no_table_without_two_cells_or_text():
    assert page_tables([word("x", 5, 5)], grid_strokes([0, 50], [0, 20]), []) == []
    assert page_tables([], grid_strokes([0, 50, 90], [0, 20, 40]), []) == []


def test_two_tables_apart_and_phantom_columns():
    a, b = grid_strokes([0, 50, 100], [700, 680]), grid_strokes([0, 50, 100, 150], [600, 580, 560])
    found = page_tables([word("a", 5, 685), word("b", 55, 685), word("c", 5, 585)], a + b, [])
    assert [len(t.grid[0]) for t in found] == [2, 3] and [t.confidence for t in found] == ["high", "low"]


def test_words_in_pieces_leaders_and_straddling_digits():
    strokes = grid_strokes([0, 60, 120], [700, 680])
    words = [word("2,1", 62, 685), word("20", 77, 685), word("name", 2, 685, 20), word("......", 23, 685, 30)]
    assert page_tables(words, strokes, [])[0].grid == [["name", "2,120"]]
    words = [word("a", 2, 685), word("12", 100, 685, 10), word("345", 113, 685, 16)]
    assert page_tables(words, strokes, [])[0].grid == [["a", "12 345"]]


def test_abutting_words_stay_apart_at_a_rule():
    words = [word("11", 50, 685, 10), word("22", 60, 685, 10)]
    assert page_tables(words, grid_strokes([0, 60, 120], [700, 680]), [])[0].grid == [["11", "22"]]


def test_from_files_to_cells(spark, tmp_path):
    rules = "".join(f"{x} 700 m {x} 640 l S\n" for x in (50, 150, 250)) + "".join(f"50 {y} m 250 {y} l S\n" for y in (700, 670, 640))
    text = "".join(f"BT /F1 10 Tf {x} {y} Td ({s}) Tj ET\n" for x, y, s in ((60, 680, "Name"), (160, 680, "Count"), (60, 650, "apples"), (160, 650, "42")))
    (tmp_path / "t.pdf").write_bytes(one_page(rules + text))
    from pyspark.sql import functions as F

    of = lambda r: pdf.read(spark, str(tmp_path), r).withColumn("doc_id", F.xxhash64("path"))
    found = tables.tables(layout.words(of("glyph")), of("stroke"), of("rect"))
    got = {(r.row, r.col): r.text for r in tables.table_cells(found).collect()}
    assert got == {(0, 0): "Name", (0, 1): "Count", (1, 0): "apples", (1, 1): "42"}


def test_edges_and_crossings_as_relations(spark):
    strokes = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 100.0, 1.0), (1, 1, 1, 0.0, 50.0, 100.0, 50.0), (1, 1, 2, 10.0, 0.0, 10.0, 50.0)], "doc_id long, page_no int, seq long, x0 double, y0 double, x1 double, y1 double")
    rects = spark.createDataFrame([], "doc_id long, page_no int, seq long, min_x double, min_y double, max_x double, max_y double")
    e = tables.joined(tables.snapped(tables.edges(strokes, rects)))
    assert sorted((r.orient, r.at) for r in e.collect()) == [("h", -50.0), ("h", -0.5), ("v", 10.0)]
    assert {(r.x, r.top) for r in tables.crossings(e).collect()} == {(10.0, -50.0), (10.0, -0.5)}


def test_open_columns_beside_a_table():
    ys = [700, 680, 660]
    strokes = [(x, 700, x, 660) for x in (50, 100, 150)] + [(20, y, 180, y) for y in ys]
    words = [word(t, x, y) for y, row in ((685, "abcd"), (665, "efgh")) for x, t in zip((25, 60, 110, 160), row)]
    assert page_tables(words, strokes, [])[0].grid == [list("abcd"), list("efgh")]
    short = [(x, 700, x, 660) for x in (50, 100, 150)] + [(45, y, 155, y) for y in ys]
    assert page_tables(words, short, [])[0].grid == [list("bc"), list("fg")]


def test_rows_of_a_body_without_rules():
    strokes = grid_strokes([0, 60, 120], [700, 680]) + grid_strokes([0, 60, 120], [680, 600])
    words = [word("h1", 5, 685), word("h2", 65, 685)] + [word(f"{c}{i}", x, 660 - 15 * i) for i in range(4) for x, c in ((5, "a"), (65, "b"))]
    assert page_tables(words, strokes, [])[0].grid == [["h1", "h2"]] + [[f"a{i}", f"b{i}"] for i in range(4)]
    callout = [w for w in words if not w.s.startswith("b")] + [word("prose", 65, 640)]
    assert len(page_tables(callout, strokes, [])[0].grid) == 2


def test_legacy_fonts_are_doubtful():
    strokes = grid_strokes([0, 60, 120], [700, 680])
    words = [Word(s, x, 685, 10, 10, "ABC+KrutiDev010", 10) for s, x in (("jke", 2), ("uke", 20), ("dqy", 70))]
    assert page_tables(words, strokes, [])[0].warnings == ["legacy_font"]
    assert page_tables([Word("नाम", 2, 685, 10, 10, "KrutiDev010", 10), word("x", 70, 685)], strokes, [])[0].warnings == []


def test_turned_pages_are_set_upright(spark):
    rows = [(1, 1, i, c, "F", 0.0, 100.0, 50.0 + 5 * i, 0.0, 10.0, 90.0, "tounicode") for i, c in enumerate("turned")]
    rows += [(1, 2, i, c, "F", 10.0, 5.0 * i, 50.0, 5.0, 10.0, 0.0, "tounicode") for i, c in enumerate("plain")]
    from pagemill import schema

    glyphs = spark.createDataFrame(rows, schema.GLYPH)
    pages = spark.createDataFrame([(1, p, [0.0, 0.0, 612.0, 792.0]) for p in (1, 2)], "doc_id long, page_no int, media_box array<double>")
    got = {r.page_no: r for r in layout.words(layout.upright(glyphs, pages)).collect()}
    assert (got[1].s, got[1].x, got[1].y, got[1].font_size) == ("turned", 50.0, 512.0, 10.0) and (got[2].s, got[2].y) == ("plain", 50.0)


def test_fills_that_step_make_rows():
    strokes = grid_strokes([0, 60, 120], [700, 680]) + grid_strokes([0, 60, 120], [680, 600])
    fills = [(0, 600, 120, 680 - 20 * i) for i in range(1, 4)]
    words = [word("h1", 5, 685), word("h2", 65, 685)] + [word(f"{c}{i}", x, 665 - 20 * i) for i in range(4) for x, c in ((5, "a"), (65, "b")) if (c, i) != ("b", 1)]
    got = page_tables(words, strokes, fills)[0].grid
    assert [r[0] for r in got] == ["h1", "a0", "a1", "a2", "a3"] and [r[1] for r in got] == ["h2", "b0", "", "b2", "b3"]


def test_a_body_ruled_in_the_label_column():
    strokes = grid_strokes([0, 60, 120, 180], [700, 680]) + grid_strokes([0, 60], [680, 660, 640])
    words = [word(f"h{j}", 5 + 60 * j, 685) for j in range(3)] + [word("r1", 5, 665), word("r2", 5, 645), word("11", 65, 665), word("21", 65, 645), word("lone", 125, 665)]
    got = page_tables(words, strokes, [])[0].grid
    assert got == [["h0", "h1", "h2"], ["r1", "11", ""], ["r2", "21", ""]]


def test_a_comb_of_rules_under_a_header():
    strokes = [(0, y, 180, y) for y in (700, 680)] + [(0, 700, 0, 680), (180, 700, 180, 680), (60, 700, 60, 600), (120, 700, 120, 600)]
    words = [word(f"h{j}", 5 + 60 * j, 685) for j in range(3)] + [word(f"{i}{j}", 5 + 60 * j, 655 - 20 * i) for i in range(2) for j in range(3)]
    assert page_tables(words, strokes, [])[0].grid == [["h0", "h1", "h2"], ["00", "01", "02"], ["10", "11", "12"]]
    assert len(page_tables([*words, word("astride", 50, 620)], strokes, [])[0].grid) == 1


def fills(rows, foot_banner=True):
    """A fill for each cell of rows (top, bottom, sides), below a banner."""
    out = [(0, 700, 300, 720)] + [(a, b, c, t) for t, b, sides in rows for a, c in zip(sides, sides[1:])]
    low = min(b for _, b, _ in rows)
    return out + [(0, low - 20, 300, low)] * foot_banner


def test_fills_without_strokes_give_their_body_only():
    sides = [0, 100, 200, 300]
    rects = fills([(700 - 20 * i, 680 - 20 * i, sides) for i in range(4)])
    words = [word("Title", 5, 705)] + [word(f"{i}{j}", sides[j] + 5, 685 - 20 * i) for i in range(3) for j in range(3)]
    (t,) = page_tables(words, [], rects)
    assert t.grid == [[f"{i}{j}" for j in range(3)] for i in range(3)]  # neither banner nor the empty row at the foot
    (t,) = page_tables(words, [(500, 500, 560, 500)], rects)
    assert t.grid[0][0] == "Title"
    (t,) = page_tables(words, [], rects[1:-1])  # nothing lies outside: the empty row stays
    assert len(t.grid) == 4


def test_collapsed_rows_of_figures_are_cut():
    sides = [0, 100, 200, 300]
    rects = fills([(700, 600, sides)])
    figures = [word(f"{i}{j}", sides[j] + 5, 685 - 20 * i) for i in range(5) for j in range(3)]
    (t,) = page_tables([word("Title", 5, 705), *figures], [], rects)
    assert t.grid == [[f"{i}{j}" for j in range(3)] for i in range(5)]
    prose = [word("ab", sides[j] + 5, 685 - 20 * i) for i in range(5) for j in range(3)]
    (t,) = page_tables([word("Title", 5, 705), *prose], [], rects)
    assert len(t.grid) == 1


def test_a_header_with_sides_of_its_own_is_one_cell():
    rects = fills([(700, 680, [0, 150, 300]), (680, 660, [0, 100, 200, 300]), (660, 640, [0, 100, 200, 300])], foot_banner=False)
    words = [word("Title", 5, 705), word("left", 5, 685), word("right", 160, 685)] + [word(f"{i}{j}", 100 * j + 5, 665 - 20 * i) for i in range(2) for j in range(3)]
    (t,) = page_tables(words, [], rects)
    assert t.grid[-2:] == [["00", "01", "02"], ["10", "11", "12"]] and len(t.grid) == 3 and len(t.grid[0]) == 3
    assert [x for x in t.grid[0] if x] in (["left right"], ["left", "right"])


def test_pages_reach_python_many_at_a_time(spark):
    """Pages that straddle batches are whole, with and without keys, and no page costs a group."""
    from pyspark.sql import functions as F

    ruled = lambda d, n: [(d, 1, 0.0, 700.0 - 20 * i, 300.0, 700.0 - 20 * i) for i in range(n + 1)] + [(d, 1, 100.0 * j, 700.0, 100.0 * j, 700.0 - 20 * n) for j in range(4)]
    said = lambda d, n: [(d, 1, r, j, f"{d}.{r}.{j}", 100.0 * j + 5, 685.0 - 20 * r, 40.0, 10.0, "F", 10.0) for r in range(n) for j in range(3)]
    sizes = {None: 2, 1: 1, 2: 9, 3: 4, 4: 7}
    num = lambda names: ", ".join(f"{c} double" for c in names.split())
    words = spark.createDataFrame([r for d, n in sizes.items() for r in said(d, n)], f"doc_id long, page_no int, band_no int, word_no int, s string, {num('x y w h')}, font string, font_size double").orderBy(F.xxhash64("s"))
    strokes = spark.createDataFrame([r for d, n in sizes.items() for r in ruled(d, n)] + ruled(9, 2), f"doc_id long, page_no int, {num('x0 y0 x1 y1')}")
    rects = strokes.limit(0).toDF("doc_id", "page_no", "min_x", "min_y", "max_x", "max_y")
    found = tables.tables(words, strokes, rects)
    assert "CoGroups" not in found._jdf.queryExecution().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: r.cells for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {d: [[f"{d}.{r}.{j}" for j in range(3)] for r in range(n)] for d, n in sizes.items()}


def test_pages_of_one_form_have_their_own_words():
    rules = [(0.0, 0.0, 100.0, 0.0), (0.0, -20.0, 100.0, -20.0), (0.0, 0.0, 0.0, -20.0), (50.0, 0.0, 50.0, -20.0), (100.0, 0.0, 100.0, -20.0)]
    for s in ("a", "b"):
        words = [Word(s, 5.0, -15.0, 10.0, 10.0, "F", 10.0), Word("z", 60.0, -15.0, 10.0, 10.0, "F", 10.0)]
        assert page_tables(words, [list(r) for r in rules], [])[0].grid == [[s, "z"]]
