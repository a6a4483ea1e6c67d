import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import page_layout, text
from pagemill.operators import export, quality, seq, structure


def test_roman_and_letters(spark):
    rows = spark.range(1, 60).select("id", text.roman(F.col("id")).alias("r"), text.letters(F.col("id")).alias("a")).collect()
    by = {r.id: r for r in rows}
    assert [by[i].r for i in (1, 4, 9, 14, 40, 49)] == ["I", "IV", "IX", "XIV", "XL", "XLIX"]
    assert [by[i].a for i in (1, 26, 27, 28, 53)] == ["A", "Z", "AA", "BB", "AAA"]


def test_pdf_dates(spark):
    cases = {"D:20240229123456+01'30'": "2024-02-29 11:04:56", "D:2024": "2024-01-01 00:00:00", "202402": "2024-02-01 00:00:00", "D:20240229120000Z": "2024-02-29 12:00:00", "D:20240229120000-0500": "2024-02-29 17:00:00", "yesterday": None, "D:20241399": None}
    got = spark.createDataFrame([(c,) for c in cases], "s string").select("s", text.pdf_date(F.col("s")).cast("string").alias("t")).collect()
    assert {r.s: r.t for r in got} == cases


def test_asof_takes_the_last_of_equal_marks(spark):
    points = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 0)], "k int, p int")
    marks = spark.createDataFrame([(1, 1, 0, "a"), (1, 3, 1, "b"), (1, 3, 2, "c")], "k int, m int, o int, v string")
    got = {(r.k, r.p): r.v for r in seq.asof_last(points, marks, ["k"], "p", "m", ["v"], "o").collect()}
    assert got == {(1, 0): None, (1, 1): "a", (1, 2): "a", (1, 3): "c", (1, 4): "c", (1, 5): "c", (2, 0): None}


@pytest.mark.parametrize("parts", [1, 7])
def test_sequence_operators_dont_depend_on_partitioning(spark, parts):
    rng = random.Random(1)
    rows = [(rng.randrange(3), i, float(rng.randrange(200)), float(rng.randrange(9))) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i long, lo double, w double").withColumn("hi", F.col("lo") + F.col("w")).repartition(parts)
    got = sorted(map(tuple, seq.coalesce_intervals(df, ["g"], "lo", "hi", "i", 2.0).collect()))
    want = []
    for g in range(3):
        reach = None
        for lo, w in sorted((r[2], r[3]) for r in rows if r[0] == g):
            if reach is None or lo - reach > 2.0:
                want.append([g, lo, lo + w, 0])
                reach = lo + w
            reach = max(reach, lo + w)
            want[-1][2:] = [reach, want[-1][3] + 1]
    assert got == sorted(map(tuple, want))


def test_warning_set_is_capped_and_sorted(spark):
    rows = [(1, p % 3, "b", "m", str(p)) for p in range(20)] * 2 + [(2, 1, "a", "m", "é" * 300)]
    got = quality.warning_set(spark.createDataFrame(rows, "doc_id long, page_no int, code string, message string, detail string"), cap=5).collect()
    assert sum(r.doc_id == 1 for r in got) == 5 and sum(r.code == "truncated" for r in got) == 1
    assert [r.detail for r in got if r.doc_id == 2] == ["é" * 128]


def test_ratios_of_a_document_are_sums_not_means(spark):
    g = spark.createDataFrame([(1, 1, "ab", "fallback"), (1, 2, "abcdef", "tounicode"), (1, 2, "\n", "separator"), (2, 1, "", "none")], "doc_id long, page_no int, s string, enc_source string")
    c = quality.decode_counters(g)
    pages = spark.createDataFrame([(1, 1, "x", None, 0, False), (1, 2, " ", None, 2, False), (2, 1, "", "bad", 0, False), (3, 1, None, None, 0, True)], "doc_id long, page_no int, text string, text_error string, n_images int, null_slot boolean")
    got = {r.doc_id: r for r in quality.document_summary(pages, c).collect()}
    assert got[1].fallback_ratio == 0.25 and (got[1].n_text, got[1].n_image_only) == (1, 1)
    assert got[2].n_degraded == 1 and got[2].fallback_ratio == 0.0 and got[3].n_empty == 1


def test_page_labels(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 8)] + [(2, 1)], "doc_id long, page_no int")
    ranges = spark.createDataFrame([(1, 1, 0, "", "r", 1), (1, 4, 1, "A-", "D", 9), (1, 4, 2, "B-", "", 1)], "doc_id long, start int, ordinal int, prefix string, style string, st int")
    got = {(r.doc_id, r.page_no): r.label for r in structure.page_labels(pages, ranges).collect()}
    assert [got[1, p] for p in range(1, 8)] == ["1", "i", "ii", "iii", "B-", "B-", "B-"] and got[2, 1] == "1"


def test_box_of_what_is_not_finite(spark):
    r = spark.range(1).select(export.box(F.lit(100.0), F.lit(float("nan")), F.lit(20.0), F.lit(5.0), F.lit(10.0)).alias("b")).first()
    assert r.b == [0.0, 70.0, 0.0, 80.0]


glyph = st.tuples(st.sampled_from("ab 日"), st.floats(0, 500), st.floats(0, 700), st.floats(0, 9), st.floats(0.5, 20))


@settings(max_examples=60, deadline=None)
@given(st.lists(glyph, max_size=40), st.randoms())
def test_layout_keeps_every_character_and_no_other(rows, rnd):
    s, x, y, w, size = ([r[i] for r in rows] for i in range(5))
    lines = page_layout.page_lines(s, x, y, w, size, ["F"] * len(s), size)
    assert sorted("".join(wd.s for ln in lines for wd in ln.words)) == sorted(c for c in s if c != " ")
    for ln in lines:
        assert ln.y <= min(wd.y for wd in ln.words) + 1e-9 and ln.w + ln.x >= max(wd.right for wd in ln.words) - 1e-9


@given(st.lists(st.floats(-50, 50), max_size=30))
def test_bands_are_from_top_to_bottom(ys):
    import numpy as np

    n = len(ys)
    got = page_layout.bands(np.arange(n, dtype=float), np.array(ys), np.full(n, 10.0))
    assert sorted(i for b in got for i in b.tolist()) == list(range(n))
    tops = [max(ys[i] for i in b) for b in got]
    assert all(a >= b - 0.1 for a, b in zip(tops, tops[1:]))


def test_text_of_a_document_ends_with_its_first_error(spark):
    rows = [(1, 2, "b", None), (1, 1, "a", None), (2, 1, "a", None), (2, 2, "", "bad operand"), (3, 1, None, None)]
    got = {r.doc_id: (r.text, r.text_error) for r in export.document_text(spark.createDataFrame(rows, "doc_id long, page_no int, text string, text_error string")).collect()}
    assert got == {1: ("ab", None), 2: ("", "bad operand"), 3: ("", None)}
