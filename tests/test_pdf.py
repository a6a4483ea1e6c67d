import zlib

import numpy as np
import pytest

from pagemill.functions import page_layout
from pagemill.sources import crypt, encodings, filters, pdf
from pagemill.sources.objects import Document, Lexer, Name, PdfError, Ref
from tests.pdf_files import flat, one_page, stream
from tests.pdf_files import pdf as make


def of(data, relation, passwords=()):
    return [r[1:] for r in pdf.rows(data, passwords, frozenset(pdf.RELATIONS)) if r[0] == relation]


def text(data):
    return [r[5] for r in of(data, "page")]


def test_plain_text_and_glyphs():
    data = one_page("BT /F1 12 Tf 72 700 Td (Hello, Corpus.) Tj ET")
    assert text(data) == ["Hello, Corpus."]
    g = of(data, "glyph")
    assert [x[2] for x in g[:2]] == ["H", "e"] and g[0][5:8] == (72.0, 700.0, 6.0) and g[1][5] == 78.0 and g[0][9] == 0.0 and g[0][10] == "encoding"
    assert of(data, "document")[0][:3] == (1, False, None)


def test_kerning_makes_blanks_and_array_ends():
    data = one_page("BT /F1 10 Tf [(ab) -119 (cd) -120 (ef)] TJ ET")
    assert text(data) == ["abcd ef\n"]


@pytest.mark.parametrize("content,expected", [("BT /F1 12 Tf (no end of text) Tj", "no end of text"), ("Q Q BT /F1 12 Tf (unbalanced) Tj ET Q", "unbalanced"), ("BT /F1 9 Tf (a\\(b\\)\\101\\\nc) Tj ET", "a(b)Ac"), ("BT /F1 9 Tf <48 69 2> Tj ET", "Hi ")])
def test_tolerated_content(content, expected):
    assert text(one_page(content)) == [expected]


def test_malformed_operand_is_an_error_and_keeps_what_precedes():
    data = one_page("BT /F1 12 Tf (ab) Tj TJ (cd) Tj ET")
    page = of(data, "page")[0]
    assert page[5] == "" and "TJ" in page[6] and len(of(data, "glyph")) == 2


def test_rotation():
    turned = "BT /F1 12 Tf 0 1 -1 0 72 400 Tm (Rotated) Tj ET"
    g = of(one_page(turned), "glyph")
    assert round(g[0][9]) == 90 and any(w[1] == "rotated_text" for w in of(one_page(turned), "warning"))
    upright = one_page(turned, page="/Rotate 90")
    assert abs(of(upright, "glyph")[0][9]) < 1e-9 and not any(w[1] == "rotated_text" for w in of(upright, "warning"))


def test_rects_strokes_images_and_forms():
    data = one_page("2 0 0 2 10 20 cm 0 0 5 6 re f 0 0 m 10 0 l 10 10 l s q 60 0 0 60 0 0 cm /Im0 Do Q /Fm0 Do")
    assert of(data, "rect")[0][2:] == (10.0, 20.0, 20.0, 32.0)
    assert [x[2:] for x in of(data, "stroke")] == [(10, 20, 30, 20), (30, 20, 30, 40), (30, 40, 10, 20)]
    assert of(data, "image_draw")[0][2:] == (10.0, 20.0, 120.0, 120.0, "DCTDecode", 1, 1)
    g = of(data, "glyph")
    assert "".join(x[2] for x in g) == "in a form" and g[0][5:7] == (120.0, 150.0)


def test_shown_strings_and_raw_objects():
    data = one_page("2 0 0 2 0 0 cm BT /F1 9 Tf 10 20 Td (ab) Tj [(c) 5 (d)] TJ ET")
    assert [x[2:] for x in of(data, "show_string")][:2] == [("ab", 10.0, 20.0), ("c", 19.0, 20.0)]
    got = {o[0]: o for o in of(data, "object")}
    assert got[1][2:4] == ("dictionary", '{"Pages": ["R", 2, 0], "Type": "/Catalog"}') and got[4][2] == "stream" and got[4][4] > 40


def test_inline_image():
    data = one_page("q 10 0 0 10 0 0 cm BI /W 2 /H 3 /F /AHx ID 00> EI Q BT /F1 9 Tf (after) Tj ET")
    assert of(data, "image_draw")[0][6:] == ("ASCIIHexDecode", 2, 3) and text(data) == ["after"]


CMAP = "begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00660069> endbfchar 2 beginbfrange <0010> <0020> <0041> <0018> <0030> <0061> endbfrange endcmap"


def test_composite_font_with_a_map():
    font = "<< /Type /Font /Subtype /Type0 /BaseFont /C /Encoding /Identity-H /ToUnicode 8 0 R /DescendantFonts [9 0 R] >>"
    more = {8: flat(CMAP), 9: "<< /Subtype /CIDFontType2 /DW 800 /W [1 [250] 16 18 600] >>"}
    data = one_page("BT /F1 10 Tf <0001 0010 0018 0022 9999> Tj ET", font=font, more=more)
    g = of(data, "glyph")
    assert [x[2] for x in g] == ["fi", "A", "I", "k", "�"]
    assert [x[7] for x in g] == [2.5, 6.0, 8.0, 8.0, 8.0]


def test_composite_font_without_a_map():
    font = "<< /Type /Font /Subtype /Type0 /BaseFont /C /Encoding /Identity-H /DescendantFonts [9 0 R] >>"
    data = one_page("BT /F1 10 Tf <0001> Tj ET", font=font, more={9: "<< /Subtype /CIDFontType2 >>"})
    assert of(data, "glyph")[0][10] == "none" and [w[1] for w in of(data, "warning")] == ["fallback_encoding"]


def test_legacy_charset_and_vertical():
    font = "<< /Type /Font /Subtype /Type0 /BaseFont /J /Encoding /90ms-RKSJ-V /DescendantFonts [9 0 R] >>"
    data = one_page("BT /F1 10 Tf 0 500 Td <93 FA 96 7B 41> Tj ET", font=font, more={9: "<< /Subtype /CIDFontType0 >>"})
    g = of(data, "glyph")
    assert [x[2] for x in g] == ["日", "本", "A"] and [x[6] for x in g] == [500.0, 490.0, 480.0]
    assert "vertical_writing_mode" in [w[1] for w in of(data, "warning")]


def test_differences():
    font = "<< /Type /Font /Subtype /Type1 /BaseFont /D /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /f_i /uni4E2D /g123] >> >>"
    data = one_page("BT /F1 10 Tf (ABCDE) Tj ET", font=font)
    assert text(data) == ["éfi中�E"] and of(data, "warning")[0][1] == "unknown_glyph_names"


def test_overlapping_ranges_keep_the_first():
    m = encodings.CMap(CMAP.encode(), Lexer)
    assert m._lookup(b"\0\x1a") == "K" and m._lookup(b"\0\x20") == "Q" and m._lookup(b"\0\x21") == "j" and m._lookup(b"\0\x31") == "�"


def test_object_streams_and_cross_reference_streams():
    inner = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: "<< /Type /Page /MediaBox [0 0 9 9] /Contents 4 0 R >>"}
    heads, body = "", ""
    for n, o in inner.items():
        heads += f"{n} {len(body)} "
        body += o + " "
    out = bytearray(b"%PDF-1.5\n")
    at4 = len(out)
    out += b"4 0 obj\n" + stream("0 0 3 4 re f") + b"\nendobj\n"
    at5 = len(out)
    out += b"5 0 obj\n" + flat(heads + body, f"/Type /ObjStm /N 3 /First {len(heads)}") + b"\nendobj\n"
    at6 = len(out)
    table = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in [(0, 0, 0), (2, 5, 0), (2, 5, 1), (2, 5, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0)])
    rows = b"".join(bytes([2]) + bytes((x - y) & 255 for x, y in zip(table[i : i + 4], table[i - 4 : i] if i else bytes(4))) for i in range(0, len(table), 4))
    out += b"6 0 obj\n" + flat(rows, "/Type /XRef /Size 7 /W [1 2 1] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 4 >>") + f"\nendobj\nstartxref\n{at6}\n%%EOF".encode()
    assert of(bytes(out), "rect") == [(1, 0, 0.0, 0.0, 3.0, 4.0)]


def test_newer_revision_holds():
    old = one_page("BT /F1 12 Tf (old) Tj ET")
    at, start = len(old), old.rindex(b"startxref")
    prev = int(old[start:].split()[1])
    new = b"4 0 obj\n" + stream("BT /F1 12 Tf (new) Tj ET") + b"\nendobj\n"
    data = old + new + f"xref\n4 1\n{at:010d} 00000 n \ntrailer << /Size 8 /Root 1 0 R /Prev {prev} >>\nstartxref\n{at + len(new)}\n%%EOF".encode()
    assert text(data) == ["new"]


@pytest.mark.parametrize("data", [b"", b"%PDF-3.0\n", b"%PDF-1.4\nnothing", b"%PDF-1.4\nstartxref\n5\n%%EOF", one_page("")[:200]])
def test_damaged_files_are_rows(data):
    assert [r[0] for r in pdf.rows(data)] == ["document"] and of(data, "document")[0][2]


def test_cycles_end():
    with pytest.raises(PdfError):
        Document(b"%PDF-1.4\nxref\n0 0\ntrailer << /Root 1 0 R /Prev 9 >>\nstartxref\n9\n%%EOF")
    loop = make({1: "<< /Pages 2 0 R >>", 2: "<< /Kids [2 0 R 3 0 R] >>", 3: "<< /Type /Page /MediaBox 3 0 R >>"})
    assert [r[0] for r in of(loop, "page")] == [1, 2]


def test_lexer():
    lex = Lexer(b"<< /A#20b [1 -2.5 (x\\ny) <4 1> null true 3 0 R] % no\n /C /D >> word")
    assert lex.object() == {"A b": [1, -2.5, b"x\ny", b"A", None, True, Ref(3, 0)], "C": Name("D")}
    assert lex.object() == "word" and lex.object() is None


def test_white_space_at_the_end_takes_no_time():
    assert text(one_page("BT /F1 12 Tf (ab) Tj ET" + " " * 5000 + "% no more" + "\n" * 5000)) == ["ab"]


@pytest.mark.parametrize(
    "name,expected",
    [("Abreveacute", "Ắ"), ("ohornacute", "ớ"), ("afii10017", "А"), ("afii10097", "я"), ("afii57664", "א"), ("alef", "א"), ("Becyrillic", "Б"), ("ahiragana", "あ"), ("asmallkatakana", "ァ"), ("akatakanahalfwidth", "ｱ"), ("kadeva", "क"), ("onedeva", "१"),
     ("Aybarmenian", "Ա"), ("alefarabic", "ا"), ("amonospace", "ａ"), ("onecircle", "①"), ("aparen", "⒜"), ("oneinferior", "₁"), ("foursuperior", "⁴"), ("arrowdblright", "⇒"), ("iotadieresistonos", "ΐ"), ("alpha", "α"), ("universal", "∀"), ("g123", None), ("nonsense", None)],
)
def test_glyph_names(name, expected):
    assert encodings.glyph_text(name) == expected


def test_japanese_collection_without_a_map():
    cids = encodings.adobe_cids("Japan1")
    assert [cids.get(i) for i in (1, 61, 97, 327, 633, 634, 780, 1124, 1125, 4089, 4090, 7477, 7479, 8000)] == [" ", "¥", "\\", "｡", "\u2003", "、", "０", "я", "亜", "腕", "弌", "瑤", "─", None]
    font = "<< /Type /Font /Subtype /Type0 /BaseFont /J /Encoding /Identity-H /DescendantFonts [9 0 R] >>"
    system = "<< /Subtype /CIDFontType0 /CIDSystemInfo << /Registry (%s) /Ordering (%s) >> >>"
    said = lambda *names: of(one_page("BT /F1 10 Tf <0465 0001 1F40> Tj ET", font=font, more={9: system % names}), "glyph")
    assert [(g[2], g[10]) for g in said("Adobe", "Japan1")] == [("亜", "cidmap"), (" ", "cidmap"), ("�", "cidmap")]
    assert {g[10] for g in said("Other", "Japan1")} == {"none"}


def test_two_byte_codes_are_text_only_where_all_names_say_so():
    for encoding, to, ordering, source in (("Identity-H", "/Identity-H", "Identity", "ucs2"), ("Identity-H", "/Identity-H", "Japan1", "none"), ("Identity-H", "/Other", "Identity", "none")):
        font = f"<< /Type /Font /Subtype /Type0 /BaseFont /U /Encoding /{encoding} /ToUnicode {to} /DescendantFonts [9 0 R] >>"
        data = one_page("BT /F1 10 Tf <0041> Tj ET", font=font, more={9: f"<< /Subtype /CIDFontType2 /CIDSystemInfo << /Registry (X) /Ordering ({ordering}) >> >>"})
        assert of(data, "glyph")[0][10] == source


def test_data_source_packs_files_into_tasks(spark, tmp_path, monkeypatch):
    for i in range(7):
        (tmp_path / f"{i}.pdf").write_bytes(one_page(f"BT /F1 12 Tf ({i}) Tj ET"))
    monkeypatch.setattr(pdf, "TASK_FILES", 3)
    from pyspark.sql.types import StructType

    reader = pdf._Reader({"path": str(tmp_path), "relation": "page"}, StructType.fromDDL(f"path string, {pdf.RELATIONS['page']}"))
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [3, 3, 1] and sum(b.num_rows for p in parts for b in reader.read(p)) == 7


def test_filters():
    raw = bytes(range(256)) * 5 + b"aaaaaaabbbbbb"
    assert filters.ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!" and filters.ascii85(b"z~>") == bytes(4)
    assert filters.ascii_hex(b"48 656C6c 6F7>") == b"Hellop"
    assert filters.run_length(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128, 9])) == b"abcxxx"
    assert filters.flate(zlib.compress(raw)) == raw
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    with pytest.raises(filters.FilterError):
        filters.ascii85(b"\x7f~>")


def _png(rows, rule, step):
    out, up = b"", [0] * len(rows[0])
    for row in rows:
        enc = []
        for i, x in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
            p = a + b - c
            guess = {0: 0, 1: a, 2: b, 3: (a + b) // 2, 4: a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c}[rule]
            enc.append((x - guess) & 255)
        out += bytes([rule, *enc])
        up = row
    return out


@pytest.mark.parametrize("rule", range(5))
def test_row_predictors(rule):
    rng = np.random.default_rng(rule)
    rows = rng.integers(0, 256, (6, 12)).tolist()
    parms = {"Predictor": 15, "Colors": 3, "Columns": 4}
    assert filters._predict(_png(rows, rule, 3), parms) == bytes(x for r in rows for x in r)


def test_aes_and_rc4():
    key, plain = bytes.fromhex("000102030405060708090a0b0c0d0e0f"), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes_encrypt(key, bytes(16), plain).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    for size in (16, 32):
        k, iv, data = bytes(range(size)), bytes(range(16, 32)), bytes(range(96))
        assert crypt.aes_decrypt(k, iv, crypt.aes_encrypt(k, iv, data)) == data
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def _encrypted(password, v):
    """A file under a user password, RC4 with 128 bits (3) or AES with 256 (5)."""
    import hashlib

    content = b"BT /F1 12 Tf (secret) Tj ET"
    file_id = bytes(range(16))
    if v == 3:
        spec = {"O": bytes(32), "P": -4}
        key = crypt._file_key(password.encode(), spec, file_id, 3, 16, True)
        u = crypt._user_entry(key, file_id, 3).ljust(32, b"\0")
        body = crypt.rc4(hashlib.md5(key + b"\x04\0\0\0\0").digest(), content)
        enc = f"<< /Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O <{bytes(32).hex()}> /U <{u.hex()}> >>"
    else:
        key, p = bytes(range(32)), password.encode()
        u = crypt._hash_2b(p, b"saltsalt", b"", 6) + b"saltsalt" + b"keysalt1"
        ue = crypt.aes_encrypt(crypt._hash_2b(p, b"keysalt1", b"", 6), bytes(16), key)
        pad = 16 - len(content) % 16
        body = bytes(16) + crypt.aes_encrypt(key, bytes(16), content + bytes([pad]) * pad)
        enc = f"<< /Filter /Standard /V 5 /R 6 /P -4 /O <{bytes(48).hex()}> /OE <{bytes(32).hex()}> /U <{u.hex()}> /UE <{ue.hex()}> /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF >>"
    return one_page("", more={4: stream(body), 8: enc}, trailer=f"/Encrypt 8 0 R /ID [<{file_id.hex()}> <{file_id.hex()}>]")


@pytest.mark.parametrize("v", [3, 5])
@pytest.mark.parametrize("password", ["", "open sesame"])
def test_encrypted_files(v, password):
    data = _encrypted(password, v)
    if password:
        assert of(data, "document")[0][2].startswith("invalid_password")
    else:
        assert text(data) == ["secret"]
    assert [r[5] for r in of(data, "page", ("wrong", password))] == ["secret"]


def test_files_locked_alike_share_their_keys(monkeypatch):
    """Deriving a key of the newest revision takes tens of thousands of blocks; a second file under the same entries takes none."""
    data, blocks = _encrypted("open sesame", 5), []
    plain = crypt.aes_encrypt
    monkeypatch.setattr(crypt, "aes_encrypt", lambda key, iv, data: (blocks.append(len(data) // 16), plain(key, iv, data))[1])
    for _ in range(2):
        blocks.clear()
        assert [r[5] for r in of(data, "page", ("wrong", "open sesame"))] == ["secret"]
    assert not blocks
    other = _encrypted("another", 5)
    assert of(other, "document", ("wrong", "open sesame"))[0][2].startswith("invalid_password")


def test_ciphers_of_many_blocks():
    """The CBC example of NIST SP 800-38A, and RFC 6229's keystream at 240 and 256."""
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411e5fbc1191a0a52ef")
    assert crypt.aes_encrypt(key, iv, plain).hex() == "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b273bed6b8e3c1743b7116e69e22229516"
    stream = crypt.rc4(bytes([1, 2, 3, 4, 5]), bytes(272))
    assert stream[:16].hex() == "b2396305f03dc027ccc3524a0a1118a8" and stream[240:256].hex() == "28cb1132c96ce286421dcaadb8b69eae" and stream[256:].hex() == "1cfcf62b03eddb641d77dfcf7f8d8c93"


def test_structure():
    catalog = "/Names << /Dests << /Kids [10 0 R] >> /EmbeddedFiles << /Names [(k) 11 0 R (none) << >>] >> >> /PageLabels << /Nums [0 << /S /r >> 5 << /P (A-) /S /D /St 3 >>] >> /Outlines 13 0 R /AcroForm << /Fields [15 0 R] >>"
    more = {
        10: "<< /Names [(there) [3 0 R /Fit]] >>",
        11: "<< /F (plain.txt) /UF <FEFF00FC> /EF << /F 12 0 R >> >>",
        12: stream("payload", "/Subtype /text#2Fplain"),
        13: "<< /First 14 0 R >>",
        14: "<< /Title (Top) /Dest (there) /First 18 0 R >>",
        15: "<< /T (form) /FT /Btn /Kids [16 0 R] >>",
        16: "<< /T (box) /Ff 1 /V /Yes /Rect [1 2 3 4] /P 3 0 R >>",
        17: "<< /Title <FEFF00E9> /CreationDate (D:20240102030405Z) >>",
        18: "<< /Title (Below) /A << /S /GoTo /D [3 0 R] >> >>",
    }
    page = "/Annots [<< /Subtype /Link /A << /S /URI /URI (http://x) >> /Rect [0 0 1 1] >> << /Subtype /Link /Dest (there) >> << /Subtype /Link /Dest (nowhere) >> << /Subtype /Text /Contents (note) >>]"
    data = one_page("", page=page, more=more, catalog=catalog, trailer="/Info 17 0 R")
    assert [(a[2], a[3], a[4], a[5]) for a in of(data, "annotation")] == [("Link", "http://x", None, ""), ("Link", None, 1, ""), ("Link", None, None, ""), ("Text", None, None, "note")]
    assert of(data, "outline_node") == [(0, None, 0, 0, "Top", 1), (1, 0, 1, 0, "Below", 1)]
    assert of(data, "label_range") == [(0, 0, "", "r", 1), (5, 1, "A-", "D", 3)]
    assert of(data, "form_field") == [(0, "form.box", "Btn", 1, ["Yes"], 1, [1.0, 2.0, 3.0, 4.0])]
    assert of(data, "attachment") == [(0, "k", "ü", "plain.txt", "text/plain", b"payload")]
    assert of(data, "document")[0][3] == {"Title": "é", "CreationDate": "D:20240102030405Z"}


def test_relations_in_batch_source_and_stream(spark, tmp_path):
    from pagemill.streaming.files import stream_relation, write_parquet

    (tmp_path / "in").mkdir()
    for i, t in enumerate(("one", "two")):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(one_page(f"BT /F1 12 Tf ({t}) Tj ET"))
    (tmp_path / "in" / "bad.pdf").write_bytes(b"%PDF-1.4\nbroken")
    (tmp_path / "in" / "text.pdf").write_bytes(b"not one")
    path = str(tmp_path / "in")
    got = {r.text for r in pdf.read(spark, path).collect()}
    assert got == {"one", "two"}
    assert sorted((r.error is None) for r in pdf.read(spark, path, "document").collect()) == [False, True, True]
    pdf.register(spark)
    assert {r.text for r in spark.read.format("pdf").load(path).collect()} == got
    write_parquet(stream_relation(spark, path), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == got


def glyphs(rows):
    """Columns of a glyph for each character of runs (s, x, y), of size 10 and width 5."""
    s, x, y = zip(*[(c, a + 5 * i, b) for t, a, b in rows for i, c in enumerate(t or [""])])
    n = len(s)
    return list(s), list(x), list(y), [5.0 * len(t) for t in s], [10.0] * n, ["F"] * n, [10.0] * n


def test_layout_of_two_columns_and_a_masthead():
    rows = [("Masthead", 0, 760), ("across", 42, 760), ("all", 74, 760), ("columns", 91, 760)]
    for i in range(6):
        y = 700 - 12 * i
        rows += [("left", 0, y), ("text", 22, y), ("right", 100, y), ("side", 127, y)]
    got = page_layout.page_lines(*glyphs(rows))
    assert [x.s for x in got[:3]] == ["Masthead across all columns", "left text", "right side"]
    assert {x.column for x in got[1:]} == {0, 1}
    blocks = {}
    for x in got:
        blocks.setdefault(x.block, []).append(x.s)
    assert sorted(map(len, blocks.values())) == [1, 6, 6]


def test_layout_joins_glyphs_and_spaceless_scripts():
    got = page_layout.page_lines(*glyphs([("H", 0, 0), ("i", 5, 0.02), (" ", 10, 0), ("x", 30, 0), ("", 31, 0), ("\n", 36, 0)]))
    assert [w.s for w in got[0].words] == ["Hi", "x"] and got[0].s == "Hi x"
    assert page_layout.joined(["日", "本", "a", "한", "국"]) == "日本 a 한 국"


def test_drawn_relations_in_one_reading(spark, sf):
    """Rectangles, strokes and images together are what each reading alone gives, and a query reads its files once."""
    from pyspark.sql import functions as F

    from pagemill.plans import catalogue_files

    content = "2 0 0 2 10 20 cm 1 2 3 4 re f 1 2 m 5 2 l 6 7 l S [(a) -500 (b)] TJ BI /W 1 /H 1 ID x EI 5 0 R null (c) Tj"
    files = spark.createDataFrame([("a", one_page(content)), ("b", one_page("9 9 9 9 re f")), ("c", b"no file"), ("d", None)], "path string, content binary")
    relations = ("rect", "stroke", "image_draw")
    got = pdf.parse_drawn(files, relations).cache()
    for r in relations:
        alone = pdf.parse(files, r)
        rows = got.where(F.col("relation") == r).select(alone.columns)
        assert sorted(rows.collect()) == sorted(alone.collect()) and rows.count() > 0
    few = pdf.parse(files, "rect", columns=("max_y", "page_no"))
    assert few.columns == ["path", "max_y", "page_no"] and sorted(few.collect()) == sorted(pdf.parse(files, "rect").select(few.columns).collect())
    plan = catalogue_files.q_pdf_graphics(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_baselines_are_the_glyphs_grouped(spark, turn):
    """One row for each height of a page, the same as grouping its glyphs; heights met again and marks alone included."""
    from pyspark.sql import functions as F

    from pagemill.plans import files as W

    apart = one_page("BT /F1 12 Tf 72 700 Td [(ab) -500 (c)] TJ 0 -20 Td (x y) Tj 30 20 Td (z) Tj 0 -40 Td [-500] TJ ET")
    files = spark.createDataFrame([("a", W.turned(["one two", "", "\u00e9 three"], turn)), ("b", apart), ("c", b"no file"), ("d", None)], "path string, content binary")
    got = {(r.path, r.page_no, r.y): tuple(r[3:]) for r in pdf.baselines(files).collect()}
    mark = F.col("enc_source") == "separator"
    own = lambda c: F.when(~mark, F.col(c))
    g = pdf.parse(files, "glyph").withColumn("y", F.round("y", 6) + 0.0).groupBy("path", "page_no", "y")
    text = F.array_join(F.sort_array(F.collect_list(F.when(~mark, F.struct("seq", "s"))))["s"], "")
    g = g.agg(F.count_if(~mark).alias("n"), F.min(own("x")).alias("x"), F.max(own("x")).alias("last_x"), F.max(F.abs("rotation")).alias("rotation"), text.alias("s"), F.count_if(mark).alias("n_breaks"))
    assert got == {(r.path, r.page_no, r.y): tuple(r[3:]) for r in g.collect()} and len(got) > 4 and any(v[0] == 0 for v in got.values())
    assert ("b", 1, 700.0) in got and got["b", 1, 700.0][4] == "abcz"
