"""PDF files made of the driver's documents, in many forms; what the file queries read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.plans.projections import PAGE_LINES
from pagemill.sources import crypt

WIDTHS = f"/FirstChar 32 /Widths [{' '.join(['500'] * 224)}]"
BODY = f"<< /Type /Font /Subtype /TrueType /BaseFont /Body /Encoding /WinAnsiEncoding {WIDTHS} >>"


def literal(data: bytes) -> bytes:
    return b"(" + data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def hexed(data: bytes) -> bytes:
    return b"<" + data.hex().encode() + b">"


def stream(data: bytes, extra: str = "") -> bytes:
    return f"<< /Length {len(data)} {extra} >>\nstream\n".encode() + data + b"\nendstream"


def flat(data: bytes, extra: str = "") -> bytes:
    return stream(zlib.compress(data, 1), f"/Filter /FlateDecode {extra}")


def set_lines(lines: list[str], encode: Callable[[str], bytes] = lambda s: literal(s.encode("cp1252", "replace"))) -> bytes:
    """Content that sets a page's lines, each with the operator that breaks lines."""
    runs = [encode(line) for line in lines]
    return b"BT /F1 12 Tf 18 TL 72 760 Td " + runs[0] + b" Tj " + b"".join(r + b" ' " for r in runs[1:]) + b"ET"


def classic(objects: dict[int, bytes], trailer: str = "", version: str = "1.4") -> bytes:
    """A file with one cross-reference table, in as many sections as its objects' numbers make."""
    out, at = bytearray(f"%PDF-{version}\n".encode()), {}
    for n, o in sorted(objects.items()):
        at[n] = len(out)
        out += f"{n} 0 obj\n".encode() + o + b"\nendobj\n"
    start, rows = len(out), {0: b"0000000000 65535 f \n"} | {n: f"{a:010d} 00000 n \n".encode() for n, a in at.items()}
    out += b"xref\n"
    for n in sorted(rows):  # a section for each run of numbers
        if n == 0 or n - 1 not in rows:
            run = next(k for k in range(n, max(rows) + 2) if k not in rows) - n
            out += f"{n} {run}\n".encode() + b"".join(rows[k] for k in range(n, n + run))
    return bytes(out + f"trailer\n<< /Size {max(objects) + 1} /Root 1 0 R {trailer} >>\nstartxref\n{start}\n%%EOF\n".encode())


def packed(objects: dict[int, bytes]) -> bytes:
    """A file whose objects without streams stand in an object stream, found by a cross-reference stream with a predictor."""
    loose = {n: o for n, o in objects.items() if b"stream" in o}
    inner = [n for n in sorted(objects) if n not in loose]
    heads, body = "", b""
    for n in inner:
        heads += f"{n} {len(body)} "
        body += objects[n] + b" "
    pack, table = max(objects) + 1, max(objects) + 2
    loose[pack] = flat(heads.encode() + body, f"/Type /ObjStm /N {len(inner)} /First {len(heads)}")
    out, rows = bytearray(b"%PDF-1.5\n"), {0: (0, 0, 0)} | {n: (2, pack, i) for i, n in enumerate(inner)}
    for n, o in sorted(loose.items()):
        rows[n] = (1, len(out), 0)
        out += f"{n} 0 obj\n".encode() + o + b"\nendobj\n"
    start = len(out)
    rows[table] = (1, start, 0)
    plain = [bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in (rows.get(n, (0, 0, 0)) for n in range(table + 1))]
    coded = png(plain, lambda i: 2)
    out += f"{table} 0 obj\n".encode() + flat(coded, f"/Type /XRef /Size {table + 1} /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >>") + b"\nendobj\n"
    return bytes(out + f"startxref\n{start}\n%%EOF\n".encode())


def png(rows: list[bytes], rule: Callable[[int], int], step: int = 1) -> bytes:
    """Rows of equal length as differences by a rule for each."""
    out, up = bytearray(), bytes(len(rows[0]) if rows else 0)
    for i, row in enumerate(rows):
        kind = rule(i)
        left = bytes(step) + row[:-step] if step <= len(row) else bytes(len(row))
        corner = bytes(step) + up[:-step] if step <= len(up) else bytes(len(up))
        out.append(kind)
        for x, a, b, c in zip(row, left, up, corner, strict=True):
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out.append((x - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        up = row
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of growing width, without looking for long words: each byte, and a clear code before the width would grow."""
    bits, have, out, n = 0, 0, bytearray(), 0
    for code in [256, *data, 257]:
        for c in ([256] if n == 250 else []) + [code]:
            n = 0 if c == 256 else n + 1
            bits, have = bits << 9 | c, have + 9
            while have >= 8:
                have -= 8
                out.append(bits >> have & 255)
            bits &= (1 << have) - 1
    return bytes(out) + (bytes([bits << (8 - have) & 255]) if have else b"")


def ascii85(data: bytes) -> bytes:
    import base64

    return base64.a85encode(data) + b"~>"


def run_length(data: bytes) -> bytes:
    """Runs of equal bytes as counts, others as they are."""
    out, i = bytearray(), 0
    while i < len(data):
        j = i
        while j < len(data) and data[j] == data[i] and j - i < 128:
            j += 1
        if j - i > 1:
            out += bytes([257 - (j - i), data[i]])
        else:
            while j < len(data) and j - i < 128 and data[j : j + 1] != data[j + 1 : j + 2]:
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out) + b"\x80"


def filtered(data: bytes, form: int) -> bytes:
    """Content behind each of the filters."""
    wide = 24
    rows = [data[i : i + wide].ljust(wide) for i in range(0, len(data), wide)]
    if form == 0:
        return stream(lzw(data), "/Filter /LZWDecode")
    if form == 1:
        return stream(ascii85(zlib.compress(data, 1)), "/Filter [/ASCII85Decode /FlateDecode]")
    if form == 2:
        return stream(data.hex().encode() + b">", "/Filter /AHx")
    if form == 3:
        return stream(run_length(data), "/Filter /RunLengthDecode")
    if form == 4:
        return flat(png(rows, lambda i: i % 5, 3), "/DecodeParms << /Predictor 15 /Colors 3 /Columns 8 >>")
    tiff = b"".join(bytes((x - (row[i - 3] if i >= 3 else 0)) & 255 for i, x in enumerate(row)) for row in rows)
    return flat(tiff, "/DecodeParms << /Predictor 2 /Colors 3 /Columns 8 >>")


def page_objects(lines: list[str], content: Callable[[list[str], int], bytes] = lambda page, i: flat(set_lines(page)), font: bytes = BODY.encode(), page: str = "", more: dict[int, bytes] | None = None) -> dict[int, bytes]:
    """Objects of a document: 1 the catalog, 2 the pages, 3 the font, then a page and its content in turn."""
    pages = [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)]
    out = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font}
    out[2] = f"<< /Type /Pages /Kids [{' '.join(f'{100 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>".encode()
    for i, p in enumerate(pages):
        out[100 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {101 + 2 * i} 0 R {page} >>".encode()
        out[101 + 2 * i] = content(p, i)
    return out | (more or {})


def contained(lines: list[str], form: int) -> bytes:
    """0: object and cross-reference streams; 1: two revisions; 2: a hybrid of both kinds of tables; 3: a deep page tree."""
    objects = page_objects(lines)
    if form == 0:
        return packed(objects)
    if form == 1:
        old = classic({**objects, **{n: flat(b"BT /F1 12 Tf (obsolete) Tj ET") for n in objects if n > 100 and n % 2}})
        out, prev = bytearray(old), int(old[old.rindex(b"startxref") :].split()[1])
        sections = b""
        for n in sorted(objects):
            if n > 100 and n % 2:
                sections += f"{n} 1\n{len(out):010d} 00000 n \n".encode()
                out += f"{n} 0 obj\n".encode() + objects[n] + b"\nendobj\n"
        start = len(out)
        return bytes(out + b"xref\n" + sections + f"trailer\n<< /Size {max(objects) + 1} /Root 1 0 R /Prev {prev} >>\nstartxref\n{start}\n%%EOF\n".encode())
    if form == 2:
        hidden = {3: objects.pop(3)}
        heads, body = "3 0 ", hidden[3]
        size = max(objects) + 3
        objects[size - 2] = flat(heads.encode() + body, f"/Type /ObjStm /N 1 /First {len(heads)}")
        row = b"\2" + (size - 2).to_bytes(4, "big") + b"\0\0"
        objects[size - 1] = flat(row, "/Type /XRef /Index [3 1] /Size 4 /W [1 4 2]")
        plain = classic(objects)
        at = plain.index(f"\n{size - 1} 0 obj".encode()) + 1
        return classic(objects, f"/XRefStm {at}")
    kids = [n for n in sorted(objects) if n >= 100 and n % 2 == 0]
    for i, n in enumerate(kids):
        objects[40000 + i] = f"<< /Type /Pages /Parent 2 0 R /Kids [{n} 0 R] /Count 1 >>".encode()
    objects[2] = objects[2].replace(b" ".join(f"{n} 0 R".encode() for n in kids), b" ".join(f"{40000 + i} 0 R".encode() for i in range(len(kids))))
    return classic(objects)


PASSWORD, OWNER = "open sesame", "owner's own"


def encrypted(lines: list[str], form: int) -> bytes:
    """0: RC4 of 40 bits; 1: of 128; 2: AES of 128, with the owner's password; 3: AES of 256; 4: the newest; 5: crypt filters, streams left plain."""
    user = "" if form == 5 else PASSWORD
    ident, objects = bytes(range(16)), page_objects(lines)
    rev = (2, 3, 4, 5, 6, 4)[form]
    cf = "/CF << /StdCF << /CFM /{} >> >> /StmF /{} /StrF /StdCF"
    if rev >= 5:
        key, p = hashlib.sha256(str(len(lines)).encode()).digest(), user.encode()
        u = crypt._hash_2b(p, b"saltsalt", b"", rev) + b"saltsalt" + b"keysalt1"
        ue = crypt.aes_encrypt(crypt._hash_2b(p, b"keysalt1", b"", rev), bytes(16), key)
        spec = f"/V 5 /R {rev} /P -4 /O <{bytes(48).hex()}> /OE <{bytes(32).hex()}> /U <{u.hex()}> /UE <{ue.hex()}> {cf.format('AESV3', 'StdCF')}"
    else:
        size = 5 if rev == 2 else 16
        o = owner_entry(OWNER.encode(), user.encode(), rev, size)
        key = crypt._file_key(user.encode(), {"O": o, "P": -4}, ident, rev, size, True)
        u = crypt._user_entry(key, ident, rev).ljust(32, b"\0")
        method = cf.format("AESV2", "Identity" if form == 5 else "StdCF") if rev == 4 else ""
        spec = f"/V {(1, 2, 4, 0, 0, 4)[form]} /R {rev} /Length {size * 8} /P -4 /O <{o.hex()}> /U <{u.hex()}> {method}"

    def sealed(n: int, data: bytes) -> bytes:
        pad = 16 - len(data) % 16
        if form == 5:
            return data
        if rev >= 5:
            return bytes(16) + crypt.aes_encrypt(key, bytes(16), data + bytes([pad]) * pad)
        own = hashlib.md5(key + struct.pack("<I", n)[:3] + b"\0\0" + (b"sAlT" if rev == 4 else b"")).digest()[: min(16, len(key) + 5)]
        return bytes(range(16)) + crypt.aes_encrypt(own, bytes(range(16)), data + bytes([pad]) * pad) if rev == 4 else crypt.rc4(own, data)

    pages = [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)]
    for i, p in enumerate(pages):
        objects[101 + 2 * i] = stream(sealed(101 + 2 * i, zlib.compress(set_lines(p), 1)), "/Filter /FlateDecode")
    objects[4] = f"<< /Filter /Standard {spec} >>".encode()
    return classic(objects, f"/Encrypt 4 0 R /ID [<{ident.hex()}> <{ident.hex()}>]")


@lru_cache(maxsize=64)
def owner_entry(owner: bytes, user: bytes, rev: int, size: int) -> bytes:
    """The user password under a key made of the owner's."""
    h = hashlib.md5(crypt._padded(owner)).digest()
    for _ in range(50 if rev >= 3 else 0):
        h = hashlib.md5(h).digest()
    x = crypt._padded(user)
    for i in range(20 if rev >= 3 else 1):
        x = crypt.rc4(bytes(b ^ i for b in h[:size]), x)
    return x


def cmap(pairs: list[tuple[str, str]], ranges: list[tuple[str, str, str]], width: int) -> bytes:
    one = "".join(f"<{a}> <{b}>\n" for a, b in pairs)
    run = "".join(f"<{a}> <{b}> <{c}>\n" for a, b, c in ranges)
    out = f"begincmap 1 begincodespacerange <{'00' * width}> <{'ff' * width}> endcodespacerange\n"
    out += f"{len(pairs)} beginbfchar\n{one}endbfchar\n" if pairs else ""
    return (out + (f"{len(ranges)} beginbfrange\n{run}endbfrange\n" if ranges else "") + "endcmap").encode()


def _composite(encoding: str, system: str = "", to: str = "") -> dict[int, bytes]:
    return {3: f"<< /Type /Font /Subtype /Type0 /BaseFont /Wide /Encoding /{encoding} {to} /DescendantFonts [5 0 R] >>".encode(), 5: f"<< /Type /Font /Subtype /CIDFontType2 /DW 500 {system} >>".encode()}


#: Charsets of the predefined maps that form 4 goes through.
LEGACY = (("90ms-RKSJ-H", "cp932"), ("GBK-EUC-H", "gbk"), ("ETen-B5-H", "big5"), ("KSC-EUC-H", "euc_kr"))
_NAMES = {0x20: "space", 0xE9: "eacute", 0xE8: "egrave", 0xF1: "ntilde", 0xFC: "udieresis", 0xF6: "odieresis", 0xE4: "adieresis", 0xDF: "germandbls", 0xE7: "ccedilla", 0xE1: "aacute", 0xF3: "oacute", 0xFA: "uacute", 0xED: "iacute", 0xE0: "agrave", 0xEA: "ecircumflex"}


def in_font(lines: list[str], form: int, which: int) -> bytes:
    """Lines in fonts of several kinds. 0: a wide font with a map to text; 1: a simple one with a map; 2: one with glyph names;
    3: codes of two bytes that are Unicode; 4: legacy charsets; 5: the Japanese collection; 6: another byte table."""
    utf16 = lambda s: hexed(s.encode("utf-16-be"))
    if form == 0:
        ranges = [(f"{a:02x}00", f"{a:02x}ff", f"{a:02x}00") for a in range(0x21)]
        pairs = [(f"{ord(c):04x}", f"{ord(c):04x}") for c in "“”‘’–—…€"]
        return _fonts(lines, utf16, _composite("Identity-H", to="/ToUnicode 6 0 R") | {6: flat(cmap(pairs, ranges, 2))})
    if form == 1:
        shift = lambda s: hexed(bytes((b + 1) & 255 for b in s.encode("cp1252", "replace")))
        pairs = [(f"{(b + 1) & 255:02x}", f"{ord(bytes([b]).decode('cp1252', 'replace')):04x}") for b in range(256)]
        return _fonts(lines, shift, {3: f"<< /Type /Font /Subtype /TrueType /BaseFont /Body /ToUnicode 6 0 R {WIDTHS} >>".encode(), 6: flat(cmap(pairs, [], 1))})
    if form == 2:
        names = " ".join(f"{b} /{_NAMES.get(ord(c), f'uni{ord(c):04X}')}" for b in range(32, 256) for c in [bytes([b]).decode("cp1252", "replace")])
        return _fonts(lines, lambda s: literal(s.encode("cp1252", "replace")), {3: f"<< /Type /Font /Subtype /Type1 /BaseFont /Body /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [{names}] >> {WIDTHS} >>".encode()})
    if form == 3:
        by_name = _composite("Identity-H", "/CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >>", "/ToUnicode /Identity-H")
        return _fonts(lines, utf16, by_name if which else _composite("UniGB-UCS2-H"))
    if form == 4:
        name, charset = LEGACY[which]
        return _fonts(lines, lambda s: literal(s.encode(charset, "replace")), _composite(name))
    if form == 5:
        from pagemill.sources.encodings import adobe_cids

        back = {t: c for c, t in reversed(adobe_cids("Japan1").items())}
        return _fonts(lines, lambda s: hexed(b"".join(back.get(c, 0).to_bytes(2, "big") for c in s)), _composite("Identity-H", "/CIDSystemInfo << /Registry (Adobe) /Ordering (Japan1) /Supplement 2 >>"))
    return _fonts(lines, lambda s: literal(s.encode("mac_roman", "replace")), {3: BODY.replace("WinAnsi", "MacRoman").encode()})


def _fonts(lines: list[str], encode: Callable[[str], bytes], fonts: dict[int, bytes]) -> bytes:
    return classic(page_objects(lines, lambda page, i: flat(set_lines(page, encode)), fonts.pop(3), more=fonts))


#: A kern that moves as far as a blank.
KERN = -500


def turned(lines: list[str], turn: int) -> bytes:
    """Pages turned by a quarter or more, whose content, kerned word by word in a form with a matrix, comes out upright."""

    def content(page: list[str], i: int) -> bytes:
        runs = b" T* ".join(b"[" + f" {KERN} ".encode().join(literal(t.encode("cp1252", "replace")) for t in line.split(" ")) + b"] TJ" for line in page)
        return flat(b"BT /F1 12 Tf 18 TL 70 757 Td " + runs + b" ET", "/Type /XObject /Subtype /Form /BBox [0 0 612 792] /Matrix [1 0 0 1 2 3] /Resources << /Font << /F1 3 0 R >> >>")

    objects = page_objects(lines, content)
    wide = (0, 0, 792, 612) if turn in (90, 270) else (0, 0, 612, 792)
    matrix = {0: "1 0 0 1 0 0", 90: "0 1 -1 0 792 0", 180: "-1 0 0 -1 612 792", 270: "0 -1 1 0 0 612"}[turn]
    for n in [n for n in objects if n >= 100 and n % 2 == 0]:
        objects[n] = f"<< /Type /Page /Parent 2 0 R /Rotate {turn} /MediaBox [{' '.join(map(str, wide))}] /Contents {50000 + n} 0 R /Resources << /XObject << /Fm {n + 1} 0 R >> >> >>".encode()
        objects[50000 + n] = flat(f"q {matrix} cm /Fm Do Q".encode())
    return classic(objects)


def structured(doc_id: int, lines: list[str]) -> bytes:
    """A document with links by name and address, an outline, labels, form fields, an attachment, a title and metadata."""
    objects = page_objects(lines, page="/Annots [{} 0 R {} 0 R {} 0 R]")
    pages = [n for n in sorted(objects) if n >= 100 and n % 2 == 0]
    n, names, kids = len(pages), [], []
    for i, ref in enumerate(pages):
        a = 60000 + 10 * i
        objects[ref] = objects[ref].replace(b"{} 0 R {} 0 R {} 0 R", f"{a} 0 R {a + 1} 0 R {a + 2} 0 R".encode())
        objects[a] = f"<< /Subtype /Link /Rect [0 0 9 9] /Dest (p{(i + 1) % n}) >>".encode()
        objects[a + 1] = f"<< /Subtype /Link /Rect [0 0 9 9] /A << /S /URI /URI (http://x/{doc_id}/{i}) >> >>".encode()
        objects[a + 2] = f"<< /Subtype /Widget /T (f{i}) /V (v{doc_id}) /Rect [1 2 3 4] /P {ref} 0 R >>".encode()
        objects[a + 3] = f"<< /Title (page {i}) /Dest (p{i}) {f'/Next {a + 13} 0 R' if i + 1 < n else ''} /First {a + 4} 0 R >>".encode()
        objects[a + 4] = f"<< /Title <{('é' + str(i)).encode('utf-16').hex()}> /A << /S /GoTo /D [{ref} 0 R /Fit] >> >>".encode()
        names.append(f"(p{i}) [{ref} 0 R /Fit]")
        kids.append(f"{a + 2} 0 R")
    objects[10] = f"<< /Names [{' '.join(names)}] >>".encode()
    objects[11] = f"<< /F (plain.txt) /UF <FEFF00FC{doc_id % 10 + 0x30:04X}> /EF << /F 12 0 R >> >>".encode()
    objects[12] = flat("\n".join(lines).encode(), "/Subtype /text#2Fplain")
    objects[13] = f"<< /First {60003} 0 R >>".encode()
    objects[14] = f"<< /T (form) /FT /Tx /Kids [{' '.join(kids)}] >>".encode()
    objects[15] = flat(f"<x:xmpmeta id='{doc_id}'/>".encode(), "/Type /Metadata /Subtype /XML")
    objects[16] = f"<< /Title <FEFF{str(doc_id).encode('utf-16-be').hex()}> /CreationDate (D:20240102030405Z) >>".encode()
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R /Names << /Dests << /Kids [10 0 R] >> /EmbeddedFiles << /Names [(k) 11 0 R] >> >> /PageLabels << /Nums [0 << /S /r >> 2 << /P (A-) /S /D /St 3 >>] >> /Outlines 13 0 R /AcroForm << /Fields [14 0 R] >> /Metadata 15 0 R >>"
    return classic(objects, "/Info 16 0 R")


def files(docs: DataFrame, make: Callable[[int, list[str]], bytes]) -> DataFrame:
    """(path, content): each document (doc_id, text) as the file that ``make`` makes of its id and lines."""

    def run(batches):
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            yield pa.record_batch([pa.array([str(d) for d in ids]), pa.array([make(d, t.split("\n")) for d, t in zip(ids, texts, strict=True)], pa.binary())], ["path", "content"])

    # making and reading files takes long beside the bytes that it reads
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id").mapInArrow(run, "path string, content binary")
