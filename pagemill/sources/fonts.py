"""Fonts: how a run's bytes become codes, text and advances."""

from __future__ import annotations

from dataclasses import dataclass, field

from pagemill.sources import encodings as E
from pagemill.sources.objects import Document, Lexer, Stream, text


@dataclass
class Font:
    """A font of a page. ``source`` says where its text comes from."""

    name: str = ""
    subtype: str = ""
    embedded: bool = False
    source: str = "none"
    composite: bool = False
    vertical: bool = False
    table: list[str] | None = None
    cmap: E.CMap | None = None
    cids: dict[int, str] | None = None
    charset: str | None = None
    widths: dict[int, float] = field(default_factory=dict)
    default: float = 0.0
    warnings: list[tuple[str, str, str]] = field(default_factory=list)
    singles: list[tuple[bytes, str, str, float]] = field(default_factory=list)

    def decode(self, data: bytes) -> list[tuple[bytes, str, str]]:
        """(code, text, source) of each glyph of a run."""
        if self.cmap is not None and not self.composite:
            # a simple font's codes are single bytes, whatever its map says; a gap falls back to the encoding
            out = []
            for b in data:
                t = self.cmap._lookup(bytes([b]))
                if t == E.GAP:
                    t = self.cmap._lookup(bytes([0, b]))
                kind = "tounicode"
                if t == E.GAP and self.table is not None:
                    t, kind = self.table[b], "encoding"
                out.append((bytes([b]), t, kind))
            return out
        if self.cmap is not None:
            return [(c, t, "tounicode") for c, t in self.cmap.decode(data)]
        if self.charset:
            return [(c, t, "ucs2" if self.charset == "utf-16-be" else "predefined") for c, t in E.decode_legacy(data, self.charset)]
        if self.cids is not None:
            return [(data[i : i + 2], self.cids.get(int.from_bytes(data[i : i + 2], "big"), E.GAP), "cidmap") for i in range(0, len(data) - 1, 2)]
        if self.composite:
            return [(data[i : i + 2], E.GAP, "none") for i in range(0, len(data), 2)]
        table = self.table or E.PDFDOC
        return [(bytes([b]), table[b], self.source) for b in data]

    def run(self, data: bytes) -> list[tuple[bytes, str, str, float]]:
        """(code, text, source, width) of each glyph of a run; a font of single bytes looks each up once."""
        if self.composite or self.charset:
            return [(c, t, k, self.width(c)) for c, t, k in self.decode(data)]
        if not self.singles:
            every = [self.decode(bytes([b])) for b in range(256)]
            self.singles = [(*g[0], self.width(g[0][0])) for g in every]
        return [self.singles[b] for b in data]

    def width(self, code: bytes) -> float:
        """A code's advance in thousandths of the size."""
        return self.widths.get(int.from_bytes(code, "big"), self.default)


def _simple_table(doc: Document, spec: dict, font: Font) -> None:
    enc = doc.resolve(spec.get("Encoding"))
    base, items = enc, []
    if isinstance(enc, dict):
        base, items = doc.resolve(enc.get("BaseEncoding")), doc.resolve(enc.get("Differences")) or []
    if isinstance(base, str) and base in E.TABLES:
        font.table, font.source = E.TABLES[base], "encoding"
    elif isinstance(base, str) and E.charset(base):
        font.charset = E.charset(base)
    elif base is None:
        font.table, font.source = (E.STANDARD if items else E.PDFDOC), "pdfdoc"
    else:
        font.table, font.source = E.PDFDOC, "fallback"
        font.warnings.append(("unsupported_encoding", "a font's encoding is not supported", f"{font.name} {base}"))
    if items:
        font.table, lost = E.differences(font.table or E.STANDARD, [doc.resolve(x) for x in items])
        font.source = "differences"
        if lost:
            font.warnings.append(("unknown_glyph_names", "glyph names without a meaning", f"{font.name} {lost}"))


def _cid_widths(doc: Document, spec: dict, font: Font) -> None:
    dw = doc.resolve(spec.get("DW"))
    font.default = float(dw) if isinstance(dw, (int, float)) and dw else 1000.0
    w = [doc.resolve(x) for x in doc.resolve(spec.get("W")) or []]
    i = 0
    while i + 1 < len(w):
        if isinstance(w[i + 1], list):
            for k, x in enumerate(w[i + 1]):
                if isinstance(x := doc.resolve(x), (int, float)):
                    font.widths.setdefault(int(w[i]) + k, float(x))
            i += 2
        elif i + 2 < len(w) and all(isinstance(x, (int, float)) for x in w[i : i + 3]):
            for c in range(int(w[i]), min(int(w[i + 1]), int(w[i]) + 65535) + 1):
                font.widths.setdefault(c, float(w[i + 2]))
            i += 3
        else:
            break


def load(doc: Document, spec) -> Font:
    """A font dictionary as a Font; what is missing or malformed leaves a warning and a fallback."""
    spec = doc.resolve(spec)
    font = Font()
    if not isinstance(spec, dict):
        font.source = "fallback"
        font.warnings.append(("missing_font", "a font resource is missing", ""))
        return font
    font.name, font.subtype = str(doc.resolve(spec.get("BaseFont")) or ""), str(doc.resolve(spec.get("Subtype")) or "")
    font.composite = font.subtype == "Type0"
    inner = doc.get(spec, "DescendantFonts", 0) if font.composite else spec
    inner = inner if isinstance(inner, dict) else {}
    desc = doc.get(inner, "FontDescriptor")
    desc = desc if isinstance(desc, dict) else {}
    font.embedded = any(k in desc for k in ("FontFile", "FontFile2", "FontFile3")) or font.subtype == "Type3"
    to = doc.resolve(spec.get("ToUnicode"))
    if isinstance(to, Stream):
        try:
            cmap = E.CMap(doc.bytes(to), Lexer)
            if cmap.chars or cmap.ranges:
                font.cmap, font.source = cmap, "tounicode"
            else:
                raise ValueError("empty")
        except (ValueError, IndexError, TypeError):
            font.warnings.append(("bad_tounicode", "a font's map to text could not be read", font.name))
    enc = doc.resolve(spec.get("Encoding"))
    if font.composite:
        name = str(enc) if isinstance(enc, str) else str(enc.dict.get("CMapName", "")) if isinstance(enc, Stream) else ""
        if name.endswith("-V") or name == "V":
            font.vertical = True
            font.warnings.append(("vertical_writing_mode", "text is set in columns", font.name))
        if font.cmap is None:
            font.charset = E.charset(name)
            identity = ("Identity-H", "Identity-V")
            system = doc.get(inner, "CIDSystemInfo")
            registry, ordering = ((text(doc.resolve(system.get(k))) if isinstance(system, dict) else "") for k in ("Registry", "Ordering"))
            if font.charset:
                font.source = "ucs2" if font.charset == "utf-16-be" else "predefined"
            elif name in identity and to in identity and ordering == "Identity":
                font.charset, font.source = "utf-16-be", "ucs2"
            elif name in identity and registry == "Adobe" and E.adobe_cids(ordering):
                font.cids, font.source = E.adobe_cids(ordering), "cidmap"
                font.warnings.append(("fallback_encoding", "a font's codes are places of a character collection", f"{font.name} Adobe-{ordering}"))
            else:
                font.source = "none"
                font.warnings.append(("fallback_encoding", "a font has no map to text", f"{font.name} {name}"))
        elif font.cmap is not None and not font.cmap.spaces:
            font.cmap.spaces = {2: [(b"\0\0", b"\xff\xff")]}
        _cid_widths(doc, inner, font)
        return font
    _simple_table(doc, spec, font)
    if font.cmap is not None:
        font.source = "tounicode"
    first = doc.resolve(spec.get("FirstChar"))
    widths = doc.resolve(spec.get("Widths"))
    if isinstance(widths, list):
        for i, x in enumerate(widths):
            if isinstance(x := doc.resolve(x), (int, float)):
                font.widths[(first if isinstance(first, int) else 0) + i] = float(x)
    missing = doc.resolve(desc.get("MissingWidth"))
    font.default = float(missing) if isinstance(missing, (int, float)) else 0.0
    return font
