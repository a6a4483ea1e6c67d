"""The object layer of a PDF file: tokens, objects, cross-references, object streams and the page tree.

Numbers are int or float, strings bytes, names Name, arrays lists, dictionaries dicts with str keys, references
Ref, and streams Stream. Reading is lenient: an object that can't be read is None.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pagemill.sources.filters import FilterError, decode


class PdfError(ValueError):
    pass


class Name(str):
    __slots__ = ()


class Op(str):
    """An operator or other bare word."""

    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int


@dataclass
class Stream:
    dict: dict
    raw: bytes
    ref: Ref | None = None


_SPACE = b"\0\t\n\f\r "
_STOP = rb"\0\t\n\f\r ()<>\[\]{}/%"
# what is passed over is not tried again in smaller pieces
TOKEN = re.compile(rb"(?:[\0\t\n\f\r ]++|%[^\r\n]*+)*+(?:(/[^" + _STOP + rb"]*)|([+\-]?(?:\d+\.?\d*|\.\d+))(?=[" + _STOP + rb"]|$)|(<<|>>|[\[\]{}])|(<[0-9A-Fa-f\0\t\n\f\r ]*>?)|(\()|([^" + _STOP + rb"]+)|([)>]))")
_SPECIAL = re.compile(rb"[\\()\r]")
_HEX = re.compile(rb"#([0-9A-Fa-f]{2})")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
#: Nesting and chains beyond this are errors.
DEPTH = 1024
PAGES = 1 << 20


class Lexer:
    """Objects from bytes, from a place on. ``crypt`` decrypts strings."""

    def __init__(self, data: bytes, at: int = 0, crypt=None):
        self.data, self.at, self.crypt = data, at, crypt

    def token(self):
        """The next token, or None at the end."""
        m = TOKEN.match(self.data, self.at)
        if not m:
            self.at = len(self.data)
            return None
        self.at = m.end()
        kind = m.lastindex
        text = m[kind]
        if kind == 1:
            return Name(_HEX.sub(lambda h: bytes([int(h[1], 16)]), text[1:]).decode("utf-8", "surrogateescape"))
        if kind == 2:
            return float(text) if b"." in text else int(text)
        if kind == 4:
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", text)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if kind == 5:
            return self._literal()
        return Op(text.decode("latin-1"))

    def _literal(self) -> bytes:
        out, deep, d, i = bytearray(), 1, self.data, self.at
        while i < len(d):
            m = _SPECIAL.search(d, i)
            if not m:
                out += d[i:]
                i = len(d)
                break
            out += d[i : m.start()]
            c, i = d[m.start()], m.end()
            if c == 0x5C and i < len(d):
                e = d[i]
                i += 1
                if e in _ESCAPES:
                    out.append(_ESCAPES[e])
                elif 0x30 <= e <= 0x37:
                    j = i
                    while j < len(d) and j < i + 2 and 0x30 <= d[j] <= 0x37:
                        j += 1
                    out.append(int(d[i - 1 : j], 8) & 255)
                    i = j
                elif e == 13:
                    i += d[i : i + 1] == b"\n"
                elif e != 10:
                    out.append(e)
                continue
            if c == 0x28:
                deep += 1
            elif c == 0x29:
                deep -= 1
                if not deep:
                    break
            elif c == 13:
                i += d[i : i + 1] == b"\n"
                c = 10
            out.append(c)
        self.at = i
        return bytes(out)

    def object(self, depth: int = 0):
        """The next object; operators come back as Op, the end as None."""
        if depth > DEPTH:
            raise PdfError("objects are nested too deeply")
        t = self.token()
        if type(t) is int and t >= 0:
            m = _REF.match(self.data, self.at)
            if m:
                self.at = m.end()
                return Ref(t, int(m[1]))
        if type(t) is bytes:
            return self.crypt(t) if self.crypt else t
        if type(t) is not Op:
            return t
        if t == "<<":
            out: dict = {}
            while (k := self.token()) is not None and k != ">>":
                if type(k) is not Name:
                    continue
                v = self.object(depth + 1)
                if type(v) is Op:
                    if v == ">>":
                        break
                    continue
                out[str(k)] = v
            return out
        if t == "[":
            items: list = []
            while (v := self.object(depth + 1)) is not None or self.at < len(self.data):
                if type(v) is Op and v == "]":
                    break
                items.append(None if type(v) is Op else v)
            return items
        return {"null": None, "true": True, "false": False}.get(t, t)


_REF = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^" + _STOP + rb"])")
_HEADER = re.compile(rb"%PDF-(1\.[0-7]|2\.0)[\0\t\n\f\r ]")
_OBJECT = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj")


@dataclass
class Document:
    """A file's objects. ``passwords`` are tried in turn after the empty one."""

    data: bytes
    passwords: tuple[str, ...] = ()
    xref: dict[int, tuple] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    crypt: object = None
    warnings: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self._cache: dict[int, object] = {}
        self._busy: set[int] = set()
        self._packs: dict[int, dict[int, object]] = {}
        if not _HEADER.match(self.data):
            raise PdfError("not a PDF file: the header is malformed")
        self._read_xref(self._start())
        if "Root" not in self.trailer:
            raise PdfError("the trailer has no Root")
        if self.trailer.get("Encrypt") is not None:
            from pagemill.sources.crypt import open_security

            spec = self.trailer["Encrypt"]
            guard = spec.num if isinstance(spec, Ref) else None
            ids = self.resolve(self.trailer.get("ID")) or [b""]
            self.crypt = open_security(self.resolve(spec), self.resolve(ids[0]) or b"", self.passwords, self.resolve)
            self._cache.clear()
            self._packs.clear()
            if guard is not None:
                self.crypt.skip = guard

    def warn(self, code: str, message: str, detail: str = "", page: int = 0) -> None:
        self.warnings.append((page, code, message, detail))

    def _start(self) -> int:
        tail = self.data.rfind(b"startxref", max(0, len(self.data) - 1024))
        if tail < 0:
            end = self.data.rfind(b"%%EOF")
            tail = self.data.rfind(b"startxref", 0, end if end >= 0 else len(self.data))
        m = re.compile(rb"startxref[\0\t\n\f\r ]+(\d+)").match(self.data, max(tail, 0))
        if not m or int(m[1]) >= len(self.data):
            raise PdfError("no startxref that leads into the file")
        return int(m[1])

    def _read_xref(self, at: int) -> None:
        """All sections from the newest on; the first entry of an object holds."""
        seen: set[int] = set()
        todo = [at]
        while todo:
            at = todo.pop(0)
            if at in seen:
                raise PdfError("cross-reference sections form a cycle")
            seen.add(at)
            trailer = self._table(at) if re.compile(rb"[\0\t\n\f\r ]*xref").match(self.data, at) else self._xref_stream(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            if isinstance(x := trailer.get("XRefStm"), int):
                seen.add(x)
                self._xref_stream(x)
            if isinstance(p := trailer.get("Prev"), int) and 0 <= p < len(self.data):
                todo.append(p)

    def _table(self, at: int) -> dict:
        lex = Lexer(self.data, at)
        lex.token()
        while True:
            t = lex.token()
            if t == "trailer":
                break
            n = lex.token()
            if type(t) is not int or type(n) is not int:
                raise PdfError("a cross-reference section is malformed")
            for i in range(n):
                off, gen, kind = lex.token(), lex.token(), lex.token()
                if kind not in ("n", "f"):
                    raise PdfError("a cross-reference entry is malformed")
                self.xref.setdefault(t + i, ("at", off, gen) if kind == "n" else ("free",))
        trailer = lex.object()
        if not isinstance(trailer, dict):
            raise PdfError("no trailer dictionary")
        return trailer

    def _xref_stream(self, at: int) -> dict:
        stream = self._object_at(at, None, None)
        if not isinstance(stream, Stream) or stream.dict.get("Type") != "XRef":
            raise PdfError("no cross-reference section where one should be")
        d = stream.dict
        w = d.get("W")
        if not isinstance(w, list) or len(w) < 3 or not all(type(x) is int and 0 <= x <= 8 for x in w):
            raise PdfError("a cross-reference stream has malformed widths")
        body, size = decode(stream.dict, stream.raw, self.resolve), sum(w)
        index = d.get("Index") or [0, d.get("Size", 0)]
        pos = 0
        for first, n in zip(index[::2], index[1::2], strict=False):
            for i in range(n):
                row = body[pos : pos + size]
                if len(row) < size:
                    return d
                pos += size
                a, b = w[0], w[0] + w[1]
                kind = int.from_bytes(row[:a], "big") if a else 1
                x, y = int.from_bytes(row[a:b], "big"), int.from_bytes(row[b : b + w[2]], "big")
                self.xref.setdefault(first + i, {0: ("free",), 1: ("at", x, y), 2: ("in", x, y)}.get(kind, ("free",)))
        return d

    def _object_at(self, at: int, num: int | None, gen: int | None):
        m = _OBJECT.match(self.data, at)
        if not m or (num is not None and int(m[1]) != num):
            raise PdfError("no object where one should be")
        ref = Ref(int(m[1]), int(m[2]))
        crypt = self.crypt.string_reader(ref) if self.crypt is not None and ref.num != getattr(self.crypt, "skip", None) else None
        lex = Lexer(self.data, m.end(), crypt)
        obj = lex.object()
        if isinstance(obj, dict):
            s = re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)?").match(self.data, lex.at)
            if s:
                n = self.resolve(obj.get("Length"))
                end = s.end() + n if type(n) is int and n >= 0 else -1
                if end < 0 or not re.compile(rb"[\0\t\n\f\r ]*endstream").match(self.data, end):
                    end = self.data.find(b"endstream", s.end())
                    end = len(self.data) if end < 0 else end
                raw = self.data[s.end() : end]
                if self.crypt is not None and obj.get("Type") != "XRef":
                    raw = self.crypt.stream(ref, obj, raw)
                return Stream(obj, raw, ref)
        return None if type(obj) is Op else obj

    def resolve(self, obj, depth: int = 0):
        """What a reference leads to; anything else is itself; null if it can't be read."""
        while isinstance(obj, Ref):
            if depth > 64:
                return None
            depth += 1
            obj = self._load(obj)
        return obj

    def _load(self, ref: Ref):
        if ref.num in self._cache:
            return self._cache[ref.num]
        entry = self.xref.get(ref.num)
        if entry is None or entry[0] == "free" or ref.num in self._busy:
            return None
        self._busy.add(ref.num)
        try:
            out = self._object_at(entry[1], ref.num, entry[2]) if entry[0] == "at" else self._packed(entry[1]).get(ref.num)
        except (PdfError, FilterError, ValueError, RecursionError):
            out = None
        finally:
            self._busy.discard(ref.num)
        self._cache[ref.num] = out
        return out

    def _packed(self, num: int) -> dict[int, object]:
        """Objects of an object stream and of those that it extends."""
        if num in self._packs:
            return self._packs[num]
        out: dict[int, object] = {}
        seen: set[int] = set()
        while num is not None and num not in seen:
            seen.add(num)
            pack = self.resolve(Ref(num, 0))
            if not isinstance(pack, Stream):
                break
            body, first, n = self.bytes(pack), self.resolve(pack.dict.get("First")), self.resolve(pack.dict.get("N"))
            if type(first) is not int or type(n) is not int:
                break
            lex = Lexer(body[:first])
            heads = [(lex.token(), lex.token()) for _ in range(min(n, first))]
            for a, b in heads:
                if type(a) is int and type(b) is int and a not in out:
                    obj = Lexer(body, first + b).object()
                    out[a] = None if type(obj) is Op else obj
            up = pack.dict.get("Extends")
            num = up.num if isinstance(up, Ref) else None
        self._packs[min(seen) if seen else -1] = out
        return out

    def get(self, obj, *keys):
        """A value below a dictionary, through references."""
        for k in keys:
            obj = self.resolve(obj)
            obj = obj.dict if isinstance(obj, Stream) else obj
            obj = obj.get(k) if isinstance(obj, dict) else obj[k] if isinstance(obj, list) and type(k) is int and k < len(obj) else None
        return self.resolve(obj)

    def bytes(self, stream) -> bytes:
        """A stream's decoded bytes; filters that aren't known are passed over with a warning."""
        stream = self.resolve(stream)
        if not isinstance(stream, Stream):
            return b""
        return decode(stream.dict, stream.raw, self.resolve, lambda name: self.warn("unsupported_filter", "a stream filter is not supported", name))

    def pages(self):
        """(page number, dictionary or None) in order; a run of more than 1,024 missing ones ends them."""
        out: list = []
        root = self.get(self.trailer, "Root", "Pages")
        seen: set[int] = set()

        def walk(node, given: dict, depth: int) -> None:
            node = self.resolve(node)
            if depth > DEPTH or len(out) >= PAGES:
                return
            if not isinstance(node, dict) or id(node) in seen:
                out.append(None)
                return
            own = {**given, **{k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}}
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                seen.add(id(node))
                for kid in kids:
                    walk(kid, own, depth + 1)
                seen.discard(id(node))
            else:
                out.append({**own, **node, "__ref": id(node)})

        if isinstance(root, dict):
            walk(root, {}, 0)
        gone = 0
        for i, page in enumerate(out, 1):
            gone = 0 if page else gone + 1
            if gone > 1024:
                return
            yield i, page


def box(doc: Document, page: dict, key: str) -> list[float] | None:
    """A page's box as [left, bottom, right, top]; a crop box defaults to the media box."""
    v = doc.resolve(page.get(key))
    v = [doc.resolve(x) for x in v] if isinstance(v, list) else []
    if len(v) == 4 and all(isinstance(x, (int, float)) for x in v):
        return [float(min(v[0], v[2])), float(min(v[1], v[3])), float(max(v[0], v[2])), float(max(v[1], v[3]))]
    return box(doc, page, "MediaBox") if key == "CropBox" else None


def rotation(doc: Document, page: dict) -> int:
    v = doc.resolve(page.get("Rotate"))
    return v % 360 if isinstance(v, int) and v % 90 == 0 else 0


def text(value) -> str:
    """A text string: UTF-16 or UTF-8 with a byte order mark, else the document encoding."""
    from pagemill.sources.encodings import PDFDOC

    if isinstance(value, str):
        return value
    if not isinstance(value, bytes):
        return ""
    if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return value.decode("utf-16", "replace")
    if value[:3] == b"\xef\xbb\xbf":
        return value[3:].decode("utf-8", "replace")
    return "".join(PDFDOC[b] for b in value)
