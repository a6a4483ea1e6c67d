"""Content streams: glyphs, rectangles, strokes and images of a page, and its strict plain text."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import accumulate

from pagemill.sources import fonts
from pagemill.sources.filters import FilterError, names
from pagemill.sources.objects import TOKEN, Document, Lexer, Name, Op, PdfError, Ref, Stream, box, rotation

#: A kern of so many thousandths or less is a blank. Forms nest so deeply.
BLANK, NEST = -120, 10

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1, 0, 0, 1, 0, 0)


def times(m: Matrix, n: Matrix) -> Matrix:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def page_matrix(rotate: int, media: list[float] | None) -> Matrix:
    """What turns a page upright, with its visible corner at the origin where it is turned."""
    x0, y0, x1, y1 = media or [0, 0, 612, 792]
    return {90: (0, -1, 1, 0, -y0, x1), 180: (-1, 0, 0, -1, x1, y1), 270: (0, 1, -1, 0, y1, -x0)}.get(rotate, UNIT)


@dataclass
class State:
    ctm: Matrix = UNIT
    font: fonts.Font | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0

    def copy(self) -> State:
        out = object.__new__(State)
        out.__dict__.update(self.__dict__)
        return out


@dataclass
class Page:
    """What a page's content draws."""

    glyphs: list[tuple] = field(default_factory=list)
    rects: list[tuple] = field(default_factory=list)
    strokes: list[tuple] = field(default_factory=list)
    images: list[tuple] = field(default_factory=list)
    fonts: dict[str, fonts.Font] = field(default_factory=dict)
    warnings: list[tuple[str, str, str]] = field(default_factory=list)
    shown: list[tuple[str, float, float]] = field(default_factory=list)
    text: str = ""
    error: str | None = None


class Interpreter:
    def __init__(self, doc: Document, out: Page, geometry: bool = True):
        self.doc, self.out, self.geometry = doc, out, geometry
        self.state, self.stack = State(), []
        self.tm = self.tlm = UNIT
        self.path: list[list[tuple[float, float]]] = []
        self.straight: list[bool] = []
        self.loaded: dict[int, fonts.Font] = {}
        self.plain: list[str] = []
        self.aslant = False

    # text

    def show(self, data: bytes) -> None:
        s = self.state
        font = s.font or fonts.Font(source="fallback")
        run = font.run(data)
        text = "".join([g[1] for g in run])
        self.plain.append(text)
        if not self.geometry:
            return
        self.out.shown.append((text, self.tm[4], self.tm[5]))
        m = times(self.tm, s.ctm)
        trm = times((s.size * s.scale, 0, 0, s.size, 0, s.rise), m)
        size, x, y = trm[0], trm[4], trm[5]
        height, turn = math.hypot(trm[2], trm[3]), math.degrees(math.atan2(trm[1], size))
        if not self.aslant:
            self.aslant = abs(turn) > 1 and bool(text.strip())
        # along a run only the place changes: by the advances so far, in the direction of writing
        dx, dy = (m[2], m[3]) if font.vertical else (m[0], m[1])
        if font.vertical:
            steps = [s.char - s.size] * len(run)
        elif s.word:
            steps = [(w / 1000 * s.size + s.char + (s.word if code == b" " else 0.0)) * s.scale for code, _, _, w in run]
        else:
            steps = [(g[3] / 1000 * s.size + s.char) * s.scale for g in run]
        name = font.name
        self.out.glyphs += [(t, name, size, x + far * dx, y + far * dy, w / 1000 * size, height, turn, kind) for (_, t, kind, w), far in zip(run, accumulate(steps, initial=0.0), strict=False)]
        far = sum(steps)
        self.tm = times((1, 0, 0, 1, 0, far) if font.vertical else (1, 0, 0, 1, far, 0), self.tm)

    def separator(self, text: str) -> None:
        s = self.state
        self.plain.append(text)
        if not self.geometry:
            return
        trm = times(times((s.size * s.scale, 0, 0, s.size, 0, s.rise), self.tm), s.ctm)
        self.out.glyphs.append((text, s.font.name if s.font else "", trm[0], trm[4], trm[5], 0.0, math.hypot(trm[2], trm[3]), math.degrees(math.atan2(trm[1], trm[0])), "separator"))

    def show_array(self, items: list) -> None:
        for x in items:
            if isinstance(x, bytes):
                self.show(x)
            elif isinstance(x, (int, float)):
                shift = -x / 1000 * self.state.size
                vertical = self.state.font is not None and self.state.font.vertical
                if x <= BLANK:
                    self.separator(" ")
                self.tm = times((1, 0, 0, 1, 0 if vertical else shift * self.state.scale, shift if vertical else 0), self.tm)
        self.separator("\n")

    def move(self, x: float, y: float) -> None:
        self.tlm = self.tm = times((1, 0, 0, 1, x, y), self.tlm)

    # paths

    def point(self, x: float, y: float) -> tuple[float, float]:
        return apply(self.state.ctm, x, y)

    def rect(self, x: float, y: float, w: float, h: float) -> None:
        c = [self.point(*p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
        self.out.rects.append((min(p[0] for p in c), min(p[1] for p in c), max(p[0] for p in c), max(p[1] for p in c)))

    def paint(self, close: bool, stroke: bool) -> None:
        if close and self.path and len(self.path[-1]) > 1:
            self.path[-1].append(self.path[-1][0])
        if stroke:
            for run in self.path:
                self.out.strokes += [(*a, *b) for a, b in zip(run, run[1:], strict=False) if a != b]
        self.path = []

    # images and forms

    def image(self, spec: dict) -> None:
        c = [self.point(*p) for p in ((0, 0), (1, 0), (1, 1), (0, 1))]
        x, y = min(p[0] for p in c), min(p[1] for p in c)
        kinds = names(spec, self.doc.resolve)
        dims = [self.doc.resolve(spec.get(a, spec.get(b))) for a, b in (("Width", "W"), ("Height", "H"))]
        self.out.images.append((x, y, max(p[0] for p in c) - x, max(p[1] for p in c) - y, kinds[0] if kinds else "", *[d if isinstance(d, int) else 0 for d in dims]))

    def draw(self, name: str, resources: dict, depth: int) -> None:
        x = self.doc.get(resources, "XObject", name)
        if not isinstance(x, Stream):
            return
        kind = self.doc.resolve(x.dict.get("Subtype"))
        if kind == "Image":
            self.image(x.dict)
        elif kind == "Form" and depth < NEST:
            m = self.doc.resolve(x.dict.get("Matrix"))
            m = tuple(float(self.doc.resolve(v)) for v in m) if isinstance(m, list) and len(m) == 6 else UNIT
            saved, tm = (self.state, list(self.stack)), (self.tm, self.tlm)
            self.state = State(**{**vars(self.state), "ctm": times(m, self.state.ctm)})
            own = self.doc.resolve(x.dict.get("Resources"))
            try:
                self.run(self.doc.bytes(x), own if isinstance(own, dict) else resources, depth + 1)
            finally:
                (self.state, self.stack), (self.tm, self.tlm) = saved, tm

    def font(self, name: str, resources: dict) -> fonts.Font:
        spec = self.doc.get(resources, "Font", name)
        if id(spec) not in self.loaded or spec is None:
            font = fonts.load(self.doc, spec)
            self.out.warnings += font.warnings
            if spec is None:
                return font
            self.loaded[id(spec)] = font
        font = self.loaded[id(spec)]
        self.out.fonts.setdefault(font.name, font)
        return font

    def run(self, data: bytes, resources: dict, depth: int = 0) -> None:
        lex, args, at, end = Lexer(data), [], 0, len(data)
        match = TOKEN.match
        while True:
            # numbers, plain strings and operators, of which most content is made, are read here, and all else by the lexer
            m = match(data, at)
            kind = m.lastindex if m else 0
            if kind == 2:
                number = m[2]
                args.append(float(number) if b"." in number else int(number))
                at = m.end()
                continue
            if kind == 6 and (op := m[6].decode("latin-1")) not in _NO_OPERATORS:
                at = m.end()
                if op == "BI":
                    lex.at = at
                    self.inline(lex)
                    at = lex.at
                else:
                    self.operator(op, args, resources, depth)
                args = []
                continue
            if kind == 1 and b"#" not in (name := m[1]):
                args.append(Name(name[1:].decode("utf-8", "surrogateescape")))
                at = m.end()
                continue
            if kind == 5 and (plain := _PLAIN.match(data, m.end())):
                args.append(plain[1])
                at = plain.end()
                continue
            if kind == 3 and m[3] == b"[" and (found := _items(data, m.end())):
                args.append(found[0])
                at = found[1]
                continue
            if kind == 6 and m[6] == b"R" and len(args) > 1 and type(args[-1]) is type(args[-2]) is int and args[-2] >= 0:
                lex.at, args[-2:] = m.end(), [Ref(*args[-2:])]
                at = lex.at
                continue
            lex.at = at
            x = lex.object()
            at = lex.at
            if x is None and at >= end:
                return
            if type(x) is not Op:
                args.append(x)
                continue
            self.operator(str(x), args, resources, depth)
            args = []

    def inline(self, lex: Lexer) -> None:
        spec: dict = {}
        while (k := lex.token()) is not None and k != "ID":
            if type(k) is Name:
                spec[str(k)] = lex.object()
        self.image(spec)
        at = lex.at + 1
        while True:
            at = lex.data.find(b"EI", at)
            if at < 0:
                lex.at = len(lex.data)
                return
            if lex.data[at - 1 : at] in (b"\n", b" ", b"\r") and lex.data[at + 2 : at + 3] in (b"", b"\n", b" ", b"\r", b"\t"):
                lex.at = at + 2
                return
            at += 2

    def operator(self, op: str, a: list, resources: dict, depth: int) -> None:
        s = self.state

        def num(n: int) -> list[float]:
            return [float(x) if isinstance(x, (int, float)) else _bad(op) for x in (a[-n:] if len(a) >= n else _bad(op))]

        if op == "re":
            self.rect(*num(4))
        elif op == "m":
            self.path.append([self.point(*num(2))])
        elif op == "l":
            if self.path:
                self.path[-1].append(self.point(*num(2)))
        elif op in _PAINTS:
            self.paint(op in ("s", "b", "b*"), _PAINTS[op])
        elif op == "q":
            self.stack.append(s.copy())
        elif op == "Q":
            if self.stack:
                self.state = self.stack.pop()
        elif op == "cm":
            s.ctm = times(tuple(num(6)), s.ctm)
        elif op == "BT":
            self.tm = self.tlm = UNIT
        elif op == "Tf":
            if len(a) < 2 or not isinstance(a[-2], str):
                _bad(op)
            s.font, s.size = self.font(a[-2], resources), num(1)[0]
        elif op in _SETS:
            key, by = _SETS[op]
            setattr(s, key, num(1)[0] * by)
        elif op == "Td":
            self.move(*num(2))
        elif op == "TD":
            x, y = num(2)
            s.leading = -y
            self.move(x, y)
        elif op == "Tm":
            self.tm = self.tlm = tuple(num(6))
        elif op == "T*":
            self.move(0, -s.leading)
        elif op in ("Tj", "'", '"'):
            if not a or not isinstance(a[-1], bytes):
                _bad(op)
            if op == '"':
                s.word, s.char = (float(x) if isinstance(x, (int, float)) else _bad(op) for x in (a[-3:-1] if len(a) >= 3 else _bad(op)))
            if op != "Tj":
                self.move(0, -s.leading)
                self.plain.append("\n")
            self.show(a[-1])
        elif op == "TJ":
            if not a or not isinstance(a[-1], list):
                _bad(op)
            self.show_array(a[-1])
        elif op in ("c", "v", "y"):
            self.path.append([self.point(*num(2))])
        elif op == "h":
            if self.path and len(self.path[-1]) > 1:
                self.path[-1].append(self.path[-1][0])
        elif op == "Do" and a and isinstance(a[-1], str):
            self.draw(a[-1], resources, depth)


def _items(data: bytes, at: int) -> tuple[list, int] | None:
    """An array of numbers and plain strings and where it ends; None if it holds anything else."""
    items, match = [], TOKEN.match
    while m := match(data, at):
        kind, at = m.lastindex, m.end()
        if kind == 2:
            number = m[2]
            items.append(float(number) if b"." in number else int(number))
        elif kind == 5 and (plain := _PLAIN.match(data, at)):
            items.append(plain[1])
            at = plain.end()
        elif kind == 3 and m[3] == b"]":
            return items, at
        else:
            return None
    return None


def _bad(op: str):
    raise PdfError(f"operator {op} has malformed operands")


_SETS = {"Tc": ("char", 1.0), "Tw": ("word", 1.0), "Tz": ("scale", 0.01), "TL": ("leading", 1.0), "Ts": ("rise", 1.0)}
#: Bare words that the lexer reads as objects, or that end them.
_NO_OPERATORS = frozenset(("null", "true", "false", "R"))
#: The rest of a string without escapes, parentheses and line ends that change.
_PLAIN = re.compile(rb"([^\\()\r]*+)\)")
_PAINTS = {"S": True, "s": True, "B": True, "B*": True, "b": True, "b*": True, "f": False, "F": False, "f*": False, "n": False}


def read_page(doc: Document, page: dict, geometry: bool = True) -> Page:
    """All that a page draws. A malformed operator ends its text with an error; what came before is kept.

    Without ``geometry`` glyphs are not placed, which is enough for the text.
    """
    out = Page()
    run = Interpreter(doc, out, geometry)
    media, turn = box(doc, page, "MediaBox"), rotation(doc, page)
    run.state.ctm = page_matrix(turn, media)
    body = doc.resolve(page.get("Contents"))
    parts = body if isinstance(body, list) else [body]
    resources = doc.resolve(page.get("Resources"))
    before = len(doc.warnings)
    try:
        data = b"\n".join(doc.bytes(p) for p in parts)
        run.run(data, resources if isinstance(resources, dict) else {})
        out.text = "".join(run.plain)
    except (PdfError, FilterError, ValueError, RecursionError, OverflowError) as e:
        out.error = str(e) or type(e).__name__
    out.warnings += [w[1:] for w in doc.warnings[before:]]
    if run.aslant:
        out.warnings.append(("rotated_text", "text is not set upright", ""))
    return out
