"""Reading order of one page: glyphs to bands, words, lines, columns and blocks.

All functions work on one page's columns, in points with the origin at the bottom left.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

# Thresholds of the layout rules.
GRID = 0.05
BAND_TOLERANCE, BAND_LEAST = 0.5, 1.0
WORD_GAP_WIDTH, WORD_GAP_SIZE = 0.3, 0.15
GUTTER_GAP, GUTTER_MERGE, GUTTER_SHARE = 1.5, 2.0, 0.25
GUTTER_LEAST, GUTTER_BANDS, GUTTER_ZERO = 3, 4, 0.5
BLOCK_GAP = 0.6
TURNED, TURN_LEAST, ADVANCE = 10.0, 3, 1.5


def quantize(v: np.ndarray) -> np.ndarray:
    """Steps of the fine grid on which coordinates are compared; halves go away from zero."""
    v = np.asarray(v, float) / GRID
    return np.sign(v) * np.floor(np.abs(v) + 0.5)


def bands(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Rows of glyphs from top to bottom, each from left to right.

    A band reaches down from its first glyph by half that glyph's size (1 at least).
    """
    if not len(x):
        return []
    order = np.lexsort((x, -quantize(y)))
    out, start = [], 0
    ys = y[order]
    while start < len(order):
        reach = max(size[order[start]] * BAND_TOLERANCE, BAND_LEAST)
        below = np.flatnonzero(ys[start] - ys[start:] > reach)
        end = start + int(below[0]) if len(below) else len(order)
        band = order[start:end]
        # of glyphs that share a grid step, the upper one comes first
        out.append(band[np.lexsort((-y[band], quantize(x[band])))])
        start = end
    return out


@dataclass
class Word:
    s: str
    x: float
    y: float
    w: float
    h: float
    font: str
    size: float

    @property
    def right(self) -> float:
        return self.x + self.w


def words(band: list[int], s, x, y, w, h, font, size) -> list[Word]:
    """A band's words: white space ends one, and so does a gap beyond 0.3 of the next glyph's width and 0.15 of its size."""
    out: list[Word] = []
    fresh = True
    for i in band:
        if s[i] is None or s[i] in ("", "\n"):
            continue
        if s[i].isspace():
            fresh = True
            continue
        if fresh or x[i] - out[-1].right > max(w[i] * WORD_GAP_WIDTH, size[i] * WORD_GAP_SIZE):
            out.append(Word(s[i], x[i], y[i], w[i], h[i], font[i], size[i]))
            fresh = False
            continue
        word = out[-1]
        top = max(word.y + word.h, y[i] + h[i])
        word.s += s[i]
        word.w = max(word.w, x[i] + w[i] - word.x)
        word.y = min(word.y, y[i])
        word.h = top - word.y
    return out


def gutters(rows: list[list[Word]]) -> tuple[list[float], float]:
    """Where columns begin, and the gap that a crossing of columns shows; nothing where a page isn't clearly in columns."""
    every = [w for row in rows for w in row]
    wide = [w for w in every if w.w > 0]
    runes = sum(len(w.s) for w in wide)
    if len(rows) < GUTTER_BANDS or not runes or len(every) - len(wide) > GUTTER_ZERO * len(every):
        return [], 0.0
    mean = sum(w.w for w in wide) / runes
    gap, near = GUTTER_GAP * mean, GUTTER_MERGE * mean
    starts = [b.x for row in rows for a, b in zip(row, row[1:], strict=False) if b.x - a.right > gap]
    clusters: list[list[float]] = []  # running mean and support
    for x in starts:
        home = next((c for c in clusters if abs(x - c[0]) <= near), None)
        if home is None:
            clusters.append([x, 1])
        else:
            home[0] = (home[0] * home[1] + x) / (home[1] + 1)
            home[1] += 1
    least = max(GUTTER_LEAST, math.ceil(GUTTER_SHARE * len(rows)))
    out: list[float] = []
    for x in sorted(c[0] for c in clusters if c[1] >= least):
        if out and x - out[-1] <= near:
            out[-1] = (out[-1] + x) / 2
        else:
            out.append(x)
    return out, gap


def column_of(x: float, right: float, at: list[float], slack: float) -> int:
    """The column of a span: past each gutter that it starts beyond, or just before with most of it beyond."""
    n = 0
    for g in at:
        if not (x >= g - 1e-6 or (slack > 1e-6 and x >= g - slack and (x + right) / 2 > g)):
            break
        n += 1
    return n


def _spaceless(c: str) -> bool:
    """Whether a character is of a script that is set without blanks between words: Han or Kana."""
    o = ord(c)
    return 0x3041 <= o <= 0x30FF and o not in (0x30FB, 0x30FC, 0x3099, 0x309A, 0x309B, 0x309C, 0x30A0) or 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAD9 or 0x2E80 <= o <= 0x2FD5 or o in (0x3005, 0x3007) or 0x20000 <= o <= 0x323AF or 0xFF66 <= o <= 0xFF9D and o != 0xFF70 or 0x31F0 <= o <= 0x31FF


def joined(parts: list[str]) -> str:
    """Words with blanks between them, but for two characters of a spaceless script."""
    out = parts[0]
    for p in parts[1:]:
        out += p if out and p and _spaceless(out[-1]) and _spaceless(p[0]) else " " + p
    return out


@dataclass
class Line:
    words: list[Word]
    band: int
    column: int = 0
    block: int = 0
    x: float = field(init=False)
    y: float = field(init=False)
    w: float = field(init=False)
    h: float = field(init=False)

    def __post_init__(self) -> None:
        self.x, self.y = self.words[0].x, min(w.y for w in self.words)
        self.w = max(w.right for w in self.words) - self.x
        self.h = max(w.y + w.h for w in self.words) - self.y

    @property
    def s(self) -> str:
        return joined([w.s for w in self.words])


def lines(rows: list[list[Word]], at: list[float], gap: float) -> list[Line]:
    """Bands cut where a wide gap separates words of different columns."""
    slack = GUTTER_MERGE / GUTTER_GAP * gap
    out = []
    for b, row in enumerate(rows):
        parts = [[row[0]]]
        for prev, w in zip(row, row[1:], strict=False):
            apart = at and w.x - prev.right > gap and column_of(prev.x, prev.right, at, slack) != column_of(w.x, w.right, at, slack)
            parts.append([w]) if apart else parts[-1].append(w)
        out += [Line(p, b) for p in parts]
    return out


def place(found: list[Line], at: list[float], gap: float) -> None:
    """Columns and blocks of lines: column by column, a block ends at a gap beyond 0.6 of the taller line's height."""
    slack = GUTTER_MERGE / GUTTER_GAP * gap
    for line in found:
        line.column = column_of(line.x, line.x + line.w, at, slack)
    block = -1
    prev = None
    for line in sorted(found, key=lambda x: (x.column, -x.y)):
        if prev is None or prev.column != line.column:
            block += 1
        else:
            tall = max(prev.h, line.h)
            block += tall > 0 and prev.y - (line.y + line.h) > BLOCK_GAP * tall
        line.block, prev = block, line


def page_lines(s, x, y, w, h, font, size) -> list[Line]:
    """All lines of a page, in band order, with their columns and blocks."""
    x, y, w, h, size = (np.asarray(v, float) for v in (x, y, w, h, size))
    found = bands(x, y, size)
    columns = s, x.tolist(), y.tolist(), w.tolist(), h.tolist(), font, size.tolist()
    rows = [r for r in (words(b.tolist(), *columns) for b in found) if r]
    at, gap = gutters(rows)
    out = lines(rows, at, gap)
    place(out, at, gap)
    return out


def is_turned(s, rotation) -> bool:
    """Whether most of a page's glyphs, three at least, stand a quarter turn to the left."""
    real = [r for t, r in zip(s, rotation, strict=True) if t and t != "\n"]
    turned = sum(abs(r - 90) <= TURNED for r in real)
    return turned >= TURN_LEAST and 2 * turned > len(real)


def upright(x, y, w, h, size, rotation, bottom: float, right: float):
    """Columns x, y, w, h, size and rotation of a turned page, set upright.

    A turned glyph's size is its height, and its advance reaches to the next glyph in its row, one and a half sizes at most.
    """
    x, y, w, h, size, rotation = (np.array(v, float) for v in (x, y, w, h, size, rotation))
    nx, ny = y - bottom, right - x
    turned = np.flatnonzero(np.abs(rotation - 90) <= TURNED)
    tall = np.where(h > 0, h, 8.0)
    order = turned[np.lexsort((nx[turned], -np.round(ny[turned])))]
    start = 0
    while start < len(order):
        reach = max(tall[order[start]] / 2, 1.0)
        end = start + 1
        while end < len(order) and abs(ny[order[end]] - ny[order[start]]) <= reach:
            end += 1
        row = order[start:end][np.argsort(nx[order[start:end]], kind="stable")]
        step = tall[order[start]]
        for i, j in zip(row, [*row[1:], None], strict=True):
            gap = nx[j] - nx[i] if j is not None else 0.0
            step = min(gap, ADVANCE * tall[order[start]]) if gap > 0 else step
            w[i], size[i], h[i], rotation[i] = step, tall[i], tall[i], 0.0
        start = end
    return nx, ny, w, h, size, rotation
