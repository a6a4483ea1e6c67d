"""Ruled tables of one page: edges to cells, cells to tables, words to grids.

Coordinates have the origin at the top left, so that tops grow downwards.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache
from statistics import median
from typing import NamedTuple

from pagemill.functions.page_layout import Word

# Tolerances in points and shares of rows.
SNAP, SHORT, LEAST = 3.0, 1.0, 3.0
BAND, LINE, ABUT, WELD = 4.0, 5.0, 0.25, 4.0
RULE_SHARE, RULE_REACH, RULE_SLACK, RULE_EDGE = 0.5, 12.0, 0.75, 2.0
GUTTER, GUTTER_SHARE, NESTED, PHANTOM = 16.0, 0.25, 3.0, 0.6
OVERHANG, OPEN_WIDTH, OPEN_PAD, OPEN_BANDS = 6.0, 6.0, 2.0, 2
BODY_SHARE, BODY_ROWS, ROW_GAP = 0.6, 3, 4.0
HEADER_COLUMNS, HEADER_BANDS = 3, 2
COMB_COLUMNS, COMB_ROWS, COMB_STRADDLE, COMB_HALF = 2, 2, 0.5, 6.0
GARBLED, GARBLED_SHARE = 3, 0.3
COLUMN, RECORDS = 1.0, 4
#: Marks of a page whose cells are kept for pages that are ruled alike.
FORM = 500
# Families of fonts that set Indic scripts by Latin codes.
LEGACY_FONTS = ("krutidev", "kruti dev", "devlys", "chanakya", "walkman")


class Edge(NamedTuple):
    across: bool
    at: float
    lo: float
    hi: float


class Cell(NamedTuple):
    x0: float
    top: float
    x1: float
    bottom: float
    open: bool = False


@dataclass
class Table:
    cells: list[Cell]
    grid: list[list[str]]
    warnings: list[str] = field(default_factory=list)

    @property
    def confidence(self) -> str:
        return "low" if self.warnings else "high"

    @property
    def region(self) -> tuple[float, float, float, float]:
        return bounds(self.cells)


def bounds(cells: list[Cell]) -> tuple[float, float, float, float]:
    """Left, top, right and bottom of cells."""
    x0, top, x1, bottom, _ = zip(*cells, strict=True)
    return min(x0), min(top), max(x1), max(bottom)


def clusters(values: list[float], tolerance: float) -> list[float]:
    """Means of chains of sorted values whose neighbours are within the tolerance."""
    runs: list[list[float]] = []
    for v in sorted(values):
        if runs and v - runs[-1][-1] <= tolerance:
            runs[-1].append(v)
        else:
            runs.append([v])
    return [sum(r) / len(r) for r in runs]


def nearest(places: list[float], v: float) -> int:
    """The place, of ascending ones, that is nearest; the lower one of two."""
    i = bisect_left(places, v)
    return i - 1 if i and (i == len(places) or v - places[i - 1] <= places[i] - v) else i


def page_edges(strokes, rects) -> list[Edge]:
    """Strokes (x0, y0, x1, y1) along their longer axis, and the sides of rectangles (min_x, min_y, max_x, max_y)."""
    out = []
    for x0, y0, x1, y1 in strokes:
        if abs(x1 - x0) >= abs(y1 - y0):
            out.append(Edge(True, -(y0 + y1) / 2, min(x0, x1), max(x0, x1)))
        else:
            out.append(Edge(False, (x0 + x1) / 2, -max(y0, y1), -min(y0, y1)))
    for x0, y0, x1, y1 in rects:
        out += [Edge(True, -y1, x0, x1), Edge(True, -y0, x0, x1), Edge(False, x0, -y1, -y0), Edge(False, x1, -y1, -y0)]
    return [e for e in out if e.hi - e.lo >= SHORT]


def merged(edges: list[Edge]) -> list[Edge]:
    """Edges moved to common lines, and joined where they touch along one."""
    out = []
    for across in (False, True):
        mine = [e for e in edges if e.across == across]
        lines = clusters([e.at for e in mine], SNAP)
        by_line = defaultdict(list)
        for e in mine:
            by_line[nearest(lines, e.at)].append((e.lo, e.hi))
        for i, parts in sorted(by_line.items()):
            lo = hi = None
            for a, b in sorted(parts):
                if hi is not None and a <= hi + SNAP:
                    hi = max(hi, b)
                    continue
                if hi is not None:
                    out.append(Edge(across, lines[i], lo, hi))
                lo, hi = a, b
            out.append(Edge(across, lines[i], lo, hi))
    return [e for e in out if e.hi - e.lo >= LEAST]


def lattice(edges: list[Edge]) -> list[Cell]:
    """From each crossing the smallest rectangle that edges close: down as little as can be, then to the right."""
    down: dict[tuple[float, float], set[int]] = defaultdict(set)
    along: dict[tuple[float, float], set[int]] = defaultdict(set)
    flat = [(i, e) for i, e in enumerate(edges) if e.across]
    for i, v in enumerate(edges):
        if v.across:
            continue
        for j, h in flat:
            if v.lo <= h.at + SNAP and v.hi >= h.at - SNAP and h.lo - SNAP <= v.at <= h.hi + SNAP:
                p = (round(v.at, 2), round(h.at, 2))
                down[p].add(i)
                along[p].add(j)
    columns, rows = defaultdict(list), defaultdict(list)
    for x, y in sorted(down):
        columns[x].append(y)
        rows[y].append(x)
    for xs in rows.values():
        xs.sort()
    out = []
    for x, y in sorted(down):
        below = [(x, b) for b in columns[x] if b > y and down[x, b] & down[x, y]]
        right = [(r, y) for r in rows[y] if r > x and along[r, y] & along[x, y]]
        closed = ((b, r) for b in below for r in right if down.get((r[0], b[1]), set()) & down[r] and along.get((r[0], b[1]), set()) & along[b])
        if (hit := next(closed, None)) is not None:
            out.append(Cell(x, y, hit[1][0], hit[0][1]))
    return out


def grouped(cells: list[Cell]) -> list[list[Cell]]:
    """Cells that corners connect; a cell alone is no table."""
    home: dict[tuple[float, float], int] = {}
    up = list(range(len(cells)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, c in enumerate(cells):
        for corner in ((c.x0, c.top), (c.x0, c.bottom), (c.x1, c.top), (c.x1, c.bottom)):
            a, b = find(home.setdefault(corner, i)), find(i)
            up[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for i, c in enumerate(cells):
        out[find(i)].append(c)
    return [g for _, g in sorted(out.items()) if len(g) > 1]


def open_columns(cells: list[Cell], words: list[Word], flat: list[Edge], left_end: float, right_end: float) -> list[Cell]:
    """Cells beside a table that has no outer rule there.

    A row's two rules must reach beyond the table's side, with a word between them; two such rows make a column.
    """
    x0, top, x1, bottom = bounds(cells)
    near = [e for e in flat if top - SNAP <= e.at <= bottom + SNAP]
    steps = clusters([e.at for e in near], SNAP)
    beside = [w for w in words if top <= middle(w) <= bottom]
    out = []
    for left in (True, False):
        side = [w for w in beside if (w.x + w.w / 2 < x0 if left else w.x + w.w / 2 > x1)]
        if not side:
            continue
        a, b = (max(min(w.x for w in side) - OPEN_PAD, left_end), x0) if left else (x1, min(max(w.right for w in side) + OPEN_PAD, right_end))
        if b - a < OPEN_WIDTH:
            continue
        over = [any(abs(e.at - t) <= SNAP and (e.lo <= x0 - OVERHANG and e.hi >= x0 if left else e.hi >= x1 + OVERHANG and e.lo <= x1) for e in near) for t in steps]
        rows = [Cell(a, t, b, u, True) for i, (t, u) in enumerate(zip(steps, steps[1:], strict=False)) if over[i] and over[i + 1] and any(t <= middle(w) <= u for w in side)]
        if len(rows) >= OPEN_BANDS:
            out += rows
    return out


def split_rows(cells: list[Cell], words: list[Word], flat: list[Edge]) -> list[Cell]:
    """Cells of a body that is ruled in columns only, cut into the rows that its words form.

    The body's cells reach the table's foot, hold three rows of words each and most of the table's height; no rule
    crosses it, and most rows have words in two columns.
    """
    _, top, _, foot = bounds(cells)
    inside = {c: [middle(w) for w in _held(c, words)] for c in cells if abs(c.bottom - foot) <= SNAP}
    tall = [c for c in cells if c in inside and len(clusters(inside[c], ROW_GAP)) >= BODY_ROWS]
    if len({c.x0 for c in tall}) < 2:
        return cells
    start = min(c.top for c in tall)
    left, right = min(c.x0 for c in tall), max(c.x1 for c in tall)
    crossed = any(start + SNAP < e.at < foot - SNAP and e.hi > left and e.lo < right for e in flat)
    rows = clusters([m for c in tall for m in inside[c]], ROW_GAP)
    shared = sum(sum(any(abs(m - r) <= ROW_GAP for m in inside[c]) for c in tall) >= 2 for r in rows)
    if foot - start < BODY_SHARE * (foot - top) or crossed or len(rows) < BODY_ROWS or 2 * shared <= len(rows):
        return cells
    cuts = [(a + b) / 2 for a, b in zip(rows, rows[1:], strict=False)]
    out = [c for c in cells if c not in tall]
    for c in tall:
        at = [c.top, *(x for x in cuts if c.top < x < c.bottom), c.bottom]
        out += [Cell(c.x0, a, c.x1, b, c.open) for a, b in zip(at, at[1:], strict=False)]
    return out


def banded_rows(cells: list[Cell], rects) -> list[Cell]:
    """Cells cut at the steps of fills that share the table's foot and one another's sides, each shorter than the last.

    The steps must be regular (no gap beyond twice the median) and span most of the table's height.
    """
    left, top, right, foot = bounds(cells)
    fills = [(x0, -y1, x1) for x0, y0, x1, y1 in rects if abs(-y0 - foot) <= SNAP and x1 >= left - SNAP and x0 <= right + SNAP and top + SNAP <= -y1 < foot - SNAP]
    if any(len(clusters([f[i] for f in fills], SNAP)) != 1 for i in (0, 2)):
        return cells
    steps = clusters([f[1] for f in fills], SNAP)
    gaps = sorted(b - a for a, b in zip(steps, steps[1:], strict=False))
    if len(steps) < BODY_ROWS or steps[-1] - steps[0] < BODY_SHARE * (foot - top) or gaps[-1] > 2 * gaps[len(gaps) // 2]:
        return cells
    out = []
    for c in cells:
        at = [c.top, *(t for t in steps if c.top + SNAP < t < c.bottom - SNAP), c.bottom]
        out += [Cell(c.x0, a, c.x1, b, c.open) for a, b in zip(at, at[1:], strict=False)]
    return out


def filled_body(cells: list[Cell], words: list[Word], rects, rules: list[Edge]) -> list[Cell]:
    """The body of a table that a fill for each cell makes, on a page without strokes.

    The body reaches over the rows of fills in two columns or more. Banners above and below go, and rows without words at
    its foot; where none lies outside, the table stays as it is. A header with sides that no row below has is one cell. Cells
    are cut where a rule that other cells have for a side parts their words, and between rows of figures that they collapse.
    """
    left, top, right, foot = bounds(cells)
    fills = [(x0, -y1, -y0) for x0, y0, x1, y1 in rects if x0 >= left - SNAP and x1 <= right + SNAP and -y1 >= top - SNAP and -y0 <= foot + SNAP]
    lines = clusters([f[1] for f in fills], SNAP)
    wide = [at for at in lines if len(clusters([f[0] for f in fills if abs(f[1] - at) <= SNAP], COLUMN)) >= 2]
    if not wide:
        return cells
    start, end = min(wide), max(f[2] for f in fills if any(abs(f[1] - at) <= SNAP for at in wide))
    body = [c for c in cells if start <= (c.top + c.bottom) / 2 <= end]
    if len(body) == len(cells) or len(clusters([c.x0 for c in body], COLUMN)) < 2:
        return cells
    while True:
        low = max(c.top for c in body)
        last = [c for c in body if abs(c.top - low) <= SNAP]
        if len(last) == len(body) or any(_held(c, words) for c in last):
            break
        body = [c for c in body if c not in last]
    return _tall_cut(_wide_cut(_one_header(body), words, rules), words)


def _one_header(cells: list[Cell]) -> list[Cell]:
    """Cells with the first row as one cell, if it has a side within that no other row has."""
    high = min(c.top for c in cells)
    head = [c for c in cells if abs(c.top - high) <= SNAP]
    rest = [c for c in cells if c not in head]
    sides = [x for c in rest for x in (c.x0, c.x1)]
    strange = any(all(abs(c.x0 - x) > SNAP for x in sides) for c in head if c.x0 > min(h.x0 for h in head))
    if not rest or not strange:
        return cells
    return [Cell(min(c.x0 for c in head), min(c.top for c in head), max(c.x1 for c in head), max(c.bottom for c in head)), *rest]


def _wide_cut(cells: list[Cell], words: list[Word], rules: list[Edge]) -> list[Cell]:
    """Cells cut at rules that are other cells' sides, have words on either side, and cross no word."""
    out = []
    for c in cells:
        inner = sorted({r.at for r in rules if c.x0 + SNAP < r.at < c.x1 - SNAP})
        own = _held(c, words) if inner else []
        sides = [x for o in cells if o is not c for x in (o.x0, o.x1)] if inner else []
        at = [c.x0]
        for x in inner:
            parted = any(w.right <= x + COMB_STRADDLE for w in own) and any(w.x >= x - COMB_STRADDLE for w in own)
            crossed = any(w.x < x - COMB_STRADDLE and w.right > x + COMB_STRADDLE for w in own)
            if parted and not crossed and any(abs(x - s) <= SNAP for s in sides):
                at.append(x)
        out += [Cell(a, c.top, b, c.bottom) for a, b in zip(at, [*at[1:], c.x1], strict=True)]
    return out


_DIGIT = re.compile(r"\d")


def _tall_cut(cells: list[Cell], words: list[Word]) -> list[Cell]:
    """Cells cut between the rows of figures that they hold, if these are RECORDS at least and reach over columns."""
    columns = clusters([c.x0 for c in cells], COLUMN)
    inside = [(middle(w), max(bisect_right(columns, w.x + w.w / 2) - 1, 0), w.s) for w, i in zip(words, _homes(cells, words), strict=True) if i is not None]
    records = []
    for band in clusters([m for m, _, _ in inside], ROW_GAP):
        row = [(column, s) for m, column, s in inside if abs(m - band) <= ROW_GAP]
        if len({column for column, _ in row}) >= 2 and any(_DIGIT.search(s) for _, s in row):
            records.append(band)
    out = []
    for c in cells:
        own = [r for r in records if c.top < r < c.bottom]
        at = [c.top, *((a + b) / 2 for a, b in zip(own, own[1:], strict=False)), c.bottom] if len(own) >= RECORDS else [c.top, c.bottom]
        out += [Cell(c.x0, a, c.x1, b, c.open) for a, b in zip(at, at[1:], strict=False)]
    return out


def header_columns(cells: list[Cell], words: list[Word]) -> list[Cell]:
    """Cells under a header of three columns or more whose body is ruled in the label column only.

    A column gets a cell beside each label if words that no cell holds stand beside two labels at least.
    """
    rows = clusters([c.top for c in cells], BAND)
    by_row = defaultdict(list)
    for c in cells:
        by_row[nearest(rows, c.top)].append(c)
    head = next((r for r in range(len(rows) - 1, -1, -1) if len(by_row[r]) >= HEADER_COLUMNS), None)
    if head is None:
        return []
    heads = sorted(by_row[head], key=lambda c: c.x0)
    labels = sorted((c for r in range(head + 1, len(rows)) for c in by_row[r]), key=lambda c: c.top)
    if not labels or any(abs(c.x0 - heads[0].x0) > SNAP or c.x1 > heads[0].x1 + SNAP for c in labels):
        return []
    lost = [w for w, i in zip(words, _homes(cells, words), strict=True) if i is None]
    out = []
    for h in heads[1:]:
        column = [Cell(h.x0, c.top, h.x1, c.bottom) for c in labels]
        if sum(any(_holds(c, w) for w in lost) for c in column) >= HEADER_BANDS:
            out += column
    return out


def comb_body(cells: list[Cell], words: list[Word], edges: list[Edge], others: list[list[Cell]]) -> list[Cell]:
    """Rows below a closed header that vertical rules alone run on from.

    Two rules at least must cross the header's foot between its sides, no other table or word may cross them, and two rows must
    have words in two columns beside the first.
    """
    foot = max(c.bottom for c in cells)
    under = max((e for e in edges if e.across and abs(e.at - foot) <= SNAP), key=lambda e: e.hi - e.lo, default=None)
    if under is None:
        return []
    left, right = under.lo, under.hi
    teeth = [e for e in edges if not e.across and e.lo <= foot + SNAP < e.hi and left + 1 < e.at < right - 1]
    if len(teeth) < COMB_COLUMNS:
        return []
    end = max(e.hi for e in teeth)
    if any(foot < (c.top + c.bottom) / 2 < end and left < (c.x0 + c.x1) / 2 < right for o in others for c in o):
        return []
    cuts = sorted({left, *(e.at for e in teeth)})
    body = [w for w in words if foot < middle(w) <= end and left <= w.x + w.w / 2 <= right]
    if any(w.x < x - COMB_STRADDLE and w.right > x + COMB_STRADDLE for w in body for x in cuts[1:]):
        return []
    spans = list(zip(cuts, [*cuts[1:], right], strict=True))
    bands = clusters([middle(w) for w in body], ROW_GAP)
    filled = [{i for w in body if nearest(bands, middle(w)) == b for i, (x0, x1) in enumerate(spans) if x0 <= w.x + w.w / 2 < x1} - {0} for b in range(len(bands))]
    if sum(len(f) >= 2 for f in filled) < COMB_ROWS:
        return []
    return [Cell(x0, b - COMB_HALF, x1, b + COMB_HALF) for b in bands for x0, x1 in spans]


def legacy_text(cells: list[Cell], words: list[Word]) -> bool:
    """Whether a table's words come garbled from a font that sets an Indic script by Latin codes."""
    fonts = {f for f in {w.font for w in words} if any(name in (f or "").lower() for name in LEGACY_FONTS)}
    if not fonts:
        return False
    alpha = [w for w, i in zip(words, _homes(cells, words), strict=True) if i is not None and re.search(r"[^\W\d_]", w.s)]
    legacy = [w for w in alpha if w.font in fonts]
    garbled = sum(not re.search("[\u0900-\u0dff]", w.s) or bool(re.search("[A-Za-z]", w.s)) for w in legacy)
    broken = any(re.search("\u094d[\u093e-\u094c]", w.s) for w in legacy)
    return broken or (garbled >= GARBLED and garbled >= GARBLED_SHARE * len(alpha))


def middle(w: Word) -> float:
    """The height of a word's centre."""
    return -(w.y + w.h / 2)


_LEADER = re.compile(r"\.{4,}")


def welded(cells: list[Cell], words: list[Word], rules: list[Edge]) -> list[Word]:
    """Words of a table's height joined where they touch in a row, unless a vertical rule stands between them."""
    _, top, _, bottom = bounds(cells)
    inside = [top <= middle(w) <= bottom and not _LEADER.fullmatch(w.s) for w in words]
    out = [w for w, i in zip(words, inside, strict=True) if not i]
    rows: list[list[Word]] = []
    first = 0.0
    for w in sorted((w for w, i in zip(words, inside, strict=True) if i), key=middle):
        if rows and middle(w) - first <= LINE:
            rows[-1].append(w)
        else:
            rows.append([w])
            first = middle(w)
    for row in rows:
        row.sort(key=lambda w: w.x)
        run = [row[0]]
        for w in row[1:]:
            last = run[-1]
            ruled = any(last.right <= r.at <= w.x and r.lo <= middle(last) <= r.hi for r in rules)
            if w.x - last.right <= ABUT and not ruled:
                x, y = min(last.x, w.x), min(last.y, w.y)
                run[-1] = Word(last.s + w.s, x, y, max(last.right, w.right) - x, max(last.y + last.h, w.y + w.h) - y, last.font, last.size)
            else:
                run.append(w)
        out += run
    return out


def columns(cells: list[Cell], words: list[Word], rules: list[Edge], rows: list[float]) -> tuple[list[float], list[int]]:
    """Places of columns, and each cell's column.

    A column that few rows have and that holds words may be a heading set off from the rule on its left: it moves to that rule.
    """
    raw = clusters([c.x0 for c in cells], BAND)
    home = [nearest(raw, c.x0) for c in cells]
    left, top, right, bottom = bounds(cells)
    long = [r.at for r in rules if left - RULE_EDGE <= r.at <= right + RULE_EDGE and min(r.hi, bottom) - max(r.lo, top) >= RULE_SHARE * (bottom - top)]
    walls = clusters(long, BAND)
    to = list(raw)
    for i, x in enumerate(raw):
        own = [c for c, h in zip(cells, home, strict=True) if h == i]
        sparse = len({nearest(rows, c.top) for c in own}) < RULE_SHARE * len(rows)
        if sparse and any(_held(c, words) for c in own):
            wall = max((r for r in walls if r <= x + RULE_SLACK), default=None)
            if wall is not None and x - wall <= RULE_REACH:
                to[i] = wall
    places = clusters(to, BAND)
    return places, [nearest(places, to[h]) for h in home]


def _holds(c: Cell, w: Word) -> bool:
    return c.x0 <= w.x + w.w / 2 <= c.x1 and c.top <= middle(w) <= c.bottom


def _held(c: Cell, words: list[Word]) -> list[Word]:
    """The words whose centres a cell holds."""
    x0, top, x1, bottom, _ = c
    return [w for w in words if x0 <= w.x + w.w / 2 <= x1 and top <= -(w.y + w.h / 2) <= bottom]


def _homes(cells: list[Cell], words: list[Word]) -> list[int | None]:
    """The first cell that holds each word's centre."""
    out: list[int | None] = []
    for w in words:
        x, y, home = w.x + w.w / 2, -(w.y + w.h / 2), None
        for i, (x0, top, x1, bottom, _) in enumerate(cells):
            if x0 <= x <= x1 and top <= y <= bottom:
                home = i
                break
        out.append(home)
    return out


def reading(words: list[Word]) -> str:
    """Words line by line, where centres are further apart than a line's step, each from left to right."""
    lines: list[list[Word]] = []
    for w in sorted(words, key=middle):
        if lines and middle(w) - middle(lines[-1][-1]) <= LINE:
            lines[-1].append(w)
        else:
            lines.append([w])
    return " ".join(w.s for line in lines for w in sorted(line, key=lambda w: w.x))


def tidy(words: list[Word]) -> str:
    """A cell's text without dot leaders."""
    kept = [w for w in words if not _LEADER.fullmatch(w.s)] or words
    text = kept[0].s if len(kept) == 1 else reading(kept)
    if "..." in text and re.search(r"[^\W\d_]\.{3,}[^\W\d_]", text):
        text = re.sub(r"(?<![0-9])\.|\.(?![0-9])", "", text)
    return text


def grid_of(cells: list[Cell], words: list[Word], rules: list[Edge]) -> list[list[str]]:
    """A table's rows of texts."""
    words = welded(cells, words, rules)
    rows = clusters([c.top for c in cells], BAND)
    closed = [c for c in cells if not c.open]
    places, own = columns(closed, words, rules, rows)
    # open columns stand apart from closed ones, however near
    beside = clusters([c.x0 for c in cells if c.open], BAND)
    order = sorted([(x, 0, i) for i, x in enumerate(places)] + [(x, 1, i) for i, x in enumerate(beside)])
    rank = {(kind, i): n for n, (_, kind, i) in enumerate(order)}
    it = iter(own)
    column = [rank[1, nearest(beside, c.x0)] if c.open else rank[0, next(it)] for c in cells]
    places = [x for x, _, _ in order]
    held: dict[tuple[int, int], list[Word]] = defaultdict(list)
    walls: dict[int, tuple[tuple[int, int], float]] = {}
    missed = []
    line = [nearest(rows, c.top) for c in cells]
    for w, i in zip(words, _homes(cells, words), strict=True):
        if i is None:
            missed.append(w)
            continue
        key = (line[i], column[i])
        held[key].append(w)
        walls[id(w)] = key, cells[i].x1
    _weld_digits(held, walls, missed, cells, rows)
    text = [[tidy(held[r, c]) if (r, c) in held else "" for c in range(len(places))] for r in range(len(rows))]
    ends: dict[int, list[float]] = defaultdict(list)
    for x, k in zip(cells, column, strict=True):
        ends[k].append(x.x1)
    spans = [(places[c], max(ends[c])) for c in range(len(places))]
    leaves = [min(ends[c]) for c in range(len(places))]
    keep = _data_columns(text, spans)
    text = [[row[c] for c in keep] for row in text]
    return _unnested(text, [leaves[c] for c in keep])


def _weld_digits(held, walls, missed: list[Word], cells: list[Cell], rows: list[float]) -> None:
    """Digits that straddle a cell's right wall join the digits that they follow there."""
    if not missed:
        return
    placed = [(w, *walls[id(w)]) for ws in list(held.values()) for w in ws]
    for w in missed:
        own = next((c for c in cells if c.top <= middle(w) <= c.bottom), None)
        if own is None or not re.fullmatch(r"[0-9]+", w.s):
            continue
        r = nearest(rows, own.top)
        left = [p for p in placed if p[1][0] == r and p[0].right <= w.x]
        if not left:
            continue
        near, key, wall = max(left, key=lambda p: p[0].right)
        straddles = w.x < wall < w.x + w.w / 2
        if re.fullmatch(r"[0-9]+", near.s) and w.x - near.right <= WELD and straddles and not any(p[1] == key and p[0].right > w.x for p in placed):
            held[key].append(w)


def _data_columns(text: list[list[str]], spans: list[tuple[float, float]]) -> list[int]:
    """Columns but those blank ones that are narrow gutters or span a column with data."""
    n = len(spans)
    blank = [all(not row[c].strip() for row in text) for c in range(n)]
    width = [b - a for a, b in spans]
    full = [c for c in range(n) if not blank[c]]
    if not full:
        return list(range(n))
    mid = median(width[c] for c in full)

    def gutter(c: int) -> bool:
        narrow = 0 < width[c] < GUTTER and width[c] < GUTTER_SHARE * mid
        around = any(spans[c][0] <= spans[f][0] + BAND and spans[c][1] >= spans[f][1] - BAND and width[c] > width[f] for f in full)
        return blank[c] and (narrow or around)

    return [c for c in range(n) if not gutter(c)]


def _unnested(text: list[list[str]], right: list[float]) -> list[list[str]]:
    """Neighbours that end together and never both have text are one column, if one of them is nearly empty."""
    c = 0
    while c + 1 < len(right):
        pair = [(row[c], row[c + 1]) for row in text]
        n = sorted(sum(bool(p[k]) for p in pair) for k in (0, 1))
        if abs(right[c] - right[c + 1]) <= NESTED and not any(a and b for a, b in pair) and n[0] <= 2 and n[1] >= 3:
            text = [[*row[:c], row[c] or row[c + 1], *row[c + 2 :]] for row in text]
            right = [*right[:c], max(right[c : c + 2]), *right[c + 2 :]]
            c = 0
        else:
            c += 1
    return text


@lru_cache(maxsize=256)
def _ruled(strokes: tuple, rects: tuple) -> tuple[list[Edge], list[list[Cell]]]:
    """A page's edges and the cells that they close; pages of one form share them, so those of the latest forms are kept."""
    edges = merged(page_edges(strokes, rects))
    return edges, grouped(lattice(edges))


def page_tables(words: list[Word], strokes, rects, left: float = float("-inf"), right: float = float("inf")) -> list[Table]:
    """A page's ruled tables, from the top; those without any text are passed over. ``left`` and ``right`` are the page's sides."""
    strokes, rects = tuple(map(tuple, strokes)), tuple(map(tuple, rects))
    edges, closed = (_ruled if len(strokes) + len(rects) <= FORM else _ruled.__wrapped__)(strokes, rects)
    rules, flat = [e for e in edges if not e.across], [e for e in edges if e.across]
    out = []
    for found in closed:
        cells = found + open_columns(found, words, flat, left, right)
        cells = split_rows(cells, words, flat)
        cells = banded_rows(cells, rects)
        if not strokes:
            cells = filled_body(cells, words, rects, rules)
        cells = cells + header_columns(cells, words)
        cells = cells + comb_body(cells, words, edges, [o for o in closed if o is not found])
        grid = grid_of(cells, words, rules)
        if not any(t.strip() for row in grid for t in row):
            continue
        blank = sum(all(not row[c].strip() for row in grid) for c in range(len(grid[0])))
        warnings = ["phantom_columns"] * (blank >= PHANTOM * len(grid[0])) + ["legacy_font"] * legacy_text(cells, words)
        out.append(Table(cells, grid, warnings))
    return sorted(out, key=lambda t: (t.region[1], t.region[0]))
