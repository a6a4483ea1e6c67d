"""License notices: exact phrases, and short notices within a bounded number of edits."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import kernels as K

#: Phrases whose words stand consecutively, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices, as words joined by blanks, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license version 3": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution": "cc",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 12

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"


def allowed(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def seeds(notice: str) -> list[tuple[int, str]]:
    """The notice cut into one piece more than its edits: a match has at least one of them unchanged."""
    n = allowed(notice) + 1
    cuts = [round(i * len(notice) / n) for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def _searcher(notices: tuple[str, ...]):
    import ahocorasick
    import regex

    at: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices):
        for o, piece in seeds(notice):
            at.setdefault(piece, []).append((i, o))
    auto = ahocorasick.Automaton()
    for piece, where in at.items():
        auto.add_word(piece, (len(piece), where))
    auto.make_automaton()
    return auto, [regex.compile(f"(?b)(?:{regex.escape(n, special_only=True)}){{e<={allowed(n)}}}") for n in notices]


def _collapsed(low: np.ndarray, first: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, each followed by a blank, and every word's start in them."""
    n = e - s
    to = np.cumsum(n + 1) - (n + 1)
    out = np.full(int((n + 1).sum()), 0x20, np.uint8)
    inside = low != 0
    out[np.repeat(to - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = low[inside]
    return out, to


def _fuzzy(text: str, to: np.ndarray, first: np.ndarray, notices: tuple[str, ...]):
    """(row, notice, first word, last word, edits) of the best match around each group of seeds."""
    auto, patterns = _searcher(notices)
    spots: dict[tuple[int, int], list[list[int]]] = {}
    row_at = np.append(to, len(text))[first]
    for end, (n, where) in auto.iter(text):
        begin = end + 1 - n
        row = int(np.searchsorted(row_at, begin, "right")) - 1
        for i, o in where:
            k = allowed(notices[i])
            lo, hi = max(int(row_at[row]), begin - o - k), min(int(row_at[row + 1]), begin - o + len(notices[i]) + k)
            group = spots.setdefault((row, i), [])
            if group and lo <= group[-1][1] and begin - o - group[-1][2] <= 2 * k:
                group[-1][1] = max(hi, group[-1][1])
            else:
                group.append([lo, hi, begin - o])
    found: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for (row, i), group in spots.items():
        for lo, hi, _ in group:
            # whole words, so that the bytes are whole characters
            a, b = text.rfind(" ", 0, lo) + 1, text.find(" ", hi)
            a, b = max(a, int(row_at[row])), int(row_at[row + 1]) if b < 0 else min(b, int(row_at[row + 1]))
            window = text[a:b].encode("latin-1").decode("utf-8", "replace")
            if m := patterns[i].search(window):
                x, y = (a + len(window[:p].encode()) for p in m.span())
                word = lambda p: int(np.searchsorted(to, p, "right")) - 1 - int(first[row])
                found.setdefault(row, []).append((sum(m.fuzzy_counts), -len(notices[i]), i, word(x), word(max(x, y - 1))))
    # of notices that overlap, the one with the fewest edits, then the longest, stands
    for row, near in found.items():
        taken: list[tuple[int, int]] = []
        for edits, _, i, x, y in sorted(near):
            if all(y < a or x > b for a, b in taken):
                taken.append((x, y))
                yield row, i, x, y, edits


def _scan(base: dict[str, str], notices: dict[str, str]):
    phrases = [([K.hash_of(w) for w in p.split()], p.encode(), label) for p, label in base.items()]
    order = tuple(notices)

    def run(batches):
        for batch in batches:
            raw, off = K.spans(batch.column("text"))
            rows = []
            for i, j in K.slices(off):
                low = K.ALNUM[raw[off[i] : off[j]]]
                first, s, e = K.word_spans(low, off[i : j + 1] - off[i])
                h = K.hashes(low, s, e) if len(s) else np.zeros(0, np.uint64)
                places: dict[int, list[tuple[int, str]]] = {}
                for words, said, label in phrases:
                    for at in np.flatnonzero(h[: max(0, len(h) - len(words) + 1)] == words[0]):
                        row = int(np.searchsorted(first, at, "right")) - 1
                        if at + len(words) <= first[row + 1] and (h[at : at + len(words)] == words).all() and b" ".join(low[x:y].tobytes() for x, y in zip(s[at : at + len(words)], e[at : at + len(words)], strict=True)) == said:
                            places.setdefault(row, []).append((int(at - first[row]), label))
                flat, to = _collapsed(low, first, s, e)
                more: dict[int, list[tuple]] = {}
                for row, k, x, y, edits in _fuzzy(flat.tobytes().decode("latin-1"), to, first, order) if len(s) else ():
                    more.setdefault(row, []).append((notices[order[k]], x, y, edits, 1 - edits / len(order[k])))
                for r in range(j - i):
                    hit, near = places.get(r, []), more.get(r, [])
                    exact = {label for _, label in hit}
                    score = 1.0 if hit else max((x[4] for x in near), default=0.0)
                    rows.append((int(first[r + 1] - first[r]), len(hit), min(hit)[0] if hit else None, max(hit)[0] if hit else None, ",".join(sorted(exact)), ",".join(sorted(exact | {x[0] for x in near})), score, [{"label": a, "first_word": x, "last_word": y, "edits": k} for a, x, y, k, _ in sorted(near, key=lambda x: x[1:])]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """License labels of every document, from its whole text.

    Words are runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased.
    n_base counts the places of the ``base`` phrases, first_word and last_word are the least and
    greatest of their starts. A notice is found with up to ``allowed(notice)`` edits: an
    Aho-Corasick pass finds exact pieces of it, the regex library's bounded-error search verifies
    the text around them, and ``spans`` reports label, word span and edits. The score is 1 with a
    base phrase, else the best notice's share of unedited characters, else 0.

    A null text is empty (no labels, empty strings, null words); rows that repeat are each scanned;
    an empty table gives an empty one; only ``doc_id`` and ``text`` are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(base or BASE, notices or NOTICES), SCHEMA)
