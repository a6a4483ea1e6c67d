"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import kernels as K

#: Words of a shingle; share of an item's shingles that a document must hold.
WORDS, SHARE = 5, 0.8
#: Items of fewer shingles have to be held whole at that share, so a lookup of any one shingle finds them all.
FEW = 5
#: Chance that the search misses a passage at the threshold.
MISS = 1e-4
#: Items go out with the tasks in blocks of at most about so many bytes of text.
ITEM_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"
_U, _W = np.uint64, np.uint32


def _hash_count() -> int:
    """Hash functions that a partition needs.

    An item of q shingles is sought in windows of 2 w, w/2 < q <= w, so a window that holds a
    share t of them has a similarity of at least t (w/2) / (2 w + w/2 - t w/2).
    """
    j = SHARE / 2 / (2 + (1 - SHARE) / 2)
    return math.ceil(math.log(MISS) / math.log(1 - j))


class Index:
    """The items of a block: shingle sets, and by size partition the least hash values of each function."""

    def __init__(self, items: list[tuple[int, str]]):
        raw, off = K.spans(pa.array([t for _, t in items], pa.string()))
        h, first, _, _ = K.words(raw, off, K.ALNUM)
        self.ids, self.sets, self.k = [], [], []
        for r, (item, _) in enumerate(items):
            n = int(first[r + 1] - first[r])
            if n:
                own = h[first[r] : first[r + 1]]
                self.ids.append(item)
                self.k.append(min(n, WORDS))
                self.sets.append(np.unique(K.shingles(own, np.array([0, n]), min(n, WORDS))[0]))
        m = _hash_count()
        s = K.seeds64(m, 41)
        self.a, self.c = ((s & _U(0xFFFFFFFF)).astype(_W) | _W(1)), ((s >> _U(32)).astype(_W) | _W(1))
        self.parts: dict[int, dict[int, list]] = {}
        few: dict[int, list] = {}
        for i, x in enumerate(self.sets):
            part = self.parts.setdefault(self.k[i], {})
            if len(x) < FEW:
                few.setdefault(self.k[i], []).append(i)
            else:
                part.setdefault(1 << (len(x) - 1).bit_length(), []).append(i)
        self.few = {}
        for k, of in few.items():
            of.sort(key=lambda i: int(self.sets[i][0]))
            keys = np.array([self.sets[i][0] for i in of], _U)
            seen = np.zeros(1 << 16, bool)
            seen[keys >> _U(48)] = True
            self.few[k] = keys, seen, of
        self.tables = {}
        for k, by_width in self.parts.items():
            for w, of in by_width.items():
                least = np.array([[self._values(self.sets[i], f).min() for i in of] for f in range(m)], _W)
                seen = np.zeros((m, 1 << 16), bool)
                for f in range(m):
                    seen[f, least[f] >> _W(16)] = True
                self.tables[k, w] = least, seen, np.array(of)

    def _values(self, x: np.ndarray, f: int) -> np.ndarray:
        return (x & _U(0xFFFFFFFF)).astype(_W) * self.a[f] + (x >> _U(32)).astype(_W) * self.c[f]

    def candidates(self, x: np.ndarray, first: np.ndarray, k: int) -> set[tuple[int, int]]:
        """(row, item) whose windows and sets share a least value of any function; items of FEW shingles by one of them."""
        found: set[tuple[int, int]] = set()
        if not len(x):
            return found
        if k in self.few:
            keys, some, of = self.few[k]
            maybe = np.flatnonzero(some[x >> _U(48)])
            left = np.searchsorted(keys, x[maybe])
            hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == x[maybe])
            rows = np.searchsorted(first, maybe[hit], "right") - 1
            for row, at in {*zip(rows.tolist(), left[hit].tolist(), strict=True)}:
                found.update((row, of[j]) for j in range(at, int(np.searchsorted(keys, keys[at], "right"))))
        if not self.parts[k]:
            return found
        lo, hi = (x & _U(0xFFFFFFFF)).astype(_W), (x >> _U(32)).astype(_W)
        layout = {}
        for w in self.parts[k]:
            n = -(-np.diff(first) // w)
            total = np.cumsum(n)
            starts = np.repeat(first[:-1], n) + (np.arange(total[-1]) - np.repeat(total - n, n)) * w
            row = np.repeat(np.arange(len(n)), n)
            layout[w] = starts, row, np.flatnonzero(row[1:] == row[:-1])
        for f in range(len(self.a)):
            v = lo * self.a[f]
            v += hi * self.c[f]
            for w, (starts, row, pair) in layout.items():
                least, seen, of = self.tables[k, w]
                block = np.minimum.reduceat(v, starts)
                both = block.copy()
                both[pair] = np.minimum(block[pair], block[pair + 1])
                maybe = np.flatnonzero(seen[f][both >> _W(16)])
                for b in maybe[np.isin(both[maybe], least[f])] if len(maybe) else ():
                    found.update((int(row[b]), int(i)) for i in of[least[f] == both[b]])
        return found

    def matches(self, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item_id, item's shingles, shared shingles) of the rows that hold an item."""
        for i, j in K.slices(off):
            h, first, _, _ = K.words(raw, off[i : j + 1], K.ALNUM)
            for k in self.parts:
                n = np.diff(first)
                x, at = K.shingles(h, first, k)
                for row, items in groupby(sorted(self.candidates(x, at, k)), lambda g: g[0]):
                    if n[row] < k:
                        continue
                    own = np.unique(x[at[row] : at[row + 1]])
                    for _, item in items:
                        q = self.sets[item]
                        near = np.searchsorted(own, q)
                        near[near == len(own)] = 0
                        shared = int(np.count_nonzero(own[near] == q))
                        if shared >= SHARE * len(q) - 1e-9:
                            yield i + row, self.ids[item], len(q), shared


def item_blocks(items: DataFrame) -> Iterator[Index]:
    """Indexes of the items, in blocks of bounded size; null texts have no shingles."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // ITEM_BYTES))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        got = Index([(r.item_id, r.text) for r in part.distinct().collect()])
        if got.ids:
            yield got


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of documents that hold a test item.

    Words are runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased; an
    item's set holds its distinct shingles of five words (fewer words: the whole item). A document
    holds an item if at least 0.8 of the item's set is in the document's, which an exact count
    over the whole document decides. Items are partitioned by size into powers of two; each
    partition is searched in windows of twice that size, so that a short item stands out in a document of any length.
    Items of fewer than FEW shingles are looked up exactly.

    Items without words match nothing, nor do null or empty texts. Rows that repeat are searched
    each; items that repeat count once. Empty tables give an empty result; only doc_id, text and
    item_id, text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sc = docs.sparkSession.sparkContext
    found = [rows.mapInArrow(_finder(sc.broadcast(index)), SCHEMA) for index in item_blocks(items)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def _finder(shared):
    def run(batches):
        for batch in batches:
            raw, off = K.spans(batch.column("text"))
            got = list(shared.value.matches(raw, off))
            row, item, n, both = (list(c) for c in zip(*got, strict=True)) if got else ([], [], [], [])
            share = [b / a for a, b in zip(n, both, strict=True)]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(both, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return run


def _sieve(shared):
    def run(batches):
        for batch in batches:
            raw, off = K.spans(batch.column("text"))
            keep = np.ones(len(batch), bool)
            keep[[r for r, *_ in shared.value.matches(raw, off)]] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a test item, as ``contaminated`` finds them."""
    for index in item_blocks(items):
        docs = docs.mapInArrow(_sieve(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs


#: DuckDB: the exact containment of every item in every document.
ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
i AS (
  SELECT DISTINCT id AS item_id, least(len(ws), 5) AS k, array_to_string(ws[p : p + least(len(ws), 5) - 1], ' ') AS s
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE kind = 'i' AND len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d AS (
  SELECT DISTINCT id AS doc_id, k, array_to_string(ws[p : p + k - 1], ' ') AS s
  FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, (SELECT DISTINCT k FROM i) WHERE kind = 'd' AND len(ws) >= k))
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN i USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
"""
