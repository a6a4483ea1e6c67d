"""Toxicity by logistic regression, learned with FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import kernels as K
from pagemill.llm.labelled import one_each, sample
from pagemill.llm.storage import Stash

#: Weights are hashed into so many places.
SIZE = 1 << 20
#: Bytes that a word's stem keeps.
STEM = 4
#: Learning takes at most so many documents of each label, and so many bytes of their features.
PER_CLASS, CLASS_BYTES = 4096, 64 << 20
_U = np.uint64
_SALT = K.seeds64(8, 51)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of the rows, four of each word, and the row of each: words, stems, word pairs, and pairs that skip a word."""
    low = K.ALNUM[raw[int(off[0]) : int(off[-1])]]
    first, s, e = K.word_spans(low, np.asarray(off, np.int64) - int(off[0]))
    n = len(s)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = K.hashes(low, s, e)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    out, rows = [h + _SALT[0], K.hashes(low, s, np.minimum(e, s + STEM)) + _SALT[1]], [row, row]
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            if n > gap:
                same = row[gap:] == row[:-gap]
                out.append((K.mix64(h[:-gap] + _SALT[2 * gap]) + h[gap:] * _SALT[7])[same])
                rows.append(row[gap:][same])
    return (K.mix64(np.concatenate(out)) & _U(SIZE - 1)).astype(np.int64), np.concatenate(rows)


@dataclass
class Ftrl:
    """FTRL-proximal over presence features: each coordinate has its own rate, and L1 keeps most weights at 0."""

    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == SIZE, 0.0, self.l1)  # the last place is the bias
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int, weight: float) -> None:
        """One document: its distinct feature places (with the bias), its label, and how many documents it stands for."""
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _featured(batches):
    """(doc_id, y, told, at): a document's distinct feature places, with the bias."""
    for batch in batches:
        raw, off = K.spans(batch.column("text"))
        at = [np.append(np.unique(features(raw, off[r : r + 2])[0]), SIZE).astype(np.int32).tobytes() for r in range(len(batch))]
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "y", "told")), pa.array(at, pa.binary())], ["doc_id", "y", "told", "at"])


def _order(doc_id: int) -> tuple[int, int]:
    return int(K.mix64(np.array([doc_id], np.int64).view(_U))[0]), doc_id


def _learner(weight: dict[int, float], rounds: int):
    def run(batches):
        rows = []
        for batch in batches:
            for doc_id, y, at in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), batch.column("at"), strict=True):
                rows.append((doc_id, y, np.frombuffer(at.as_py(), np.int32)))
        rows.sort(key=lambda x: _order(x[0]))
        model = Ftrl()
        for _ in range(rounds):
            for _, y, at in rows:
                model.learn(at, y, weight[y])
        w = model.weights(np.arange(SIZE + 1))
        at = np.append(np.flatnonzero(w[:-1]), SIZE)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(w[at])], ["place", "weight"])

    return run


def _within(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """Of documents (doc_id, bytes), in the order of learning, those that fit into ``most`` bytes."""
    out, used = [], 0
    for doc_id, n in sorted(sizes, key=lambda x: _order(x[0])):
        if used + n <= most:
            out.append(doc_id)
            used += n
    return out


def learn(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int = PER_CLASS, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) other than 0, the bias last; from at most ``per_class`` documents and CLASS_BYTES of each label that meet ``train``.

    Features are made where the texts are; only the places of a bounded sample's features go to the task that learns.
    """
    texts, weight = sample(docs, labels, label, train, per_class)
    spark, stash = docs.sparkSession, Stash(docs.sparkSession, "toxicity")
    made = one_each(stash.put("features", texts.mapInArrow(_featured, "doc_id long, y int, told long, at binary"))).select("doc_id", "y", "at")
    sizes = {y: [(r.doc_id, r.n) for r in made.where(F.col("y") == y).select("doc_id", F.octet_length("at").alias("n")).collect()] for y in (0, 1)}
    taken = {y: _within(sizes[y], CLASS_BYTES) for y in (0, 1)}
    weight = {y: weight[y] * len(sizes[y]) / max(1, len(taken[y])) for y in (0, 1)}
    if sum(map(len, taken.values())) < len(sizes[0]) + len(sizes[1]):
        made = made.join(F.broadcast(spark.createDataFrame([(d,) for y in (0, 1) for d in taken[y]], "doc_id long")), "doc_id", "left_semi").select("doc_id", "y", "at")
    got = made.repartition(1).mapInArrow(_learner(weight, rounds), "place int, weight double").toPandas()
    stash.drop("features")
    if not len(got):
        return np.array([SIZE], np.int32), np.zeros(1)
    return got["place"].to_numpy(), got["weight"].to_numpy()


def _scorer(shared):
    def run(batches):
        at, w = shared.value
        table = np.zeros(SIZE + 1)
        table[at] = w
        for batch in batches:
            raw, off = K.spans(batch.column("text"))
            score = np.zeros(len(batch))
            for i, j in K.slices(off):
                place, row = features(raw, off[i : j + 1])
                hit = np.flatnonzero(table[place])
                one = np.unique(row[hit] * SIZE + place[hit])
                score[i:j] = table[SIZE] + np.bincount(one // SIZE, table[one % SIZE], j - i)
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(score, -35, 35))))], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, train=None, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score): the chance, from its whole text, that a document is toxic.

    Learned from ``labels`` (doc_id, toxic) whose doc_id meets the condition ``train`` (all by
    default), from at most ``per_class`` documents of each label in the order of their ids' MD5, as far as
    their features fit into CLASS_BYTES; each stands for as many as its label has. A feature counts once a document. Only non-zero
    weights go to the tasks, SIZE + 1 of them at most.

    Null and empty texts get the score of a text without features. Without labelled rows every score
    is 0.5. Rows that repeat are scored each; an empty table gives an empty one; only doc_id and text are read.
    """
    model = learn(docs, labels, "toxic", F.lit(True) if train is None else train, per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
