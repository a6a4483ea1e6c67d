"""Quality by compression: how much better a dictionary of good text compresses a document than one of bad text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagemill.llm import kernels as K
from pagemill.llm.labelled import one_each, sample
from pagemill.llm.storage import Stash

#: Learning takes at most so many documents of each label, and a dictionary so many bytes of them.
PER_CLASS, CLASS_BYTES = 2000, 6 << 20
DICTIONARY = 112 << 10
#: Texts are compressed in blocks, as a dictionary helps only near the start of what it begins.
BLOCK, LEVEL = 4096, 3


@dataclass
class Model:
    """Two dictionaries, and the logistic curve that turns measures into a score."""

    good: bytes
    bad: bytes
    curve: np.ndarray

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "curve": self.curve}

    def _compressors(self):
        if not hasattr(self, "_made"):
            import zstandard as z

            def made(data: bytes):
                d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_AUTO if data else z.DICT_TYPE_RAWCONTENT)
                if data:
                    d.precompute_compress(level=LEVEL)
                p = z.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, write_checksum=False, write_content_size=False, write_dict_id=False)
                return z.ZstdCompressor(compression_params=p, **({"dict_data": d} if data else {}))

            self._made = made(self.good), made(self.bad)
        return self._made

    def measures(self, text: bytes) -> tuple[float, float, float]:
        """The normalised difference of the compressed sizes, the smaller size's share of the text, and 1."""
        if not text:
            return 0.0, 1.0, 1.0
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self._compressors())
        return (bad - good) / (bad + good), min(good, bad) / len(text), 1.0

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measures @ self.curve, -35, 35)))


def _even_share(sizes: list[int], total: int) -> int:
    """The bytes that each text may give: as many as the others, so that a long one can't outweigh them."""
    return max(1, total // max(1, len(sizes)))


def _drawn(text: bytes, most: int) -> list[bytes]:
    """A text's blocks, or if it has more than ``most`` bytes, so many bytes in blocks from all over it."""
    count = -(-len(text) // BLOCK)
    if len(text) <= most:
        return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    n = max(1, most // BLOCK)
    return [text[i : i + min(BLOCK, most)] for i in (count * (2 * j + 1) // (2 * n) * BLOCK for j in range(n))]


def _dictionary(blocks: list[bytes]) -> bytes:
    """A zstandard dictionary trained on the blocks; where they are too few, the blocks themselves."""
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY, blocks, k=256, d=8).as_bytes()
    except z.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    scale = np.array([*np.maximum(x[:, :-1].std(0), 1e-6), 1.0])
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (weight * (p - y)) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", train=None, per_class: int = PER_CLASS) -> Model:
    """Dictionaries from half of the sampled documents of each label, and the curve from the whole texts of the other half.

    Every sampled document is used, so that the sample's weights hold. A dictionary's bytes are
    shared evenly: long texts give blocks from all over them, and shorter ones all they have. Whole texts stay with the tasks.
    """
    texts, weight = sample(docs, labels, label, F.lit(True) if train is None else train, per_class)
    stash = Stash(docs.sparkSession, "quality")
    texts = one_each(stash.put("sample", texts.where("text <> ''")))
    rows = texts.select("y", "doc_id", "told", F.octet_length("text").alias("size")).collect()
    # within a label, documents are taken in turn in the order of a hash
    got = sorted((r.y, int(K.mix64(np.array([r.doc_id], np.int64).view(np.uint64))[0]), r.doc_id, r.told, r.size) for r in rows)
    parts = {y: [g[2:] for g in got if g[0] == y] for y in (0, 1)}
    if not parts[0] or not parts[1]:
        stash.drop("sample")
        return Model(b"", b"", np.array([0.0, 0.0, 0.0 if not (parts[0] or parts[1]) else (4.0 if parts[1] else -4.0)]))
    sc = docs.sparkSession.sparkContext
    of = {y: parts[y][::2] for y in (0, 1)}
    most = {(d, t): share for y in (0, 1) for share in [_even_share([n for *_, n in of[y]], CLASS_BYTES)] for d, t, _ in of[y]}
    drawn = {(r.doc_id, r.told): r.blocks for r in texts.mapInArrow(_drawer(sc.broadcast(most)), "doc_id long, told long, blocks array<binary>").toLocalIterator()}
    good, bad = ([bytes(b) for d, t, _ in of[y] for b in drawn[d, t]] for y in (1, 0))
    model = Model(_dictionary(good), _dictionary(bad), np.zeros(3))
    held = {y: parts[y][1::2] or parts[y] for y in (0, 1)}
    keys = [(d, t) for y in (0, 1) for d, t, _ in held[y]]
    measured = {(r.doc_id, r.told): r.x for r in texts.mapInArrow(_measurer(sc.broadcast((model, set(keys)))), "doc_id long, told long, x array<double>").collect()}
    stash.drop("sample")
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    # what a held document stands for, also where a label's documents are odd in number
    each = np.repeat([weight[v] * len(parts[v]) / 2 / len(held[v]) for v in (0, 1)], [len(held[0]), len(held[1])])
    model.curve = _curve(np.array([measured[k] for k in keys]), y, each)
    return model


def _drawer(shared):
    def run(batches):
        for batch in batches:
            got = [(d, t, _drawn(text.as_buffer().to_pybytes(), shared.value[d, t])) for d, t, text in _keyed(batch) if (d, t) in shared.value]
            yield _table(got, ["doc_id", "told", "blocks"], pa.list_(pa.binary()))

    return run


def _measurer(shared):
    def run(batches):
        model, keys = shared.value
        for batch in batches:
            got = [(d, t, list(model.measures(text.as_buffer().to_pybytes()))) for d, t, text in _keyed(batch) if (d, t) in keys]
            yield _table(got, ["doc_id", "told", "x"], pa.list_(pa.float64()))

    return run


def _keyed(batch: pa.RecordBatch):
    return zip(batch.column("doc_id").to_pylist(), batch.column("told").to_pylist(), batch.column("text"), strict=True)


def _table(rows: list[tuple], names: list[str], last: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), last), strict=True)], names)


def _scorer(shared, name: str):
    def run(batches):
        model = shared.value
        for batch in batches:
            raw, off = K.spans(batch.column("text"))
            data = raw.data
            x = np.array([model.measures(bytes(data[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]).reshape(-1, 3)
            yield pa.record_batch([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, name])

    return run


def with_quality(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, which no other may have: the chance, from its whole text, that a document is good.

    Null and empty texts get the curve's score of no difference; rows that repeat are scored each; an empty table gives an empty one.
    """
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame, train=None, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score): the chance, from its whole text, that a document is good.

    Learned from ``labels`` (doc_id, quality) whose doc_id meets the condition ``train`` (all by
    default), from at most ``per_class`` documents of each label, of which a dictionary takes at most CLASS_BYTES bytes. Every whole
    text is compressed in blocks with both dictionaries, and the normalised difference of the
    sizes, with the share that compression leaves, goes through a calibrated logistic curve.

    Null and empty texts get the curve's score of no difference; with one label, or none, the score is a constant.
    Rows that repeat are scored each; an empty table gives an empty one; only doc_id and text are read.
    """
    model = learn(docs, labels, "quality", train, per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_quality(rows, model).select("doc_id", "score")
