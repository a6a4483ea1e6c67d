"""Token ids of whole documents in Arrow files of equal-length sequences and masks.

Layout of a folder. Shard i holds consecutive documents in ascending doc_id order:

``tokens-i.arrow``  Arrow IPC file; record batches of BATCH sequences (the last one may be shorter);
                    ``ids`` fixed-size list of uint16 (uint32 for vocabularies beyond 65,536 ids) and
                    ``mask`` fixed-size list of bool, which is false on the padding of the last sequence.
``docs-i.arrow``    Arrow IPC file: doc_id, start (ids of the shard's documents before it), n_tokens.

As every batch but the last has BATCH rows of one length, sequence r is row ``r % BATCH`` of batch
``r // BATCH``: a reader that maps the file finds it without reading anything before it.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.kernels import mix64, powers, seeds64, slices, spans
from pagemill.llm.storage import new_path

#: Ids of a sequence; sequences of a record batch.
LENGTH, BATCH = 2048, 64
_U = np.uint64

_TOP = 0x250
_OTHER, _LETTER, _NUMBER, _SPACE, _HARD = range(5)


def _classes() -> np.ndarray:
    """Character classes of the byte-level pre-tokenizer below U+0250; _HARD is left to the library."""
    out = np.full(_TOP + 1, _OTHER, np.uint8)
    for c in range(_TOP):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, ord("'"), _TOP]] = _HARD
    return out


_CLASS = _classes()
_CODE = seeds64(_TOP + 1, 31)


class Encoder:
    """A tokenizer that encodes each distinct pre-token once.

    Byte-level BPE merges never cross pre-tokens. Where the file's pre-tokenizer is the byte-level
    one and a text has only characters below U+0250 without apostrophes, its pre-tokens are found
    with numpy and their ids looked up in a bounded table that the library fills; any other text,
    and any other kind of tokenizer, goes through the library as a whole. Pre-tokens are looked up
    PORTION at a time, so that however many distinct ones a text has, the table has free places.
    """

    BITS, FULL, STORE, PORTION = 20, 600_000, 8_000_000, 200_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        said = json.loads(self.lib.to_str())
        pre = said.get("pre_tokenizer") or {}
        self.quick = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True), said.get("normalizer"), said["model"]["type"], said.get("truncation"), said.get("padding")) == ("ByteLevel", False, True, None, "BPE", None, None)
        self.marks = [x["content"] for x in said.get("added_tokens", [])]
        self.dtype = np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.BITS, _U)
        self.at = np.zeros(1 << self.BITS, np.int32)
        self.n = np.zeros(1 << self.BITS, np.int32)
        self.store = np.zeros(1 << 16, self.dtype)
        self.used = self.count = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        mask = _U((1 << self.BITS) - 1)
        slot = (h & mask).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, slot, -1)
        rest = np.flatnonzero((got != h) & (got != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & int(mask)
            got = self.keys[slot[rest]]
            hit = got == h[rest]
            out[rest[hit]] = slot[rest[hit]]
            rest = rest[~hit & (got != 0)]
        return out

    def _insert(self, h: np.ndarray, ids: list[list[int]]) -> None:
        n = np.array([len(x) for x in ids], np.int32)
        flat = np.array([i for x in ids for i in x], self.dtype)
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(flat)] = flat
        at = (self.used + np.cumsum(n) - n).astype(np.int32)
        self.used += len(flat)
        self.count += len(h)
        mask, rest = (1 << self.BITS) - 1, np.arange(len(h))
        slot = (h & _U(mask)).astype(np.int64)
        while len(rest):
            free = rest[self.keys[slot[rest]] == 0]
            self.keys[slot[free]] = h[free]  # of several that want a slot, the last has it
            won = free[self.keys[slot[free]] == h[free]]
            self.at[slot[won]], self.n[slot[won]] = at[won], n[won]
            rest = rest[self.keys[slot[rest]] != h[rest]]
            slot[rest] = (slot[rest] + 1) & mask

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        if not self.quick:
            each = self._library(texts)
            return np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(x) for x in each], np.int64)
        joined = "".join(texts)
        code = np.minimum(np.frombuffer(joined.encode("utf-32-le"), np.uint32), _TOP)
        kind = _CLASS[code]
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        hard = set((np.searchsorted(off, np.flatnonzero(kind == _HARD), "right") - 1).tolist())
        for mark in self.marks:
            if mark in joined:
                hard |= {i for i, t in enumerate(texts) if mark in t}
        if hard:
            whole = dict(zip(sorted(hard), self._library([texts[i] for i in sorted(hard)]), strict=True))
            ids, n = self.encode([t for i, t in enumerate(texts) if i not in hard])
            easy = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
            each = [whole[i] if i in hard else next(easy) for i in range(len(texts))]
            return np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(x) for x in each], np.int64)
        if not len(code):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        return self._pieces(joined, code, kind, off)

    def _pieces(self, joined: str, code: np.ndarray, kind: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(code)
        opens = np.zeros(n, bool)
        opens[off[:-1][np.diff(off) > 0]] = True
        turn = opens.copy()
        turn[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        # a run of white space gives up its last character before other text; a blank then joins that text
        start = turn.copy()
        gives = np.zeros(n, bool)
        gives[:-1] = space[:-1] & ~space[1:] & ~opens[1:]
        start |= gives
        joins = np.zeros(n, bool)
        joins[1:] = gives[:-1] & (code[:-1] == 32)
        start &= ~joins
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            acc = np.zeros(n + 1, _U)
            np.cumsum(_CODE[code] * up[:n], out=acc[1:])
            h = mix64((acc[e] - acc[s]) * down[s] + (e - s).astype(_U))
        h[h == 0] = 1
        parts = [self._looked_up(joined, h[i : i + self.PORTION], s[i : i + self.PORTION], e[i : i + self.PORTION]) for i in range(0, len(s), self.PORTION)]
        total = np.zeros(len(s) + 1, np.int64)
        np.cumsum(np.concatenate([n for _, n in parts]), out=total[1:])
        return np.concatenate([ids for ids, _ in parts]), np.diff(total[np.searchsorted(s, off)])

    def _looked_up(self, joined: str, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens joined[s:e], whose hashes are h, and how many each has."""
        slot = self._find(h)
        if (slot < 0).any():
            if self.count > self.FULL or self.used > self.STORE:
                self._clear()
                slot[:] = -1
            new, at = np.unique(h[slot < 0], return_index=True)
            at = np.flatnonzero(slot < 0)[at]
            pieces = [joined[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]
            self._insert(new, [x.ids for x in self.lib.encode_batch_fast(pieces, add_special_tokens=False)])
            slot = self._find(h)
        each, at = self.n[slot].astype(np.int64), self.at[slot].astype(np.int64)
        total = np.cumsum(each) - each
        return self.store[np.repeat(at - total, each) + np.arange(int(each.sum()))], each


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, made once."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _fixed(values: np.ndarray, length: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values), length)


class _Shard:
    """Writes one shard under another name, and moves it to its own when it is whole."""

    def __init__(self, folder: str, number: int, dtype, length: int, schema: pa.Schema):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.dtype, self.length, self.tag = dtype, length, f"{number:06d}"
        self.paths = [f"{root}/{kind}-{self.tag}.arrow" for kind in ("tokens", "docs")]
        self.tmp = [f"{p}.{uuid.uuid4().hex}" for p in self.paths]
        item = pa.from_numpy_dtype(dtype)
        schemas = [pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))]), schema]
        self.sinks = [self.fs.open_output_stream(t) for t in self.tmp]
        self.out = [pa.ipc.new_file(sink, x) for sink, x in zip(self.sinks, schemas, strict=True)]
        self.rest, self.tokens, self.docs = np.zeros(0, dtype), 0, 0

    def _rows(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out[0].write_batch(pa.record_batch([_fixed(ids, self.length), _fixed(mask, self.length)], schema=self.out_schema()))

    def out_schema(self) -> pa.Schema:
        return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), self.length)), ("mask", pa.list_(pa.bool_(), self.length))])

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        start = self.tokens + np.cumsum(counts) - counts
        self.out[1].write_batch(pa.record_batch([doc_ids, pa.array(start), pa.array(counts)], ["doc_id", "start", "n_tokens"]))
        self.tokens += int(counts.sum())
        self.docs += len(counts)
        ids, step = np.concatenate([self.rest, ids]), BATCH * self.length
        whole = len(ids) // step * step
        for i in range(0, whole, step):
            self._rows(ids[i : i + step], step)
        self.rest = ids[whole:]

    def close(self) -> None:
        if real := len(self.rest):
            self._rows(np.concatenate([self.rest, np.zeros(-real % self.length, self.dtype)]), real)
        for out, sink in zip(self.out, self.sinks, strict=True):
            out.close()
            sink.close()
        for tmp, path in zip(self.tmp, self.paths, strict=True):
            if self.fs.type_name != "local" and self.fs.get_file_info(path).type != pafs.FileType.NotFound:
                self.fs.delete_file(tmp)  # another attempt has written the same bytes
            else:
                self.fs.move(tmp, path)


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "shard int, docs long, tokens long, sequences long"
_COUNTED = pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("sequences", pa.int64()), ("start", pa.int64())])


def _writer(folder: str, tokenizer: str, end_id: int, length: int):
    def run(batches):
        from pyspark import TaskContext

        shard, enc = None, encoder(tokenizer)
        number = TaskContext.get().partitionId()
        for batch in batches:
            raw, off = spans(batch.column("text"))
            for i, j in slices(off):
                texts = [raw[a:b].tobytes().decode(errors="replace") for a, b in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True)]
                ids, n = enc.encode(texts)
                ids = np.insert(ids, np.cumsum(n), end_id).astype(enc.dtype, copy=False)
                shard = shard or _Shard(folder, number, enc.dtype, length, _DOCS)
                shard.add(batch.column("doc_id").slice(i, j - i), ids, n + 1)
        if shard:
            shard.close()
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([shard.docs]), pa.array([shard.tokens]), pa.array([-(-shard.tokens // length)])], ["shard", "docs", "tokens", "sequences"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, length: int = LENGTH) -> tuple[str, DataFrame]:
    """Encode whole texts, append ``end_id`` to each, and write the ids in ascending doc_id order.

    Returns the folder (a new one in the cluster's shared folder unless given) and the manifest
    (shard, docs, tokens, sequences, start): start is the ids of all shards before it. A null text
    is empty, null doc_ids come first, and rows that share a doc_id are ordered by their texts'
    hash and text. Bytes that are not UTF-8 are read as U+FFFD. Other columns are not read; an
    empty table writes no shard. A task that runs again writes the same files again.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    by = [F.col("doc_id"), F.xxhash64("text")]
    done = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text").mapInArrow(_writer(folder, tokenizer, end_id, length), _MANIFEST)
    # a row a task comes to the driver: files that Spark writes would make each task start processes (chmod), in which the executor's memory counts twice
    shards = sorted(done.collect())
    starts = list(accumulate((s["tokens"] for s in shards), initial=0))[:-1]
    columns = [[s[c] for s in shards] for c in ("shard", "docs", "tokens", "sequences")]
    return folder, spark.createDataFrame(pa.table([*map(pa.array, columns, _COUNTED.types[:-1]), pa.array(starts, pa.int64())], schema=_COUNTED))


class TokenFile:
    """Random access to the sequences and documents of one shard."""

    def __init__(self, folder: str, shard: int):
        fs, root = pafs.FileSystem.from_uri(folder)

        def opened(kind: str):
            path = f"{root}/{kind}-{shard:06d}.arrow"
            return pa.ipc.open_file(pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path))

        self.tokens, self.index = opened("tokens"), opened("docs")
        self.length = self.tokens.schema.field("ids").type.list_size
        self._at, self._ids = -1, None

    def sequence(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the mapped file) and mask of sequence r."""
        batch, i = self.tokens.get_batch(r // BATCH), r % BATCH
        return batch.column(0)[i].values.to_numpy(), batch.column(1)[i].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int):
        """The pieces, as views, of n ids from one on."""
        step = BATCH * self.length
        while n > 0:
            if self._at != start // step:
                self._at = start // step
                self._ids = self.tokens.get_batch(self._at).column(0).flatten().to_numpy()
            piece = self._ids[start % step : start % step + n]
            yield piece
            start, n = start + len(piece), n - len(piece)

    def documents(self):
        for b in range(self.index.num_record_batches):
            yield self.index.get_batch(b)


def _reader(folder: str):
    def run(batches):
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = TokenFile(folder, shard)
                for rows in file.documents():
                    start, n = (rows.column(c).to_numpy() for c in ("start", "n_tokens"))
                    sums = []
                    for a, m in zip(start.tolist(), n.tolist(), strict=True):
                        crc = 0
                        for piece in file.ids(a, m):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        sums.append(crc)
                    yield pa.record_batch([rows.column("doc_id"), pa.array(start + base), rows.column("n_tokens"), pa.array(sums, pa.int64()), pa.array([shard] * len(sums), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return run


def read_documents(folder: str, manifest: DataFrame) -> DataFrame:
    """One row for each document in the files: (doc_id, start, n_tokens, ids_crc32, shard)."""
    n = max(1, manifest.count())
    return manifest.select("shard", "start").repartitionByRange(n, "shard").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
