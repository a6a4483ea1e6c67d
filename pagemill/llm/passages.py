"""Passages that repeat across documents, by content-defined chunks and their digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import kernels as K
from pagemill.llm.skew import join_counted
from pagemill.llm.storage import Stash

#: A boundary is where bits LOW to LOW + BITS - 1 of the 16-bit gear hash are 0: the last LOW + BITS bytes set them.
BITS, LOW, GEAR = 4, 4, 16
#: No boundary follows another candidate within LEAST bytes. In chunks longer than LONG, where few contexts repeat again
#: and again, least values of the hash within REACH bytes on both sides are boundaries too; chunks longer than MOST are cut.
LEAST, LONG, REACH, MOST = 8, 96, 12, 1024
#: Words that consecutive repeated chunks must begin to count as a repeated passage. Chunks, of 25 bytes
#: on average, at the two ends of a passage also hold other text, and the hash needs 8 bytes to forget what precedes
#: it: of a passage of 50 words about 43 lie in whole repeated chunks.
WORDS = 36

_TABLE = (K.seeds64(256, 61) >> np.uint64(48)).astype(np.uint16)


def _extra(h: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Starts of further chunks in long ones: behind each place whose hash is the least of all within REACH."""
    long = np.flatnonzero(size > LONG)
    n = size[long]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(starts[long], n) + within
    pad = np.full(REACH, 0xFFFF, np.uint16)
    near = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, h[at], pad]), 2 * REACH + 1).min(axis=1)
    inner = (within >= REACH) & (np.repeat(n, n) - within > REACH)
    return at[inner & (h[at] == near)] + 1


def boundaries(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of all chunks in raw[off[0]:off[-1]]; every row starts one.

    The rolling recurrence ``h = (h << 1) + gear[byte]`` in 16 bits is the sum of the last 16
    shifted table values, which four doubling steps give for all places at once. Each row begins
    with an empty hash.
    """
    lo, n = int(off[0]), int(off[-1] - off[0])
    at = np.asarray(off, np.int64) - lo
    # 16 zeros before every row keep the hash from reaching into the row before
    place = np.arange(n) + GEAR * np.repeat(np.arange(1, len(at)), np.diff(at))
    h = np.zeros(n + GEAR * (len(at) - 1), np.uint16)
    h[place] = _TABLE[raw[lo : lo + n]]
    for step in (1, 2, 4, 8):
        prev = np.zeros_like(h)
        prev[step:] = h[:-step] << np.uint16(step)
        h = h + prev
    h = h[place]
    cand = np.flatnonzero((h >> np.uint16(LOW)) & np.uint16((1 << BITS) - 1) == 0) + 1
    gap = np.diff(cand, prepend=-LEAST)
    row = np.searchsorted(at, cand, "right") - 1
    room = np.minimum(gap, cand - at[np.minimum(row, len(at) - 1)])
    cand = cand[(room >= LEAST) & (cand < n)]
    starts = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], cand]))
    size = np.diff(np.append(starts, n))
    if len(size) and size.max() > LONG:
        starts = np.unique(np.concatenate([starts, _extra(h, starts, size)]))
        size = np.diff(np.append(starts, n))
    if len(size) and size.max() > MOST:
        pieces = -(-size // MOST)
        starts = np.repeat(starts, pieces) + MOST * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return starts


def _digests(batches):
    for batch in batches:
        raw, off = K.spans(batch.column("text"))
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for i, j in K.slices(off):
            at = off[i : j + 1] - off[i]
            s = boundaries(raw, off[i : j + 1])
            if len(s):
                digest = K.hashes(raw[off[i] : off[j]], s, np.append(s[1:], at[-1]))
                row = np.searchsorted(at, s, "right") - 1
                yield pa.record_batch([pa.array(digest.view(np.int64)), pa.array(doc[i + row])], ["digest", "doc_id"])


def _chunks(batches):
    for batch in batches:
        raw, off = K.spans(batch.column("text"))
        doc, told = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "told"))
        for i, j in K.slices(off):
            at = off[i : j + 1] - off[i]
            s = boundaries(raw, off[i : j + 1])
            if not len(s):
                continue
            e = np.append(s[1:], at[-1])
            low = raw[off[i] : off[j]]
            _, begin, _ = K.word_spans(K.SPACED[low], at)
            words = np.searchsorted(begin, e) - np.searchsorted(begin, s)
            row = np.searchsorted(at, s, "right") - 1
            # documents of one id are told apart in the upper half of a chunk's place
            where = ((told[i + row] & 0x7FFFFFFF) << 32) | (s - at[row])
            yield pa.record_batch([pa.array(K.hashes(low, s, e).view(np.int64)), pa.array(doc[i + row]), pa.array(where), pa.array(((e - s) << 11 | words).astype(np.int32))], ["digest", "doc_id", "at", "extent"])


def repeated_passages(docs: DataFrame, least_words: int = WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, n_chunks, first_doc_id, original, copied, told): passages that stand in several documents.

    Whole texts are cut where a gear hash of the last bytes says so, so that an insertion changes
    only the chunks around it. A chunk repeats if its digest occurs under several doc_ids; a
    passage is a run of repeated chunks, as long as can be, that begins ``least_words`` words at least. start
    and end are byte offsets; first_doc_id is the least doc_id that holds one of its chunks, and a passage is the
    original where no smaller doc_id holds any chunk of it. ``copied`` lists the spans of the passage whose chunks
    smaller doc_ids hold, as only these stand elsewhere when all of them are cut; ``told`` tells texts of one doc_id apart.

    Null and empty texts have no chunk; rows without doc_id take no part; rows that repeat a doc_id
    are one document in counting, but their passages are reported apart unless their texts are equal. An empty
    table gives an empty result; only doc_id and text are read. Digests have 64 bits; a passage
    needs several equal ones in a row.
    """
    rows = docs.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("told"), "text")
    # cutting twice costs less than keeping or shuffling whole chunk rows for both sides
    again = rows.mapInArrow(_digests, "digest long, doc_id long").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("digest", "first", "n")
    again = Stash(docs.sparkSession, "passages").put("again", again)
    chunks = rows.mapInArrow(_chunks, "digest long, doc_id long, at long, extent int")
    held = join_counted(chunks, again, "digest", ["doc_id", "at"]).select("doc_id", F.shiftright("at", 32).alias("told"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"), "extent", "first")
    # dealt by document once, for the grouping and for the windows
    held = held.repartition("doc_id", "told").groupBy("doc_id", "told", "at").agg(F.max("extent").alias("extent"), F.min("first").alias("first"))
    held = held.select("doc_id", "told", "at", "first", (F.col("first") < F.col("doc_id")).alias("copy"), F.shiftright("extent", 11).alias("size"), F.col("extent").bitwiseAND(F.lit(2047)).alias("words"))
    by = Window.partitionBy("doc_id", "told").orderBy("at")
    apart = F.coalesce(F.col("at") != F.lag(F.col("at") + F.col("size")).over(by), F.lit(True))
    turns = F.coalesce(F.col("copy") != F.lag("copy").over(by), F.lit(True))
    runs = held.withColumns({"fresh": apart.cast("int"), "turn": (apart | turns).cast("int")})
    runs = runs.withColumns({"run": F.sum("fresh").over(by), "part": F.sum("turn").over(by)})
    of = [F.min("at").alias("at"), F.max(F.col("at") + F.col("size")).alias("to"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"), F.min("first").alias("first_doc_id")]
    parts = runs.groupBy("doc_id", "told", "run", "part", "copy").agg(*of)
    span = F.struct(F.col("at").alias("start"), F.col("to").alias("end"))
    runs = parts.groupBy("doc_id", "told", "run").agg(
        F.min("at").alias("start"), F.max("to").alias("end"), F.sum("n_words").alias("n_words"), F.sum("n_chunks").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"), F.sort_array(F.collect_list(F.when(F.col("copy"), span))).alias("copied")
    )
    original = F.col("first_doc_id") == F.col("doc_id")
    return runs.where(F.col("n_words") >= least_words).select("doc_id", "start", "end", "n_words", "n_chunks", "first_doc_id", original.alias("original"), "copied", "told")


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the parts of passages that smaller doc_ids hold cut out of their texts.

    What stands in several documents stays in the least of them. Null and empty texts stay, as do rows without
    doc_id; rows that repeat get equal results; of ``passages``, doc_id, told and copied are read. Columns of any name are kept.
    A character that a cut splits becomes U+FFFD.
    """
    cut = passages.where(F.size("copied") > 0).groupBy("doc_id", "told").agg(F.sort_array(F.flatten(F.collect_list("copied"))).alias("cuts")).select(F.struct("doc_id", "told").alias("of"), "cuts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc.text")
    joined = rows.join(cut, F.struct(F.col("doc.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).alias("told")) == F.col("of"), "left")
    # bytes, as the spans count bytes: chunk boundaries may fall inside a character
    data = F.encode(text, "utf-8")
    keep = F.aggregate("cuts", F.struct(F.encode(F.lit(""), "utf-8").alias("out"), F.lit(0).cast("long").alias("at")), lambda s, c: F.struct(F.concat(s["out"], F.substring(data, (s["at"] + 1).cast("int"), F.greatest(c["start"] - s["at"], F.lit(0)).cast("int"))).alias("out"), F.greatest(s["at"], c["end"]).alias("at")))
    rest = F.concat(keep["out"], F.substring(data, (keep["at"] + 1).cast("int"), F.octet_length(text)))
    new = F.when(F.col("cuts").isNull(), text).otherwise(F.make_valid_utf8(rest.cast("string")))
    return joined.select(*[(new if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
