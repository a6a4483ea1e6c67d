"""Near-duplicate documents: SetSketch bands propose pairs, a joint estimate sifts them, full sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import kernels as K
from pagemill.llm import sketch as S
from pagemill.llm.components import components
from pagemill.llm.skew import join_counted
from pagemill.llm.storage import Stash

#: 32 bands of 6 registers find a pair of similarity 0.8 with a chance of 1 - (1 - 0.8 ** 6) ** 32 = 0.99994.
BANDS, ROWS = 32, 6
#: Six deviations of the estimate at 0.8: pairs estimated lower are not verified.
SLACK = 6 * (0.8 * 0.2 / (BANDS * ROWS)) ** 0.5
#: Members of a bucket that one task compares with each other at once.
BLOCK = 256
#: Rounds in which each bucket's members are compared with one of them.
PIVOTS = 2


def _sets(raw: np.ndarray, off: np.ndarray, k: int):
    """For each row: its word-sequence digest and its sorted distinct shingle hashes."""
    for i, j in K.slices(off):
        h, first, _, _ = K.words(raw, off[i : j + 1], K.SPACED)
        digest = K.text_digests(raw, h, first)
        sh, at = K.shingles(h, first, k)
        for r in range(j - i):
            x = np.sort(sh[at[r] : at[r + 1]])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            yield digest[r], x


def _profile(k: int):
    def run(batches):
        for batch in batches:
            raw, off = K.spans(batch.column("text"))
            nodes, sizes, regs = [], [], []
            for digest, x in _sets(raw, off, k):
                nodes.append(digest)
                sizes.append(len(x))
                regs.append(S.registers(x, BANDS * ROWS).tobytes() if len(x) else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("told"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "told", "node", "n_shingles", "regs"])

    return run


def _band_rows(batches):
    for batch in batches:
        if len(batch):
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(len(batch), -1)
            keys = S.band_keys(regs, BANDS)
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)
            yield pa.record_batch([pa.array(keys.reshape(-1)), pa.array(nodes)], ["key", "node"])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    floor = percent / 100 - SLACK

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("regs_a", "regs_b")]
            fa, fb = batch.column("full_a"), batch.column("full_b")
            sizes = [np.array([len(x.as_buffer()) // 8 for x in c]) for c in (fa, fb)]
            est = S.joint_estimate((regs[0] > regs[1]).sum(1), (regs[0] < regs[1]).sum(1), regs[0].shape[1], *sizes)
            keep = [i for i in np.flatnonzero(est >= floor) if _alike(np.frombuffer(fa[i].as_buffer(), np.uint64), np.frombuffer(fb[i].as_buffer(), np.uint64), percent)]
            yield pa.record_batch([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("root_a", "root_b")], ["a", "b"])

    return run


class _Groups:
    """Union-find over the few nodes of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _block(percent: int):
    """Compares all pairs of a bucket's block, or of two of its blocks, that no earlier link or bucket settles; links of components."""
    floor = percent / 100 - SLACK

    def run(table: pa.Table) -> pa.Table:
        n = len(table)
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        roots, part = (table.column(c).to_numpy() for c in ("root", "part"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(n, -1)
        full = [np.frombuffer(x, np.uint64) for x in table.column("full").to_pylist()]
        size = np.array([len(x) for x in full])
        keys = S.band_keys(regs, BANDS)
        here = int(np.flatnonzero((keys == key).all(axis=0))[0])
        groups, head = _Groups(n), {}
        for x, root in enumerate(roots):
            groups.join(head.setdefault(root, x), x)
        found = []
        for x in np.flatnonzero(part == i):
            other = np.flatnonzero((part == j) & (roots != roots[x]) & ((np.arange(n) > x) if i == j else True))
            if here:
                other = other[~(keys[other, :here] == keys[x, :here]).any(axis=1)]
            other = other[100 * np.minimum(size[other], size[x]) >= percent * np.maximum(size[other], size[x])]
            # the share of equal registers is near the similarity: far too low a share needs no estimate
            other = other[(regs[other] == regs[x]).sum(1) >= (floor - 0.1) * regs.shape[1]]
            if not len(other):
                continue
            est = S.joint_estimate((regs[x] > regs[other]).sum(1), (regs[x] < regs[other]).sum(1), regs.shape[1], np.full(len(other), size[x]), size[other])
            for y in other[np.argsort(-est, kind="stable")][: int((est >= floor).sum())]:
                if groups.find(x) != groups.find(y) and _alike(full[x], full[y], percent):
                    groups.join(x, y)
                    found.append((roots[x], roots[y]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Classes of near-duplicate documents: (doc_id, n_shingles, component_id, kept, told, stays).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its
    distinct k-word shingles (fewer words: the whole sequence; none: empty, linked with nothing).
    Two documents are linked when the Jaccard similarity of their full sets is at least
    ``percent / 100``; component_id is the least doc_id that links lead to. ``told`` is the text's
    64-bit hash, and ``stays`` marks the one text of each class that has that doc_id.

    Documents with one word sequence form a class, worked on once. Bands of each class's SetSketch
    registers put it into buckets. In pivot rounds each bucket's members are compared with one of
    them, which gathers dense groups. What then lies outside a bucket's largest component is compared, in
    blocks of bounded size, with each other and with that component, so no pair that shares a bucket
    goes unseen; blocks give back links of components, not pairs.

    Only ``doc_id`` and ``text`` are read, so other columns don't matter. A null text is empty. A
    null doc_id is a document of its own: component_id is null and it is kept. Rows that repeat
    a doc_id are told apart by their texts. An empty table gives an empty one. Words are compared
    by 64-bit hashes.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("told"))
    prof = stash.put("prof", docs.mapInArrow(_profile(k), "doc_id long, told long, node long, n_shingles long, regs binary"))
    named = prof.where("n_shingles > 0 and doc_id is not null")
    classes = stash.put("class", named.groupBy("node").agg(F.min(F.struct("doc_id", "told")).alias("of"), F.first("regs").alias("regs"), F.count("*").alias("n")).select("node", F.col("of.doc_id").alias("least"), F.col("of.told").alias("told"), "regs", "n"))
    bands = stash.put("bands", classes.select("node", "regs").mapInArrow(_band_rows, "key long, node long"))
    met = stash.put("shared", bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    bands2 = stash.put("met", join_counted(bands, met, "key", ["node"]))
    stash.drop("bands", "shared")
    some = classes.join(bands2.select("node").distinct(), "node", "left_semi").drop("n").withColumnRenamed("least", "doc_id")
    full = docs.where("doc_id is not null").join(some, ["doc_id", "told"]).mapInArrow(_full(k), "node long, regs binary, full binary")
    if not named.groupBy("doc_id", "told").count().where("count > 1").isEmpty():
        full = full.dropDuplicates(["node"])  # of rows that repeat a document, one is enough
    full = stash.put("full", full)
    roots = some.select("node", F.col("node").alias("root"))
    for turn in range(PIVOTS):
        if turn:
            # a bucket that one component fills stays so
            member = bands2 = _unsettled(bands2, roots, stash)
            if member.isEmpty():
                return _labelled(prof, classes, roots, stash)
        else:
            member = bands2.withColumn("root", F.col("node"))
        pivot = stash.put("pivot", member.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root")).alias("p"), F.count("*").alias("n")))
        pairs = join_counted(member, pivot, "key", ["node"]).where(F.col("root") != F.col("p.root"))
        this, that = F.struct("node", "root"), F.struct("p.node", "p.root")
        pairs = pairs.select(F.least(this, that).alias("l"), F.greatest(this, that).alias("g")).select(F.col("l.node").alias("a"), F.col("l.root").alias("root_a"), F.col("g.node").alias("b"), F.col("g.root").alias("root_b")).distinct()
        sides = [full.select(*[F.col(c).alias(f"{c}_{s}" if c != "node" else s) for c in full.columns]) for s in "ab"]
        links = pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_verify(percent), "a long, b long")
        roots = _merged(roots, links, stash)
    member = _unsettled(bands2, roots, stash)
    if member.isEmpty():
        return _labelled(prof, classes, roots, stash)
    dealt = _dealt(member, stash).join(full, "node")
    links = dealt.groupBy("key", "i", "j").applyInArrow(_block(percent), "a long, b long")
    return _labelled(prof, classes, _merged(roots, links, stash), stash)


def _merged(roots: DataFrame, links: DataFrame, stash: Stash) -> DataFrame:
    """Roots after components, given by their roots, are linked."""
    up = components(links, stash).select(F.col("node").alias("old"), F.col("root").alias("new"))
    # each root's new name, which the largest component's many nodes take too
    names = roots.groupBy("root").agg(F.count("*").alias("n")).join(up, F.col("root") == F.col("old"), "left").select("root", F.coalesce("new", "root").alias("new"), "n")
    names = stash.put("names", names)
    return stash.put("roots", join_counted(roots, names, "root", ["node"]).select("node", F.col("new").alias("root")))


def _dealt(member: DataFrame, stash: Stash) -> DataFrame:
    """(key, i, j, node, root, part): each bucket's members in the pairs of blocks that they are compared in.

    The bucket's largest component fills blocks of its own, which are not compared with each other.
    """
    size = member.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("big"), F.sum("c").alias("n"))
    parts = size.select("key", F.col("big.root").alias("most"), F.ceil((F.col("n") - F.col("big.c")) / BLOCK).alias("others"), F.ceil(F.col("big.c") / BLOCK).alias("bigs"), "n")
    h = F.xxhash64("node")
    own = join_counted(member, stash.put("parts", parts), "key", ["node"]).withColumn("in", F.col("root") == F.col("most"))
    own = own.withColumn("part", F.when(F.col("in"), F.col("others") + F.pmod(h, "bigs")).otherwise(F.pmod(h, "others")))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("in"), F.col("others")).otherwise(F.col("others") + F.col("bigs")) - 1)))
    return own.select("key", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "node", "root", "part")


def _full(k: int):
    """Full sets of the rows whose text has the class's digest."""

    def run(batches):
        for batch in batches:
            raw, off = K.spans(batch.column("text"))
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            keep, sets = [], []
            for r, (digest, x) in enumerate(_sets(raw, off, k)):
                if digest.astype(np.int64) == nodes[r]:
                    keep.append(r)
                    sets.append(x.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column("node").take(at), batch.column("regs").take(at), pa.array(sets, pa.binary())], ["node", "regs", "full"])

    return run


def _unsettled(bands: DataFrame, roots: DataFrame, stash: Stash) -> DataFrame:
    """Members, with their components, of the buckets that hold more than one component."""
    now = stash.put("now", bands.select("key", "node").join(roots, "node"))
    several = stash.put("several", now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"))
    out = stash.put("open", join_counted(now, several, "key", ["node"]))
    stash.drop("now", "several")
    return out


def _labelled(prof: DataFrame, classes: DataFrame, roots: DataFrame, stash: Stash) -> DataFrame:
    placed = stash.put("placed", classes.select("node", "least", "told", "n").join(roots, "node", "left").select("node", "least", "told", "n", F.coalesce("root", "node").alias("root")))
    best = stash.put("best", placed.groupBy("root").agg(F.min(F.struct("least", "told")).alias("best"), F.count("*").alias("n")))
    placed = stash.put("settled", join_counted(placed, best, "root", ["node"]).select("node", "best", "n"))
    stash.drop("placed", "best")
    rows = prof.select("doc_id", "told", "node", "n_shingles")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    # copies of one text are one class, however many there are
    linked = join_counted(rows.where(~alone), placed, "node", ["doc_id", "told"])
    stays = (F.col("doc_id") == F.col("best.least")) & (F.col("told") == F.col("best.told"))
    linked = linked.select("doc_id", "n_shingles", F.col("best.least").alias("component_id"), (F.col("doc_id") == F.col("best.least")).alias("kept"), "told", stays.alias("stays"))
    return linked.unionByName(rows.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "told", F.lit(True).alias("stays")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class: the one with the least doc_id; of rows of one doc_id and text, one stays.

    Documents without words, null and empty texts among them, and rows without doc_id all stay; rows that repeat
    a doc_id are told apart by their texts; an empty table gives an empty one. Columns of any name are kept.
    """
    found = near_duplicates(docs, k, percent)
    found = Stash(docs.sparkSession, "near").put("found", found.select("doc_id", "told", "n_shingles", "stays"))
    key = F.struct("doc_id", "told").alias("key")
    gone = found.where("not stays").select(key).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.withColumn("of", F.struct(F.col("doc.doc_id").cast("long").alias("doc_id"), F.xxhash64("doc.text").alias("told")))
    out = rows.join(gone, F.col("of") == F.col("key"), "left_anti")
    again = found.where("stays and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "told").count().where("count > 1").select(key)
    if not again.isEmpty():
        same = F.col("of") == F.col("key")
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["of"]))
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
