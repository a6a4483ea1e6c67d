"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched with a beam."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.storage import Stash

#: A shard holds SHARD vectors at least; with more than SHARDS shards of that size, shards grow, up to SHARD_BYTES of vectors.
SHARD, SHARDS, SHARD_BYTES = 4096, 256, 64 << 20
#: Queries of a block.
QUERIES = 1024
#: Out-degree, beam width while building and while searching, and the relaxation of pruning.
DEGREE, BEAM, SEARCH, ALPHA = 32, 64, 96, 1.2
_BATCH = 256


def _near_origin(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """``others`` in single precision, after the step that moves the mean of ``vectors`` to 0 and scales them to 1 at most.

    Differences would drown in squares of vectors far from the origin, and very large ones have no squares.
    """
    scale = np.abs(vectors).max() or 1.0
    mean = (vectors / scale).mean(0)
    spread = np.abs(vectors / scale - mean).max() or 1.0
    return ((others / scale - mean) / spread).astype(np.float32)


def _beam(vectors: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, width: int):
    """Greedy beam searches, all queries at once: the beams (ids, squared distances) and the nodes expanded."""
    b, n = len(queries), len(vectors)
    width = min(width, n)
    norm = np.einsum("ij,ij->i", vectors, vectors)
    own = np.einsum("ij,ij->i", queries, queries)
    ids = np.full((b, width), -1, np.int64)
    dist = np.full((b, width), np.inf, np.float32)
    done = np.ones((b, width), bool)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for "no neighbour"
    ids[:, 0], done[:, 0], seen[:, start] = start, False, True
    dist[:, 0] = own + norm[start] - 2 * (queries @ vectors[start])
    rows = np.arange(b)
    expanded: list[np.ndarray] = []
    while True:
        open_ = np.where(done, np.inf, dist)
        at = open_.argmin(1)
        live = np.flatnonzero(np.isfinite(open_[rows, at]))
        if not len(live):
            return ids, dist, np.stack(expanded, 1) if expanded else np.zeros((b, 0), np.int64)
        node = np.full(b, -1, np.int64)
        node[live] = ids[live, at[live]]
        expanded.append(node)
        done[live, at[live]] = True
        near = graph[node[live]]
        near = np.where(near < 0, n, near)
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        near = np.where(new, near, 0)
        d = own[live, None] + norm[near] - 2 * np.matmul(vectors[near], queries[live][:, :, None])[:, :, 0]
        d = np.where(new, d, np.inf).astype(np.float32)
        all_ids, all_d = np.concatenate([ids[live], near], 1), np.concatenate([dist[live], d], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        best = np.argsort(all_d, 1, kind="stable")[:, :width]
        ids[live], dist[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_d, all_done))


def _prune(vectors: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each node's candidates (-1: none): the nearest stays, and drops those that it is nearer to, times alpha, than the node is."""
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == nodes[:, None]] = -1
    x, p = vectors[cand], vectors[nodes]
    norm = np.einsum("bij,bij->bi", x, x)
    d = np.where(cand < 0, np.inf, norm + np.einsum("bj,bj->b", p, p)[:, None] - 2 * np.einsum("bij,bj->bi", x, p))
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    alive = d.copy()
    for k in range(degree):
        pick = alive.argmin(1)
        ok = np.isfinite(alive[rows, pick])
        if not ok.any():
            break
        out[ok, k] = cand[rows, pick][ok]
        alive = np.where(alpha * alpha * between[rows, pick] <= d, np.inf, alive)
        alive[rows, pick] = np.inf
    return out


def build(vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """The graph of distinct float32 vectors, and where searches start (the one nearest to the mean)."""
    n = len(vectors)
    rng = np.random.default_rng(7)
    graph = np.full((n, DEGREE), -1, np.int32)
    start = int(((vectors - vectors.mean(0)) ** 2).sum(1).argmin())
    if n <= DEGREE + 1:
        for i in range(n):
            graph[i, : n - 1] = np.delete(np.arange(n), i)
        return graph, start
    graph[:, : DEGREE // 2] = rng.integers(0, n, (n, DEGREE // 2))
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for i in range(0, n, _BATCH):
            nodes = order[i : i + _BATCH]
            beam, _, path = _beam(vectors, graph, start, vectors[nodes], BEAM)
            graph[nodes] = _prune(vectors, nodes, np.concatenate([path, beam, graph[nodes]], 1), DEGREE, alpha)
            src, dst = np.repeat(nodes, DEGREE), graph[nodes].reshape(-1).astype(np.int64)
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            to, first, count = np.unique(dst, return_index=True, return_counts=True)
            for j in range(0, len(to), _BATCH):
                part, c, f = to[j : j + _BATCH], count[j : j + _BATCH], first[j : j + _BATCH]
                back = np.full((len(part), int(c.max())), -1, np.int64)
                fill = np.arange(back.shape[1])[None, :] < c[:, None]
                back[fill] = src[np.repeat(f, c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)]
                graph[part] = _prune(vectors, part, np.concatenate([graph[part].astype(np.int64), back], 1), DEGREE, alpha)
    return graph, start


def _index(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row: a shard's distinct vectors, the row ids of each with their numbers of rows, and the graph."""
    ids, many = table.column("vec_id").to_numpy(), table.column("m").to_numpy()
    dim = key[0].as_py()
    x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0  # no negative zeros
    distinct, of = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, of.reshape(-1)))
    first = np.searchsorted(of.reshape(-1)[order], np.arange(len(distinct) + 1))
    graph, start = build(_near_origin(distinct, distinct))
    blobs = [distinct, ids[order], many[order], first.astype(np.int64), graph]
    return pa.table({"dim": [key[0]], "shard": [key[1]], "start": pa.array([start], pa.int32()), **{c: pa.array([b.tobytes()], pa.binary()) for c, b in zip(("vectors", "ids", "many", "first", "graph"), blobs, strict=True)}})


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return pa.table({"dim": [key[0]], "block": [key[1]], "q_ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "q_vectors": pa.array([x.tobytes()], pa.binary())})


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        dim = row["dim"]
        x, q = (np.frombuffer(row[c]).reshape(-1, dim) for c in ("vectors", "q_vectors"))
        ids, many, first, q_ids = (np.frombuffer(row[c], np.int64) for c in ("ids", "many", "first", "q_ids"))
        graph = np.frombuffer(row["graph"], np.int32).reshape(-1, DEGREE)
        small, asked = _near_origin(x, x), _near_origin(x, q)
        out: list[tuple] = []
        for i in range(0, len(q), _BATCH):
            # a query far outside of the shard may have no square in single precision; where it ends is the nearest start then
            beam, _, _ = _beam(small, graph, row["start"], np.clip(asked[i : i + _BATCH], -1e15, 1e15), max(SEARCH, 2 * k))
            for r, nodes in enumerate(beam):
                nodes = nodes[nodes >= 0]
                d = np.sqrt(((x[nodes] - q[i + r]) ** 2).sum(1))
                each: list[tuple] = []
                for score, node in zip(d.tolist(), nodes.tolist(), strict=True):
                    own = bool((x[node] == q[i + r]).all())
                    # a vector's least ids are the only ones that can be among the k nearest
                    at = slice(first[node], min(first[node + 1], first[node] + k + 1))
                    for v, m in zip(ids[at].tolist(), many[at].tolist(), strict=True):
                        each += [(score, v)] * (m - (own and v == q_ids[i + r]))
                each.sort()
                out += [(int(q_ids[i + r]), q[i + r].tobytes(), v, s) for s, v in each[:k]]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.float64()), strict=True)], ["query_id", "q", "vec_id", "score"])

    return run


def _usable(vectors: DataFrame, k: int) -> DataFrame:
    """Rows (vec_id, v, dim, m): m rows are equal, of which more than k + 1 tell nothing more."""
    ok = F.forall("embedding", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim")).agg(F.least(F.count("*"), F.lit(k + 1)).cast("long").alias("m"))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Each query's k nearest rows that the search finds: (query_id, rank, vec_id, score), nearest first, ties to the smaller vec_id.

    ``vectors`` and ``queries`` have vec_id and embedding; by default the queries are the rows whose vec_id is
    divisible by 100. The score is the Euclidean distance in double precision; every row but the query's own
    is a candidate. Every row is indexed: rows are dealt by a hash into shards,
    and a shard's distinct vectors form a graph that greedy searches propose and
    relaxed pruning thins. Queries meet every shard in blocks, and a shard's best k are merged; shards grow with the
    rows, up to SHARD_BYTES, so that few searches do.

    Rows without vec_id, and vectors that are null, zero, or hold a null or non-finite component,
    take no part; vectors of different lengths never meet. Equal vectors are one node, and all its rows can be found: a row that
    repeats is a candidate for its like. Equal rows ask once; rows of one vec_id with different vectors ask each, under that id. Empty tables give an empty result; other columns are not read.
    """
    stash = Stash(vectors.sparkSession, "nearest")
    rows = stash.put("rows", _usable(vectors, k))
    asked = rows.where("vec_id % 100 = 0") if queries is None else stash.put("asked", _usable(queries, k))
    shard = F.greatest(F.least(F.count("*") / SHARDS, F.lit(float(SHARD_BYTES)) / 8 / F.col("dim")), F.lit(float(SHARD)))
    parts = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard).alias("parts"))
    # a partition for each shard: building a graph takes long beside the bytes that it reads
    tasks = max(1, int(parts.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]))
    dealt = rows.join(parts, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), "parts"))
    index = dealt.select("dim", "shard", "vec_id", "v", "m").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(_index, "dim int, shard long, start int, vectors binary, ids binary, many binary, first binary, graph binary")
    index = stash.put("index", index)
    asked = asked.join(asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), "blocks"))
    blocks = asked.select("dim", "block", "vec_id", "v").groupBy("dim", "block").applyInArrow(_pack, "dim int, block long, q_ids binary, q_vectors binary")
    blocks = stash.put("blocks", blocks).join(parts, "dim").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("shard")).drop("parts")
    met = index.join(blocks, ["dim", "shard"]).repartition(tasks, "dim", "shard").groupBy("dim", "shard", "block").applyInArrow(_search(k), "query_id long, q binary, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
