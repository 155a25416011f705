"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Different vectors are dealt to shards by a hash, and each shard gets a graph: greedy beam searches propose the
neighbours of a node, relaxed distance pruning keeps those edges that no kept edge leads near to, reverse edges are pruned in
the same way. A query runs a beam search in every shard, and the shards' results are merged by exact scores. Inner products
become distances by one more coordinate, which gives all vectors of a shard the same norm. Equal vectors are one node that
carries the smallest numbers of its rows, enough for any query, so a vector that a third of all rows have is no hot spot.

A query asks every shard, and within one the search hardly grows with its size, so shards are as large as a task's memory
and the cores allow: of SMALL nodes while that gives no more shards than cores, then as many shards as cores, and from there
on of at most SHARD_BYTES. The searches are then the queries times the bytes of all vectors over SHARD_BYTES.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_all_but, stored, write_stored, written

SMALL = 4096
SHARD_BYTES = 48_000_000
QUERY_BLOCK = 2048
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
BATCH = 256
EXPAND = 4


class Graph:
    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray, entry: int):
        self.x, self.neighbours, self.entry = vectors, neighbours, entry
        self.norm = np.einsum("ij,ij->i", vectors, vectors)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam searches side by side: the nodes of each beam, nearest first (-1: none), and their squared distances less the query's."""
        n, q = len(self.x), len(queries)
        beam = min(beam, n)
        ids = np.full((q, beam), -1, np.int64)
        dist = np.full((q, beam), np.inf, np.float32)
        done = np.ones((q, beam), bool)
        seen = np.zeros((q, n + 1), bool)
        seen[:, n] = True  # stands for no neighbour
        ids[:, 0], done[:, 0] = self.entry, False
        dist[:, 0] = self.norm[self.entry] - 2 * (queries @ self.x[self.entry])
        seen[:, self.entry] = True
        while True:
            score = np.where(done, np.inf, dist)
            pick = np.argsort(score, axis=1)[:, :EXPAND]
            fresh = np.isfinite(np.take_along_axis(score, pick, axis=1))
            active = np.flatnonzero(fresh.any(axis=1))
            if not len(active):
                return ids, dist
            pick, fresh = pick[active], fresh[active]
            np.put_along_axis(d := done[active], pick, True, axis=1)
            done[active] = d
            nodes = np.take_along_axis(ids[active], pick, axis=1)
            near = np.where(fresh[:, :, None], self.neighbours[nodes], n).reshape(len(active), -1)
            near = np.where(near < 0, n, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            a = active[:, None]
            near = np.where(seen[a, near], n, near)
            seen[a, near] = True
            real = np.minimum(near, n - 1)
            new = self.norm[real] - 2 * np.einsum("ad,ard->ar", queries[active], self.x[real])
            new[near == n] = np.inf
            all_d = np.concatenate([dist[active], new], axis=1)
            all_i = np.concatenate([ids[active], near], axis=1)
            all_done = np.concatenate([done[active], near == n], axis=1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam] if all_d.shape[1] > beam else np.argsort(all_d, axis=1)
            order = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, axis=1), axis=1, kind="stable"), axis=1)
            dist[active], ids[active], done[active] = (np.take_along_axis(v, order, axis=1) for v in (all_d, all_i, all_done))


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node the candidates (-1: none) that stay: the nearest again and again, each one ending those that it is near to.

    A candidate ends if alpha times its distance to a kept one is at most its distance to the node.
    """
    n = len(nodes)
    bad = (candidates < 0) | (candidates == nodes[:, None])
    c = np.where(bad, 0, candidates)
    near = x[c]
    d = ((near - x[nodes][:, None, :]) ** 2).sum(axis=2)
    d[bad] = np.inf
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for k in range(degree):
        best = d.argmin(axis=1)
        live = np.isfinite(d[rows, best])
        if not live.any():
            break
        out[live, k] = c[rows, best][live]
        gap = ((near - near[rows, best][:, None, :]) ** 2).sum(axis=2)
        d[(alpha * alpha * gap <= d) & live[:, None]] = np.inf
        d[rows, best] = np.inf
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours by node for different vectors (float32, one more coordinate included)."""
    n = len(vectors)
    rng = np.random.default_rng(7)
    neighbours = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), -1, np.int64)
    neighbours[neighbours == np.arange(n)[:, None]] = -1
    entry = medoid(vectors)
    for a in (1.0, alpha) if n > degree else (alpha,):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            batch = order[at : at + BATCH]
            found, _ = Graph(vectors, neighbours, entry).search(vectors[batch], beam)
            pool = np.concatenate([found, neighbours[batch]], axis=1)
            neighbours[batch] = robust_prune(vectors, batch, _once(pool), degree, a)
            source = np.repeat(batch, degree)
            target = neighbours[batch].ravel()
            source, target = source[target >= 0], target[target >= 0]
            _add_reverse(vectors, neighbours, source, target, degree, a)
    return neighbours


def _once(pool: np.ndarray) -> np.ndarray:
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    return pool


def _add_reverse(x: np.ndarray, neighbours: np.ndarray, source: np.ndarray, target: np.ndarray, degree: int, alpha: float) -> None:
    """Edges target -> source; nodes with too many are pruned, those with room keep all."""
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, start, count = np.unique(target, return_index=True, return_counts=True)
    for a in range(0, len(nodes), 512):
        some, s, m = nodes[a : a + 512], start[a : a + 512], count[a : a + 512]
        more = np.full((len(some), m.max()), -1, np.int64)
        column = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        more[np.repeat(np.arange(len(some)), m), column] = source[s[0] : s[0] + m.sum()]
        pool = -np.sort(-_once(np.concatenate([neighbours[some], more], axis=1)), axis=1)
        full = (pool >= 0).sum(axis=1) > degree
        fits = pool[:, :degree] if pool.shape[1] >= degree else np.pad(pool, ((0, 0), (0, degree - pool.shape[1])), constant_values=-1)
        neighbours[some[~full]] = fits[~full]
        if full.any():
            neighbours[some[full]] = robust_prune(x, some[full], pool[full], degree, alpha)


def medoid(x: np.ndarray) -> int:
    return int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate, by which all have the norm of the largest: then nearest means largest inner product."""
    square = (vectors**2).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)


# ------------------------------------------------------------------ tables


def usable(c: Column | str) -> Column:
    """Not null, not empty, not zero, and all components finite numbers."""
    c = F.col(c) if isinstance(c, str) else c
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return c.isNotNull() & finite & F.exists(c, lambda v: v != 0)


def shards_for(nodes: int, dim: int, cores: int, small: int = SMALL, most_bytes: int = SHARD_BYTES) -> int:
    """How many shards: at least what keeps each under most_bytes (vectors twice, neighbours), and up to one for each core."""
    most = max(small, most_bytes // (12 * dim + 8 * DEGREE + 64))
    return max(1, -(-nodes // most), min(cores, -(-nodes // small)))


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, shard: int | None = None, beam: int = SEARCH_BEAM) -> DataFrame:
    """embeddings (vec_id, embedding), queries (query_id, embedding) -> query_id, rank (from 1), vec_id, score: the k largest
    inner products found, among the rows whose vec_id isn't the query's; ties go to the smaller vec_id.

    Unusable vectors (see usable) and null numbers take no part; rows that repeat a number and its vector count once. A
    query meets the vectors of its own length. Fewer than k candidates: all of them. Empty tables: no rows.
    shard: nodes in a shard, where shards_for() isn't to choose.
    """
    spark, before = embeddings.sparkSession, written()
    rows = embeddings.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", "embedding").distinct()
    order = Window.partitionBy("embedding").orderBy("vec_id")
    least = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    nodes = stored(least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = stored(queries.where(usable("embedding") & F.col("query_id").isNotNull()).select("query_id", "embedding").distinct(), "queries")
    there = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    shards = max(1, -(-there[0] // shard)) if shard else shards_for(there[0], there[1] or 1, spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    dim = F.size("embedding").alias("dim")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        x = lifted(vectors)
        near = build(x).astype(np.int32)
        ids = [list(map(int, i)) for i in pdf["ids"]]
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "x": [x.tobytes()], "v": [vectors.tobytes()], "n": [near.tobytes()], "ids": [ids]})

    dealt = nodes.select(dim, F.pmod(F.xxhash64("embedding"), F.lit(shards)).alias("shard"), "embedding", "ids")
    graphs = stored(dealt.groupBy("dim", "shard").applyInPandas(make, "dim int, shard long, x binary, v binary, n binary, ids array<array<long>>"), "graphs")

    def ask(graph: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(graph) or not len(block):
            return none
        g, out = graph.iloc[0], []
        d = int(g["dim"])
        x, v, n = np.frombuffer(g["x"], np.float32).reshape(-1, d + 1), np.frombuffer(g["v"], np.float64).reshape(-1, d), np.frombuffer(g["n"], np.int32).reshape(-1, DEGREE)
        index = Graph(x, n.astype(np.int64), medoid(x))
        q = np.stack(block["embedding"].to_numpy()).astype(np.float64)
        for a in range(0, len(q), BATCH):
            found, _ = index.search(np.pad(q[a : a + BATCH], ((0, 0), (0, 1))).astype(np.float32), beam)
            for one, near, number in zip(q[a : a + BATCH], found, block["query_id"].iloc[a : a + BATCH]):
                near = near[(near >= 0) & (near < len(v))]
                scores = (v[near] * one).sum(axis=1)
                rows = [(-s, i) for s, node in zip(scores, near) for i in g["ids"][node] if i != number]
                out += [(number, i, -s) for s, i in sorted(rows)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else none

    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.select("query_id", "embedding", dim, F.pmod(F.xxhash64("query_id", "embedding"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(ask, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    path = write_stored(out, "nearest")
    drop_all_but(spark, before, {path})
    return spark.read.parquet(path)
