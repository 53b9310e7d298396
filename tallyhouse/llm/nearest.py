"""Nearest neighbours through stable projections of few dimensions, indexed by kd-trees.

Vectors are projected by Gaussian (2-stable) directions. A kd-tree over a bounded sample deals all vectors to regions of
the projected space; each region, in blocks of bounded size, is indexed by its own kd-tree. A query takes projected
neighbours one after the other, in order of distance, and verifies them on the original vectors. For a vector at distance s, the square of the
projected distance over s squared is chi-square distributed, so the search stops once the next projected distance is so
large that a vector nearer than the k-th one found would lie within it with the asked probability. A first round searches
each query's own region; a second one the regions that the test leaves open.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.llm.common import durable
from tallyhouse.llm.vectors import as_bytes, matrix, sample

#: Dimensions of the projection (even), and the chance with which a nearer vector is within the tested distance.
M, SURE = 32, 0.95
#: Vectors of a region on average, regions at most, vectors and queries of a block, points of a leaf and of a verification.
REGION, REGIONS, BLOCK, QUERIES, LEAF, AT_ONCE = 16384, 4096, 16384, 4096, 64, 64


def chi_square_cdf(x: float, m: int = M) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(m // 2):
        if i:
            term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, m: int = M) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, m) < p else (lo, mid)
    return hi


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(8128).standard_normal((dim, M))


def regions(points: np.ndarray, count: int) -> list[tuple]:
    """A kd-tree over the points as (dimension, cut, left, right) and (None, number, None, None); the root is the first."""
    nodes: list[tuple] = []
    leaves = 0

    def grow(p: np.ndarray, parts: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(())
        if parts > 1 and len(p) > 1:
            d = int(np.ptp(p, axis=0).argmax())
            cut = float(np.median(p[:, d]))
            low = p[:, d] < cut
            if low.any() and not low.all():
                nodes[at] = (d, cut, grow(p[low], parts // 2), grow(p[~low], parts - parts // 2))
                return at
        nodes[at] = (None, leaves, None, None)
        leaves += 1
        return at

    grow(points, count)
    return nodes


def region_of(nodes: list[tuple], p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), np.int64)
    todo = [(0, np.arange(len(p)))]
    while todo:
        at, rows = todo.pop()
        d, cut, left, right = nodes[at]
        if d is None:
            out[rows] = cut
            continue
        low = p[rows, d] < cut
        todo += [(left, rows[low]), (right, rows[~low])]
    return out


def gaps(nodes: list[tuple], p: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each region."""
    n = sum(x[0] is None for x in nodes)
    out = np.zeros((len(p), n))
    todo = [(0, np.zeros((len(p), p.shape[1])))]
    while todo:
        at, past = todo.pop()
        d, cut, left, right = nodes[at]
        if d is None:
            out[:, cut] = (past * past).sum(axis=1)
            continue
        for child, away in ((left, np.maximum(p[:, d] - cut, 0)), (right, np.maximum(cut - p[:, d], 0))):
            side = past.copy()
            side[:, d] = np.maximum(side[:, d], away)
            todo.append((child, side))
    return out


class Block:
    """A kd-tree over the projections of a block's vectors, as boxes of its leaves; verified: distances computed so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, project: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.points = p = vectors @ project
        self.verified = 0
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            d = int(np.ptp(p[rows], axis=0).argmax())
            order = rows[np.argpartition(p[rows, d], len(rows) // 2)]
            todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
        self.low = np.array([p[r].min(axis=0) for r in self.leaves])
        self.high = np.array([p[r].max(axis=0) for r in self.leaves])

    def search(self, own: int, query: np.ndarray, at: np.ndarray, k: int, within: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest but own; within: the k-th distance known so far.

        Leaves open in order of their boxes' distance. A point is verified once no closed leaf can hold a nearer one.
        """
        away = np.maximum(np.maximum(self.low - at, at - self.high), 0)
        gap = np.nan_to_num((away * away).sum(axis=1), nan=0.0, posinf=math.inf)
        order = np.argsort(gap, kind="stable")
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        rows, far = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, 4
        while True:
            frontier = gap[order[done]] if done < len(order) else math.inf
            ready = far <= frontier
            first = np.argsort(far[ready], kind="stable")
            now, now_far = rows[ready][first], far[ready][first]
            rows, far = rows[~ready], far[~ready]
            for i in range(0, len(now), AT_ONCE):
                kth = min(within, dist[k - 1] if len(dist) >= k else math.inf)
                if now_far[i] > limit * kth * kth:
                    break
                some = now[i : i + AT_ONCE]
                some = some[self.ids[some] != own]
                diff = self.vectors[some] - query
                self.verified += len(some)
                ids, dist = np.concatenate([ids, self.ids[some]]), np.concatenate([dist, np.sqrt((diff * diff).sum(axis=1))])
                best = np.lexsort((ids, dist))[:k]
                ids, dist = ids[best], dist[best]
            kth = min(within, dist[k - 1] if len(dist) >= k else math.inf)
            if done >= len(order) or frontier > limit * kth * kth:
                return ids, dist
            opened = np.concatenate([self.leaves[i] for i in order[done : done + step]])
            diff = self.points[opened] - at
            near = np.nan_to_num((diff * diff).sum(axis=1), nan=0.0, posinf=math.inf)
            rows, far = np.concatenate([rows, opened]), np.concatenate([far, near])
            done, step = done + step, step * 2


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, of all other vectors, nearest first.

    is_query: a condition on vec_id. score: Euclidean distance in double precision; ties go to the smaller vec_id. With
    fewer candidates all are returned. Vectors that are null, zero, empty or hold null or non-finite components, and rows
    without vec_id, take no part. A vector is compared with those of its own length, each length by an index of its own.
    Of rows that share a vec_id, the one whose vector has the least digest stands for it.
    """
    usable = as_bytes(vectors, id_col, vector_col).where("key is not null and vec_id is not null").select("vec_id", "key", "v")
    one = usable.groupBy("vec_id").agg(F.min(F.struct("key", "v")).alias("r")).select("vec_id", "r.*")
    base = durable(one)
    lengths = sorted(r["n"] for r in base.select(F.length("v").alias("n")).distinct().collect())  # dimensions of the models in use
    found = [_search(base.where(F.length("v") == n), n // 8, is_query, k) for n in lengths]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(base: DataFrame, dim: int, is_query, k: int) -> DataFrame:
    """search() over (vec_id, key, v) of one length and unique ids."""
    limit = chi_square_quantile(SURE)
    # Of equal vectors, the k + 1 smallest ids can be among results; each task keeps no more before they meet.
    first = Window.partitionBy("key").orderBy("vec_id")
    some = sample(base)
    kept = base.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).select("vec_id", "v")
    project = directions(dim)
    count = base.count()
    nodes = regions(some @ project, max(1, min(REGIONS, -(-count // REGION))))

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            m = matrix(b.column(1).to_pylist())
            region = region_of(nodes, m @ project) if len(m) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(region, pa.int64())], ["vec_id", "v", "region"])

    rows = durable(kept.mapInArrow(deal, "vec_id long, v binary, region long"))
    queries = base.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    blocks = rows.groupBy("region").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).alias("blocks"))

    def routed(first_round: bool):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                m = matrix(b.column(1).to_pylist())
                out: list[list[int]] = []
                if len(m):
                    p = m @ project
                    home = region_of(nodes, p)
                    if first_round:
                        out = [[int(r)] for r in home]
                    else:
                        bound = np.array([math.inf if x is None else x for x in b.column(2).to_pylist()])
                        with np.errstate(invalid="ignore", over="ignore"):
                            near = gaps(nodes, p) <= (limit * bound * bound)[:, None]
                        near[np.arange(len(p)), home] = False
                        out = [np.flatnonzero(r).tolist() for r in near]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], ["query_id", "v", "bound", "to"])

        return run

    def ask(asked: DataFrame, first_round: bool) -> DataFrame:
        sent = asked.mapInArrow(routed(first_round), "query_id long, v binary, bound double, to array<long>").select("query_id", "v", "bound", F.explode("to").alias("region"))
        sent = durable(sent)
        loads = sent.groupBy("region").agg((F.floor(F.count(F.lit(1)) / QUERIES) + 1).alias("parts")).join(blocks, "region")
        salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        own = rows.join(loads, "region").withColumn("block", salt("vec_id", "blocks")).withColumn("part", every("parts")).select("region", "block", "part", F.lit(0).alias("side"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("double").alias("bound"))
        come = sent.join(loads, "region").withColumn("part", salt("query_id", "parts")).withColumn("block", every("blocks")).select("region", "block", "part", F.lit(1).alias("side"), F.col("query_id").alias("id"), "v", "bound")

        def run(pdf):
            import pandas as pd

            here, there = pdf[pdf.side == 0], pdf[pdf.side == 1]
            out = []
            if len(here) and len(there):
                index = Block(here.id.to_numpy(np.int64), matrix(here.v), project)
                asked_for = matrix(there.v)
                for q, v, p, bound in zip(there.id.tolist(), asked_for, asked_for @ project, there.bound.tolist()):
                    ids, dist = index.search(q, v, p, k, math.inf if bound is None or bound != bound else bound, limit)
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": dist}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

        return own.unionByName(come).groupBy("region", "block", "part").applyInPandas(run, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    one = durable(ranked(ask(queries.withColumn("bound", F.lit(None).cast("double")), True)))
    bound = one.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    two = ask(queries.join(bound, "query_id", "left").select("query_id", "v", "bound"), False)
    return ranked(one.select("query_id", "vec_id", "score").unionByName(two)).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
