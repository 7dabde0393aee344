"""Exact top-k inner products by a KD-tree in each shard.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard is split at medians into a tree whose
nodes have tight bounding boxes. A query visits nodes best-first by the largest inner product that a box allows and
stops where that falls below its k-th score. The k-th scores found in one pilot shard travel with the queries to all
other shards, so these are pruned from the start.

A query block meets every shard, so vectors are shipped once for each block: blocks are large, and integers as narrow as
the largest component allows.

Cases: vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part; only
vectors of one length meet; equal scores go to the smaller id; a query with fewer candidates gets them all; rows that
repeat an id are candidates each, but not of a query of that id; an empty table gives no rows. A score is a long: where
the largest component m of the scaled vectors could take one beyond it, that is dim * m^2 >= 2^63, a ValueError tells so.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAF = 128


@dataclass(frozen=True)
class Settings:
    k: int = 20
    scale: int = 64
    shard_rows: int = 8192
    block_rows: int = 2048


@dataclass
class Tree:
    """Nodes in order of depth first; a leaf's points are start to end, an inner node's children are left and right."""

    ids: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    spans: np.ndarray  # start, end, left, right

    @staticmethod
    def build(ids: np.ndarray, points: np.ndarray) -> Tree:
        order = np.arange(len(ids))
        spans: list[list[int]] = []
        low, high = [], []
        todo = [(0, len(ids), -1, 2)]
        while todo:
            start, end, parent, side = todo.pop()
            here = len(spans)
            if parent >= 0:
                spans[parent][side] = here
            part = points[order[start:end]]
            low.append(part.min(0))
            high.append(part.max(0))
            spans.append([start, end, -1, -1])
            if end - start > LEAF:
                axis = int(np.argmax(high[-1] - low[-1]))
                middle = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(part[:, axis], middle)]
                todo += [(start, start + middle, here, 2), (start + middle, end, here, 3)]
        return Tree(ids[order], points[order], np.array(low), np.array(high), np.array(spans))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, id, score) of the k best of each query in this tree, of those that reach the query's k-th score."""
        most = (float(np.abs(x.astype(float)).max()) for x in (self.points, queries))
        exact = math.prod(most) * queries.shape[1] < 2.0**53
        kind = np.float64 if exact else np.int64  # floats of that size are exact and faster
        points, q = self.points.astype(kind), queries.astype(kind)
        bounds = np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        out = []
        for row, own in enumerate(query_ids):
            bound, floor = bounds[row], kth[row]
            scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
            heap = [(-bound[0], 0)]
            while heap:
                best, node = heapq.heappop(heap)
                if -best < floor:
                    break
                start, end, left, right = self.spans[node]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= floor:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                score = (points[start:end] @ q[row]).astype(np.int64)
                keep = (score >= floor) & (self.ids[start:end] != own)
                if keep.any():
                    scores, found = np.append(scores, score[keep]), np.append(found, self.ids[start:end][keep])
                    if len(scores) > k:
                        top = np.lexsort((found, -scores))[:k]
                        scores, found = scores[top], found[top]
                    if len(scores) == k:
                        floor = max(floor, int(scores.min()))
            out += [(int(own), int(i), int(s)) for i, s in zip(found, scores, strict=True)]
        return out


LOWEST = -(1 << 62)


def fitting(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, x) of the vectors that take part, as doubles."""
    fit = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fit, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("x"))


def counted(rows: DataFrame) -> tuple[int, int, float]:
    """Rows, the largest dimension and the largest component in size."""
    r = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).first()
    return r.n, r.dim or 0, r.most or 0.0


def width(rows: tuple[int, int, float], asked: tuple[int, int, float], scale: int) -> np.dtype:
    """The narrowest integers that hold floor(scale * x)."""
    most = max(rows[2], asked[2]) * scale + 1
    if most * most * max(rows[1], asked[1]) >= 2.0**63:
        raise ValueError(f"scores of components as large as {most / scale:.3g} do not fit a long")
    return np.dtype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of `vectors` for each of `queries` (both vec_id, embedding).

    Every query meets every shard once, in blocks: rows shuffled are queries times shards and vectors times blocks.
    """
    k = settings.k
    rows, asked = fitting(vectors), fitting(queries)
    in_rows, in_asked = counted(rows), counted(asked)
    kind = width(in_rows, in_asked, settings.scale)
    shards = max(1, -(-in_rows[0] // settings.shard_rows))
    blocks = max(1, -(-in_asked[0] // settings.block_rows))
    rows, asked = (df.select("vec_id", "dim", F.transform("x", lambda x: F.floor(x * settings.scale).cast("long")).alias("v")) for df in (rows, asked))

    def packed(*columns: np.ndarray) -> tuple[bytes, ...]:
        """Ids and spans as they are, points narrow."""
        return tuple(np.ascontiguousarray(x, np.int64 if x.ndim == 1 else kind).tobytes() for x in columns)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree.build(pdf.vec_id.to_numpy(), np.stack(pdf.v.to_numpy()))
        return pd.DataFrame([(pdf.dim.iloc[0], pdf.shard.iloc[0], *packed(tree.ids, tree.points, tree.low, tree.high, tree.spans.ravel()))])

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        kth = np.full(len(pdf), LOWEST) if "kth" not in pdf else pdf.kth.fillna(LOWEST).to_numpy()
        return pd.DataFrame([(pdf.dim.iloc[0], pdf.block.iloc[0], *packed(pdf.vec_id.to_numpy(), np.stack(pdf.v.to_numpy()), kth))])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for r in pdf.itertuples(index=False):
            ids, spans, query_ids, kth = (np.frombuffer(x, np.int64) for x in (r.ids, r.spans, r.query_ids, r.kth))
            points, low, high, q = (np.frombuffer(x, kind) for x in (r.points, r.low, r.high, r.q))
            tree = Tree(ids, points.reshape(-1, r.dim), low.reshape(-1, r.dim), high.reshape(-1, r.dim), spans.reshape(-1, 4))
            found += tree.search(query_ids, q.reshape(-1, r.dim), kth, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    own = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    trees = cut(own.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids binary, points binary, low binary, high binary, spans binary"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    bundled = "dim int, block int, query_ids binary, q binary, kth binary"

    def searched(bundles: DataFrame, first: int, last: int) -> DataFrame:
        # joined by block too, so that no task gets a shard's meetings with all blocks
        own = trees.filter(F.col("shard").between(first, last)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = bundles.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(own, ["dim", "shard", "block"])
        return met.groupBy("dim", "shard", "block").applyInPandas(search, "query_id long, vec_id long, score long")

    pilot = cut(searched(asked.groupBy("dim", "block").applyInPandas(bundle, bundled), 0, 0))
    if shards == 1:
        every = pilot
    else:
        # only a query that has found k candidates has a k-th score
        kth = pilot.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).withColumnRenamed("query_id", "vec_id")
        bundles = asked.join(kth, "vec_id", "left").groupBy("dim", "block").applyInPandas(bundle, bundled)
        every = pilot.unionByName(searched(bundles, 1, shards - 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
