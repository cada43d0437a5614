"""Nearest neighbours by inner product: a forest of hash prefixes.

Vectors get one more component that makes their lengths equal, so that the largest inner product is the smallest angle. In each of TREES trees a vector has a
string of BITS signs of random projections; a tree is the sorted array of these strings. A query descends every tree to the
vectors that share its longest prefix, then ascends in all trees together, one sign at a time, until they hold ENOUGH candidates; these are scored exactly.

The rows lie in shards of bounded size with a forest each, and every block of queries meets every shard, so no task
holds more than SHARD rows and QUERIES queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

TREES, BITS, ENOUGH, SHARD, QUERIES, SEED = 64, 32, 4096, 8192, 2048, 7


class Forest:
    """Sorted hash strings of some vectors, tree by tree."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS) -> None:
        self.vectors, self.longest, self.trees, self.bits = vectors, longest, trees, bits
        self.planes = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, trees * bits))
        hashed = self.strings(vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0)))
        self.order = np.argsort(hashed, axis=0, kind="stable")
        self.sorted = np.take_along_axis(hashed, self.order, axis=0)

    def strings(self, vectors: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """The hash strings as unsigned numbers, the first sign highest: a row for each vector, a column for each tree."""
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        out = np.empty((len(vectors), self.trees), dtype=np.uint64)
        for at in range(0, len(vectors), 512):
            part = np.column_stack([vectors[at : at + 512], extra[at : at + 512]]) @ self.planes > 0
            out[at : at + 512] = (part.reshape(len(part), self.trees, self.bits) * weights).sum(axis=2, dtype=np.uint64)
        return out

    def ranges(self, queries: np.ndarray, enough: int = ENOUGH) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of each query in each tree's array: all that share a prefix of one length, the longest at which the trees hold enough together."""
        hashed = self.strings(queries, np.zeros(len(queries)))
        low, high = np.zeros(hashed.shape, dtype=np.int64), np.full(hashed.shape, len(self.vectors), dtype=np.int64)
        open_rows = np.arange(len(queries))
        for length in range(self.bits, 0, -1):
            rest = np.uint64(self.bits - length)
            first = (hashed[open_rows] >> rest) << rest
            a, b = np.empty_like(low[open_rows]), np.empty_like(low[open_rows])
            for t in range(self.trees):
                a[:, t] = np.searchsorted(self.sorted[:, t], first[:, t])
                b[:, t] = np.searchsorted(self.sorted[:, t], first[:, t] + (np.uint64(1) << rest))
            done = (b - a).sum(axis=1) >= enough
            low[open_rows[done]], high[open_rows[done]] = a[done], b[done]
            open_rows = open_rows[~done]
            if not len(open_rows):
                break
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(self.vectors), dtype=bool)
        for t, (a, b) in enumerate(zip(low, high)):
            mark[self.order[a:b, t]] = True
        return np.flatnonzero(mark)


def _search(k: int, longest: float, enough: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(queries):
            rows = rows.sort_values(["vec_id", "row"])
            vectors = np.array(rows["v"].tolist(), dtype=np.float64)
            ids, own = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
            forest = Forest(vectors, longest)
            asked = np.array(queries["query_v"].tolist(), dtype=np.float64)
            low, high = forest.ranges(asked, enough)
            for i, (q, query) in enumerate(zip(queries["query_row"], queries["query_id"])):
                near = forest.candidates(low[i], high[i])
                near = near[own[near] != q]
                score = vectors[near] @ asked[i]
                if len(near) > k:  # all that may be among the k, ties included
                    keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                    near, score = near[keep], score[keep]
                best = np.lexsort((ids[near], -score))[:k]
                out += [(q, query, ids[near[b]], own[near[b]], score[b]) for b in best]
        return pd.DataFrame(out, columns=["q", "query_id", "vec_id", "row", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", enough: int = ENOUGH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where is_query holds, among all other rows.

    Rows take no part whose vector is null, zero or empty, holds nulls or non-finite numbers, or is not of the most frequent length (of equal ones, the
    shorter). Ties go to the smaller id. Nor do rows with a null id, which no result could name. Rows with equal ids, and equal rows, are each a candidate, and each a query.
    Vectors may be of any length; other columns play no part. No rows: no rows.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), v.alias("v"), is_query.alias("ask")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    rows = saved(rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("ask").alias("asks"), F.max("norm").alias("norm")).orderBy(F.desc("n"), "d").first()
    dim, n, asks, longest = sizes or (0, 0, 0, 0.0)
    rows = rows.where(F.size("v") == dim)
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asks // QUERIES))
    to = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.select(to(shards).alias("shard"), every(blocks).alias("block"), "row", "vec_id", "v")
    right = rows.where("ask").select(every(shards).alias("shard"), to(blocks).alias("block"), F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("query_v"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_search(k, float(longest), enough), "q long, query_id long, vec_id long, row long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
