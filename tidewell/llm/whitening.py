"""Embedding whitening by TSQR.

The exact sums of the fitted rows centre them; each partition keeps only the R factor of a QR of its centred rows, factors are merged FAN at a time, level by
level, and the singular values and right vectors of the last one whiten. No covariance is formed, so small components keep their precision.

Entries become whole numbers, floor(64 * entry) + 1000000, and each distinct vector is fitted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fresh, others, saved, table

STEP, SHIFT, COMPONENTS, FAN = 64, 1_000_000, 16, 8
#: Entries are below this, so that a whole number of its own stands for each.
LARGEST = 2.0**54


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors and the sums of their dimensions, exactly; eigenvalues and unit eigenvectors (as columns) of their covariance, and what the covariance of the whitened rows is off by at most."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the means, which are taken off in two parts, whole and rest, so that nothing is lost to the shift."""
        return centred(x, self.n, self.sums)

    def kept(self, components: int = COMPONENTS) -> int:
        """Components with variance, so many at most; the others can't be scaled to one."""
        s = np.sqrt(self.values)
        return int((s[:components] > self.dim * np.finfo(float).eps * s[:1].sum()).sum())

    def whitened(self, x: np.ndarray, components: int = COMPONENTS) -> np.ndarray:
        k = self.kept(components)
        return self.centred(x) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))

    def explained(self, components: int = COMPONENTS) -> list[float | None]:
        total = float(self.values.sum())
        return [float(v) / total if total > 0 else None for v in self.values[:components]]

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sum)^2, exactly; None where a long can't hold one."""
        q, r = np.array([s // self.n for s in self.sums], dtype=np.int64), np.array([s % self.n for s in self.sums], dtype=np.int64)
        d = x - q
        most = self.n * (float(np.abs(d).max(initial=0)) + 1)
        if self.dim * most * most < 2**62:
            d = self.n * d - r
            return (d * d).sum(axis=1).tolist()
        wide = [sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(row, r)) for row in d]
        return [v if v < 2**63 else None for v in wide]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (x - np.array([s // n for s in sums], dtype=np.int64)) - np.array([(s % n) / n for s in sums])


def numbers(vector: Column) -> Column:
    """A vector's whole numbers; null for one that is null or holds null, non-finite or too large entries."""
    v = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return F.when(fine, F.transform(v, lambda c: F.floor(c * STEP) + SHIFT))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for b in batches:
            x = _matrix(b.column(0), dim)
            n += len(x)
            high, low = (x >> 30).sum(axis=0), (x & (2**30 - 1)).sum(axis=0)  # neither can overflow in a batch
            total = [t + (int(h) << 30) + int(w) for t, h, w in zip(total, high, low)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0)), pa.array([n] * dim, pa.int64())], ["dim", "s", "n"])

    return run


def _factors(dim: int, n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for b in batches:
            r = np.linalg.qr(np.vstack([r, centred(_matrix(b.column(0), dim), n, sums)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["node", "r"])

    return run


def _merge(dim: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([np.reshape(x, (-1, dim)) for x in pdf.sort_values("node")["r"]]), mode="r")
        return pd.DataFrame({"node": [int(pdf["node"].min()) // FAN], "r": [r.ravel()]})

    return run


def last_factor(fit: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """The R factor of all centred rows: one of each partition, then merged FAN at a time. The factors are small, so their table is all that a lost executor's work is taken from."""
    level = factors = saved(fit.mapInArrow(_factors(dim, n, sums), "node long, r array<double>"))
    top = factors.agg(F.max("node")).first()[0]
    while top > 0:
        level, top = level.groupBy(F.floor(F.col("node") / FAN).alias("parent")).applyInPandas(_merge(dim), "node long, r array<double>"), top // FAN
    r = np.array(level.first()["r"]).reshape(-1, dim)
    dropped(factors)
    return r


def _products(w: Whitening, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.kept(components)
        total = np.zeros((k + 1, k))
        for b in batches:
            y = w.whitened(_matrix(b.column(0), w.dim), components)
            total += np.vstack([y.T @ y, y.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "s"])

    return run


def identity_error(fit: DataFrame, w: Whitening, components: int = COMPONENTS) -> float:
    """The largest entry, without sign, of the covariance of fit's whitened rows less the identity."""
    k = w.kept(components)
    got = dict(fit.mapInArrow(_products(w, components), "at int, s double").groupBy("at").agg(F.sum("s")).collect())  # k * (k + 1) rows
    total = np.array([got[i] for i in range(k * (k + 1))]).reshape(k + 1, k) / w.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0))


def learn(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all distinct vectors, as whole numbers, of the most frequent length (of equal ones, the shorter); None without any. The distinct vectors lie in the shared folder while it is made."""
    rows = vectors.select(numbers(F.col(vector_col)).alias("x")).where("size(x) > 0")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if not sizes:
        return None
    dim = sizes[0]
    fit = saved(rows.where(F.size("x") == dim).distinct())
    got = fit.mapInArrow(_sums(dim), "dim int, s decimal(38,0), n long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()  # a row for each dimension
    n, sums = int(got[0]["n"]), [int(r["s"]) for r in got]
    _, s, right = np.linalg.svd(last_factor(fit, dim, n, sums))
    values, right = np.pad(s, (0, dim - len(s))) ** 2 / n, right.T
    right = right * np.where(right[np.abs(right).argmax(axis=0), range(dim)] < 0, -1.0, 1.0)
    w = Whitening(n, sums, values, right)
    w = Whitening(n, sums, values, right, identity_error(fit, w, components))
    dropped(fit)
    return w


RESULTS = ["deviation", "whitened"]


def whiten(vectors: DataFrame, w: Whitening | None, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vectors with deviation (long, null where a long can't hold it) and whitened (array<double>: a value for each component, null for those without variance); columns of those names are replaced.

    Rows whose vector is null or holds null, non-finite or too large (LARGEST) entries, or is not of the fitted length, are left out. Repeated rows each stay. No rows, or nothing fitted: no rows.
    """
    x, y = fresh(vectors, "numbers", "result")
    if w is None:
        none = F.struct(F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        return vectors.where("false").select(*others(vectors, RESULTS), none["deviation"].alias("deviation"), none["whitened"].alias("whitened"))
    k, shown = w.kept(components), min(components, w.dim)

    @F.arrow_udf("struct<deviation: long, whitened: array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            m = _matrix(b, w.dim)
            out = np.full((len(m), shown), np.nan)
            out[:, :k] = w.whitened(m, components)
            values = pa.array(out.ravel(), from_pandas=True)  # NaN becomes null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * shown), values)
            yield pa.StructArray.from_arrays([pa.array(w.deviations(m), pa.int64()), lists], RESULTS)

    rows = vectors.withColumn(x, numbers(F.col(vector_col))).where(F.size(x) == w.dim).withColumn(y, run(F.col(x)))
    return rows.select(*others(vectors, RESULTS), F.col(y)["deviation"].alias("deviation"), F.col(y)["whitened"].alias("whitened"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    w = learn(vectors)
    rows = whiten(vectors, w).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(v).cast("double") for v in (w.explained() if w else [])]).cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(w.error if w else None).cast("double").alias("identity_error")
    )
