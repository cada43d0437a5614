"""Quality classifier: scores of documents learned from preference pairs.

A document of label 1 is preferred to one of label 0. In the Bradley-Terry model the chance that one is preferred is the logistic function of the difference of
their scores, here linear in measures of the text; the weights minimise the logistic loss on differences of measures over sampled pairs. The cut is the
quantile of the labelled scores that parts the two labels best, and scores are scaled so that the cut stands at THRESHOLD.

A text is measured whole, in time that grows with its length. Labels, language, source and id take no part in a score: equal texts have equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, others, parts_of, table
from .quality import measure

#: Labelled rows that are fitted at most, those of least hash of the id, and pairs that are drawn of them.
MAX_LABELLED, PAIRS, SEED = 20_000, 200_000, 11
THRESHOLD = 0.3
FOLDS = 5
SIGNALS = [
    "upper", "digit", "blank", "exclaim", "bar", "mark", "stop", "wide", "lines", "length", "spread", "distinct", "again", "repeats", "dup_lines", "entropy", "packed", "n_words", "short", "capital",
]


def signals(text: str | None) -> list[float]:
    """SIGNALS of one whole text; all 0 for null or empty. Shares of characters, of words and of lines, but for lengths and logarithms."""
    if not text:
        return [0.0] * len(SIGNALS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n, few = len(codes), np.bincount(codes[codes < 128], minlength=128)
    chars = [few[65:91], few[48:58], few[[9, 10, 11, 12, 13, 32]], few[33], few[124], few[[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 126]], few[[46, 63]]]
    shares = [float(np.sum(x)) / n for x in chars] + [float((codes >= 128).sum()) / n, few[10] / n]
    raw = text.encode("utf-8", "surrogatepass")
    _, counts = np.unique(codes, return_counts=True)
    p = counts / n
    entropy, packed = float(-(p * np.log2(p)).sum()), len(zlib.compress(raw, 1)) / len(raw)
    words = raw.split()
    if not words:
        return [*shares, *[0.0] * 6, entropy, packed, 0.0, 0.0, 0.0]
    n_words, _, _, n_dup, n_repeat, n_distinct, _ = measure(text)
    size = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    capital = sum(65 <= w[0] <= 90 for w in words)
    of_words = [np.log1p(size.mean()), np.log1p(size.std()), n_distinct / n_words, again / n_words, n_repeat / n_words, n_dup / (few[10] + 1)]
    return [*shares, *map(float, of_words), entropy, packed, float(np.log1p(n_words)), float((size <= 2).mean()), capital / n_words]


def measured(col: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts_of(batches):
            yield pa.array([signals(t.as_py()) for t in part], type=pa.list_(pa.float64()))

    return run(col)


def widened(x: np.ndarray) -> np.ndarray:
    """Measures with their square roots beside them, which tell a little from none, and squares."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0)), x * x])


@dataclass(frozen=True)
class Ranking:
    """weights over widened measures, the cut among the scores that they give, and the spread that stands for one step of the logistic function."""

    weights: np.ndarray
    cut: float
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, THRESHOLD at the cut, in the order of the pairwise model."""
        steps = np.clip((widened(x) @ self.weights - self.cut) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)
        return 1 / (1 + np.exp(-steps))


def pairs_of(good: np.ndarray, bad: np.ndarray, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a preferred and a lesser document, all pairs if there are no more than `most`, else so many drawn, each document about as often as the others of its label."""
    if len(good) * len(bad) <= most:
        return np.repeat(good, len(bad)), np.tile(bad, len(good))
    rng = np.random.default_rng(SEED)
    deal = lambda own: np.concatenate([rng.permutation(own) for _ in range(-(-most // len(own)))])[:most]
    return deal(good), deal(bad)


def fit(x: np.ndarray, label: np.ndarray, penalty: float = 1e-3) -> Ranking:
    """Newton's method on the penalised logistic loss over differences of measures. Without documents of both labels every text gets THRESHOLD."""
    wide = widened(x) if len(x) else np.zeros((0, 3 * len(SIGNALS)))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(wide.shape[1]), 0.0, 1.0)
    scale = wide.std(axis=0)
    scale[scale < 1e-12] = np.inf  # a measure without spread weighs nothing
    better, lesser = pairs_of(good, bad)
    d = (wide[better] - wide[lesser]) / scale
    w = np.zeros(d.shape[1])
    loss = lambda w: np.logaddexp(0, -(d @ w)).mean() + penalty / 2 * w @ w
    now = loss(w)
    for _ in range(50):
        lost = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = penalty * w - d.T @ lost / len(d)
        curve = (d * (lost * (1 - lost))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        step, size = np.linalg.solve(curve, slope), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w, gain, now = w - size * step, now - then, then
        if gain < 1e-9:
            break
    w = w / scale
    s = wide @ w
    cut = best_cut(s, label)
    return Ranking(w, cut, float(max(s.std(), 1e-12)))


def best_cut(scores: np.ndarray, label: np.ndarray) -> float:
    """The quantile of the scores, in steps of a two-hundredth, at and above which label 1 and below which label 0 is right most often, both labels weighing the same; the lowest of equals."""
    cuts = np.quantile(scores, np.linspace(0, 1, 201))
    right = [(scores[label == 1] >= c).mean() + (scores[label == 0] < c).mean() for c in cuts]
    return float(cuts[int(np.argmax(right))])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label may not be learned from: crc32 of the id as text is divisible by FOLDS. A null id counts as empty text, crc32 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranking:
    """The ranking from the labelled documents outside the held-out fold.

    Takes max_labelled ids at most, those of least hash; ids without a label, or whose labels disagree, are left out, and so are labels but 0 and 1. Of an
    id's several texts the one of least hash is fitted, so reruns learn the same. The bound holds for what is broadcast and what reaches the driver: a few numbers an id.
    """
    rows = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q2")).where("quality = q2")
    place, known = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), labels.count()
    if known > 2 * max_labelled:  # leaves more than are taken, so that the sort is of a bounded number
        rows = rows.where(place < int(2 * (1 << 40) * max_labelled / known))
    rows = rows.orderBy(place, "doc_id").limit(max_labelled).select(F.col("doc_id").alias("label_id"), "quality")
    some = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("label_id"))
    some = some.select("doc_id", "quality", F.struct(F.xxhash64("text").alias("place"), measured(F.col("text")).alias("m")).alias("v"))
    got = some.groupBy("doc_id", "quality").agg(F.min("v")["m"].alias("m")).toPandas().sort_values("doc_id")
    return fit(np.array(got["m"].tolist(), dtype=np.float64).reshape(-1, len(SIGNALS)), got["quality"].to_numpy())


RESULTS = ["score", "predicted"]


def scored(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from THRESHOLD on); columns of those names are replaced.

    Null and empty texts have no measures and are scored like any other. Rows are scored one by one, so repeated rows get equal scores. No rows: no rows.
    """
    (s,) = fresh(docs, "own_score")

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts_of(batches):
            yield pa.array(ranking.scores(np.array([signals(t.as_py()) for t in part], dtype=np.float64).reshape(-1, len(SIGNALS))))

    out = docs.withColumn(s, run(F.col(text_col)))
    return out.select(*others(docs, RESULTS), F.col(s).alias("score"), (F.col(s) >= THRESHOLD).cast("int").alias("predicted"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = learn(docs, table(spark, sf_dir, "labels"))
    return scored(docs, ranking).select("doc_id", held_out().alias("held_out"), "score", "predicted")
