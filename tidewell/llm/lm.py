"""Language-model scores: the marginal probability of a text over all its segmentations into subword pieces.

The weights start from the scores of an existing vocabulary and are re-estimated on the training documents by expectation-
maximisation over their distinct words. A forward recursion in log space sums over all segmentations; pieces do not cross words, so a
text's probability is the product of its words' and of one end. Beside it stands an add-one word unigram score.

Counts are taken over all training documents. The HEAVY most frequent words travel to all tasks, a bounded table; all other
words meet their counts in a join, so nothing that grows with the vocabulary is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .spm import LONG, MODEL, Pieces, by_length, pieces_of, read_model

#: Most frequent words that are broadcast at most, their greatest length, and the words that a worker counts before it hands them on.
HEAVY, HEAVY_CHARS, FLUSH = 100_000, 64, 250_000
ROUNDS, PRIOR = 1, 10_000.0
KEPT = 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def prior_of(pieces: Pieces) -> np.ndarray:
    """Probabilities of the pieces and, last, of the end, from the vocabulary's scores alone.

    Unigram scores are log probabilities. Scores of a BPE model are ranks, taken as Zipf's: 1 / (rank + 2). Bytes get the least weight.
    """
    out = np.zeros(len(pieces.scores) + 1)
    if pieces.merging:
        out[pieces.normal] = 1.0 / (2.0 + np.minimum(-pieces.scores[pieces.normal], 1e6))
    else:
        out[pieces.normal] = np.exp(pieces.scores[pieces.normal])
    least = out[pieces.normal].min()
    out[pieces.byte_id[pieces.byte_id >= 0]] = least
    out[-1] = least
    return out / out.sum()


class Lattice:
    """Sums over the segmentations of words, in lots of equal length."""

    def __init__(self, pieces: Pieces, probability: np.ndarray) -> None:
        self.pieces = pieces
        with np.errstate(divide="ignore"):
            self.log = np.log(probability)
        self.known: dict[bytes, float] = {}

    def _steps(self, words: list[str]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        found = self.pieces.probe(self.pieces.codes(words))
        n, size = len(words), len(words[0])
        log = {k: np.where(ids >= 0, self.log[ids], -np.inf) for k, ids in found.items()}
        if 1 not in log:
            found[1], log[1] = np.full((n, size), -1, dtype=np.int32), np.full((n, size), -np.inf)
        for r, c in zip(*np.nonzero(found[1] < 0)):
            log[1][r, c] = self.log[self.pieces.byte_id[list(words[r][c].encode("utf-8", "surrogatepass"))]].sum()
        return found, log

    @staticmethod
    def _forward(log: dict[int, np.ndarray], n: int, size: int) -> np.ndarray:
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, size + 1):
            own = alpha[:, j]
            for k, lp in log.items():
                if k <= j:
                    np.logaddexp(own, alpha[:, j - k] + lp[:, j - k], out=own)
        return alpha

    def parts(self, word: bytes) -> list[str]:
        """A word led by a blank, cut where no piece crosses if it is long."""
        unit = " " + word.decode("utf-8", "surrogatepass")
        return [unit] if len(unit) <= LONG else list(self.pieces._cut(unit))

    def log_prob(self, words: list[bytes]) -> list[float]:
        """Natural logarithms of the words' probabilities."""
        if len(self.known) > KEPT:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        cut = [self.parts(w) for w in new]
        flat = [p for c in cut for p in c]
        got = np.zeros(len(flat))
        for lot in by_length(flat):
            own = [flat[k] for k in lot]
            got[lot] = self._forward(self._steps(own)[1], len(own), len(own[0]))[:, -1]
        at = 0
        for w, c in zip(new, cut):
            self.known[w] = float(got[at : at + len(c)].sum())
            at += len(c)
        return [self.known[w] for w in words]

    def expected(self, words: list[bytes], counts: list[int]) -> np.ndarray:
        """Expected numbers of uses of each piece in so many words."""
        out = np.zeros(len(self.log))
        flat = [(p, n) for w, n in zip(words, counts) for p in self.parts(w)]
        for lot in by_length([p for p, _ in flat]):
            own = [flat[k][0] for k in lot]
            weight = np.array([flat[k][1] for k in lot], dtype=float)
            n, size = len(own), len(own[0])
            found, log = self._steps(own)
            alpha = self._forward(log, n, size)
            beta = self._forward({k: lp[:, ::-1] for k, lp in log.items()}, n, size)[:, ::-1]
            for k, lp in log.items():
                share = np.exp(alpha[:, : size - k + 1] + lp + beta[:, k:] - alpha[:, -1:]) * weight[:, None]
                real = found[k] >= 0
                out += np.bincount(found[k][real], weights=share[real], minlength=len(out))
                if k == 1:
                    for r, c in zip(*np.nonzero(~real)):
                        np.add.at(out, self.pieces.byte_id[list(own[r][c].encode("utf-8", "surrogatepass"))], share[r, c])
        return out


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over the column text, A-Z lower-cased. Workers count ahead of the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["word", "c"])

        for batch in batches:
            for value in batch.column(0):
                seen.update(words_of(value.as_py()))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame) -> dict[bytes, int]:
    """The most frequent words with their counts, HEAVY of them at most: all from a step of counts on.

    A histogram of the counts' magnitudes, a few hundred rows, tells the step first, so that no more than the words themselves reach the driver.
    """
    step = F.floor(F.log2("c") * 8)
    short = counts.where(F.length("word") <= HEAVY_CHARS)
    least, total = None, 0
    for row in sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += row["count"]
        if total > HEAVY:
            break
        least = row["step"]
    top = short.where(step >= least).collect() if least is not None else []
    return {r["word"].encode("utf-8", "surrogatepass"): r["c"] for r in top}


def reestimate(counts: DataFrame, ends: int, model: bytes, probability: np.ndarray) -> np.ndarray:
    """One round of expectation-maximisation over the distinct training words. The driver gets a number for each piece at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(pieces_of(model), probability), np.zeros(len(probability))
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000).to_pydict()
                total += lattice.expected([w.encode("utf-8", "surrogatepass") for w in part["word"]], part["c"])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "uses"])

    got = counts.select("word", "c").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).orderBy("piece").toPandas()
    out = PRIOR * probability
    out[got["piece"].to_numpy(dtype=np.int64)] += got["uses"].to_numpy()
    out[-1] += ends
    return out / out.sum()


def lattice_col(word: Column, model: bytes, probability: np.ndarray) -> Column:
    """The natural logarithm of a word's marginal probability."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice = Lattice(pieces_of(model), probability)
        for batch in batches:
            yield pa.array(lattice.log_prob([(w or "").encode("utf-8", "surrogatepass") for w in batch.to_pylist()]), pa.float64())

    return run(word)


def _by_heavy(text: Column, heavy: dict[bytes, int], model: bytes, probability: np.ndarray) -> Column:
    """What the frequent words alone tell of a text, and the other words with their numbers."""
    kind = "struct<n: long, known: long, logs: double, lattice: double, rare: array<struct<word: string, n: long>>>"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice = Lattice(pieces_of(model), probability)
        common = list(heavy)
        logs = dict(zip(common, zip([math.log10(heavy[w] + 1) for w in common], lattice.log_prob(common))))
        lattice.known.clear()
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            rare_words, rare_counts, offsets = [], [], [0]
            for value in batch:
                words = words_of(value.as_py())
                count = Counter(words)
                known, a, b = 0, 0.0, 0.0
                for w, n in count.items():
                    if (got := logs.get(w)) is None:
                        rare_words.append(w.decode("utf-8", "surrogatepass"))
                        rare_counts.append(n)
                    else:
                        known += n
                        a += n * got[0]
                        b += n * got[1]
                offsets.append(len(rare_words))
                for col, x in zip(cols, (len(words), known, a, b)):
                    col.append(x)
            rare = pa.StructArray.from_arrays([pa.array(rare_words, pa.string()), pa.array(rare_counts, pa.int64())], ["word", "n"])
            yield pa.StructArray.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare)],
                ["n", "known", "logs", "lattice", "rare"],
            )

    return run(text)


def scored(docs: DataFrame, model: bytes, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, vocabulary, base_score, score) for each row of docs, trained on those not held out.

    Null and empty texts consist of one end. Without training rows every count is 0, N and V are 0, and the pieces keep the vocabulary's weights.
    Rows with equal ids, and equal rows, each keep a row and each count in training. Texts and words of any length are scored whole, in time that grows with their length.
    Other columns of docs play no part. No rows: no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = saved(count_words(own.where("not held_out")))
    ends = own.where("not held_out").count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    train_tokens, vocabulary = total + ends, distinct + (ends > 0)
    pieces = pieces_of(model)
    probability = prior_of(pieces)
    for _ in range(rounds):
        probability = reestimate(counts, ends, model, probability)
    heavy = frequent(counts)

    seen = saved(own.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", _by_heavy(F.col("text"), heavy, model, probability).alias("m")).select("row", "id", "held_out", "m.*"))
    rare = seen.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("w"), F.col("r.n").alias("k"))
    rare = rare.join(counts, rare["w"] == counts["word"], "left").select("row", "k", "c", lattice_col(F.col("w"), model, probability).alias("lp"))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("rare_known"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_logs"), F.sum(F.col("k") * F.col("lp")).alias("rare_lattice")
    )
    out = seen.join(rare.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n_tokens = F.col("n") + 1
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("known") + zero("rare_known") + int(ends > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        F.lit(vocabulary).cast("long").alias("vocabulary"),
        (F.col("logs") + zero("rare_logs") + math.log10(ends + 1) - n_tokens * math.log10(train_tokens + vocabulary + 1)).alias("base_score"),
        ((F.col("lattice") + zero("rare_lattice") + float(np.log(probability[-1]))) / math.log(10)).alias("score"),
    )


def op6(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, read_model(spark, model_path), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
