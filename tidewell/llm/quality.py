"""Quality rules: whole-text measures, and a decision list learned by sequential covering.

The list is a sequence of conjunctions of thresholds, each meaning "reject". It is grown and pruned on the measures of
labelled documents and becomes one Spark conditional expression.

A text is measured whole, however long, in time that grows with its words. Rows are judged one by one, so repeated rows and ids are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, others, parts_of, table

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper"]
#: What conditions may test; every one is a ratio or a count, from a struct of MEASURES.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "word_len": lambda m: m["word_chars"] / F.greatest(m["n_words"], F.lit(1)),
    "symbol_ratio": lambda m: m["n_symbols"] / F.greatest(m["word_chars"], F.lit(1)),
    "repeat_share": lambda m: m["n_repeat_words"] / F.greatest(m["n_words"], F.lit(1)),
    "distinct_share": lambda m: m["n_distinct"] / F.greatest(m["n_words"], F.lit(1)),
    "upper_share": lambda m: m["n_upper"] / F.greatest(m["word_chars"], F.lit(1)),
    "dup_lines": lambda m: m["n_dup_lines"].cast("double"),
    "n_words": lambda m: m["n_words"].cast("double"),
}
#: A bounded sample of labelled rows, by hash of the id, is enough to fit a list of a few thresholds.
MAX_LABELLED = 20_000


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one whole text; all 0 for null or empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0)
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    repeated = 0
    if n >= 4:
        _, pair = np.unique(codes[:-1] * len(seen) + codes[1:], return_inverse=True)
        windows = pair[: n - 2].astype(np.int64) * len(seen) + codes[2:]
        _, at, count = np.unique(windows, return_inverse=True, return_counts=True)
        often = count[at] > 1
        hit = np.zeros(n, dtype=bool)
        for shift in range(3):
            hit[shift : n - 2 + shift] |= often
        repeated = int(hit.sum())
    lines: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in lines
            lines.add(line)
    word_chars = len(text) - sum(map(text.count, SPACES))
    return (n, word_chars, sum(map(text.count, SYMBOLS)), dup, repeated, len(seen), _upper(text))


def _upper(text: str) -> int:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return int(((codes >= 65) & (codes <= 90)).sum())


def measures(col: Column) -> Column:
    kind = "struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts_of(batches):
            rows = np.array([measure(t.as_py()) for t in part], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], MEASURES)

    return run(col)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, m: Column) -> Column:
        value = FEATURES[self.feature](m)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, conditions: int) -> Rule:
    """Adds the condition of most information gain, again and again."""
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    for _ in range(conditions):
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (0.0, None)
        for f in FEATURES:
            for t in np.unique(np.quantile(x[f][inside & bad], np.linspace(0, 1, 21))):
                for above in (True, False):
                    c = Condition(f, above, float(np.nextafter(t, -np.inf)) if above else float(t))
                    h = c.holds(x) & inside
                    hp, hn = int(bad[h].sum()), int((~bad[h]).sum())
                    if hp and (gain := hp * (np.log2(hp / (hp + hn)) - base)) > best[0] + 1e-9:
                        best = (gain, c)
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def fit_rules(x: dict[str, np.ndarray], bad: np.ndarray, ids: np.ndarray, precision: float = 0.9, most: int = 8, conditions: int = 3) -> list[Rule]:
    """Sequential covering: grow on two thirds of the rows, prune on the others, keep a rule that is precise on both, remove what it covers.

    No rows, or none of either class: an empty list, which rejects nothing.
    """
    part = ids % 3 == 0
    left = np.ones(len(bad), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < most:
        grow, prune = left & ~part, left & part
        if not bad[grow].any() or not bad[prune].any():
            break
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow], conditions)
        xp, bp = {f: v[prune] for f, v in x.items()}, bad[prune]

        def worth(r: Rule, xp=xp, bp=bp) -> float:
            h = _holds(r, xp)
            return (bp[h].sum() - (~bp[h]).sum()) / max(1, h.sum()) if r else -1.0

        while len(rule) > 1 and (shorter := max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=worth)) and worth(shorter) >= worth(rule):
            rule = shorter
        h = _holds(rule, x) & left
        hp = h & prune
        if not rule or h.sum() < 10 or bad[h].mean() < precision or not hp.any() or bad[hp].mean() < precision:
            break
        rules.append(rule)
        left &= ~h
    return rules


def rejected_by(rules: list[Rule], m: Column) -> Column:
    """An ordered conditional expression over a struct of measures: the number of the first rule that holds, else null."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        held = F.lit(True)
        for c in rule:
            held = held & c.column(m)
        out = F.when(held, number).otherwise(out)
    return out


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The decision list from labelled documents.

    Takes max_labelled labelled ids at most, those of least hash; ids without a label, or whose labels disagree, are left out. Rows of the same id and
    measures count once, and of an id's several texts the one of least hash is fitted, so reruns learn the same rules. Without labels: no rules.
    That bound holds for what is broadcast and for what reaches the driver: a few numbers an id.
    """
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q2"))
    place, known = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), labels.count()
    if known > 2 * max_labelled:  # leaves about 1.5 times as many, so that the sort is of a bounded number
        rows = rows.where(place < int(1.5 * (1 << 40) * max_labelled / known))
    rows = rows.where("quality = q2").orderBy(place, "doc_id").limit(max_labelled).select(F.col("doc_id").alias("label_id"), "quality")
    some = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("label_id"))
    some = some.select("doc_id", "quality", F.xxhash64("text").alias("place"), measures(F.col("text")).alias("m"))
    values = F.struct("place", *[f(F.col("m")).alias(f"f_{k}") for k, f in FEATURES.items()])
    got = some.groupBy("doc_id", "quality").agg(F.min(values).alias("v")).select("doc_id", "quality", "v.*").toPandas().sort_values("doc_id")
    return fit_rules({k: got[f"f_{k}"].to_numpy(dtype=float) for k in FEATURES}, got["quality"].to_numpy() == 0, got["doc_id"].to_numpy())


RESULTS = [*MEASURES, "base_failed", "rule", "kept"]


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with MEASURES, base_failed, rule (number of the rule that rejects, or null) and kept; columns of those names are replaced.

    Null and empty texts have no words, so they fail the base test. No rows: no rows.
    """
    (m,) = fresh(docs, "measures")
    out, own = docs.withColumn(m, measures(F.col(text_col))), F.col(m)
    rule = rejected_by(rules, own)
    return out.select(*others(docs, RESULTS), *[own[k].alias(k) for k in MEASURES], base_failed(own).alias("base_failed"), rule.alias("rule"), (~base_failed(own) & rule.isNull()).alias("kept"))


def passing(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of docs that neither the base test nor a rule rejects, with docs' own columns, whatever their names."""
    (m,) = fresh(docs, "measures")
    out = docs.withColumn(m, measures(F.col(text_col)))
    return out.where(~base_failed(F.col(m)) & rejected_by(rules, F.col(m)).isNull()).drop(m)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
