"""Spelling variant grouping without pairs.

Two words are near if one inserted, deleted or replaced character parts them. Words that differ by a replacement share a wildcard group: their position, what
stands before it and what behind it. A group holds a word for each letter at most; its size and its two best words tell every member how many near words it
has there and which is best. For insertions each word's deletions meet the vocabulary, so each word gives rows by its length, whatever its company. Words are
numbered best first, so the best of some is the smallest number.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, saved, table

#: Lower-cased letters, the only ones that words are made of.
LETTERS = "[a-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 7, 2, 10, 31
#: Longer words take fixed-size keys, so that their rows don't grow with the square of their length.
LONG = 256
PRIME = (1 << 127) - 1


def runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST_LENGTH) -> DataFrame:
    """(word): the lower-cased runs of letters of all texts, of `least` letters at least, with the slips that the contract plants: where SLIP divides the crc32 of `id:run`, the character at that crc32's remainder is left out.

    A null text has no runs; a null id counts as empty text.
    """
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("own"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("own", F.lit(":"), "run"))
    slip = F.overlay("run", F.lit(""), (h % F.length("run") + 1).cast("int"), F.lit(1))
    return run.select(F.when(h % SLIP == 0, slip).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(id, word, n) of the words of enough letters and occurrences, numbered by falling n, then by code points. Saved, so that the numbers hold."""
    counts = words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)
    return saved(counts.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def _long_keys(base: int, longest: int = LONG):
    """Keys of long words from the values of a polynomial modulo PRIME, in steps that grow with a word's length. Two different words share one by chance less often than once in 10^30 pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, word in zip(pdf["id"], pdf["word"]):
                codes, size = [ord(c) for c in word], len(word)
                power, head = [1], [0]
                for c in codes:
                    power.append(power[-1] * base % PRIME)
                    head.append((head[-1] * base + c) % PRIME)
                whole, rows = head[-1], [("own", f"{size}:{head[-1]:x}")]
                for i, c in enumerate(codes):
                    rest = power[size - i - 1]
                    rows.append(("wild", f"{i}/{size}:{(whole - c * rest) % PRIME:x}"))
                    if i + 1 == size or codes[i + 1] != c:
                        tail = (whole - head[i + 1] * rest) % PRIME
                        rows.append(("less", f"{size - 1}:{(head[i] * rest + tail) % PRIME:x}" if size - 1 > longest else word[:i] + word[i + 1 :]))
                    if len(rows) >= 50_000:
                        yield pd.DataFrame([(number, *r) for r in rows], columns=["id", "kind", "key"])
                        rows = []
                yield pd.DataFrame([(number, *r) for r in rows], columns=["id", "kind", "key"])

    return run


def keys(vocab: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, key) thrice: a word's wildcard groups, its different deletions, and itself. Of a run of one letter only the last is deleted, as all give the same."""
    short, at = vocab.where(F.length("word") <= LONG), F.col("at")
    places = short.select("id", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    wild = places.select("id", F.overlay("word", F.lit("*"), at, F.lit(1)).alias("key"))
    last = F.substr("word", at, F.lit(1)) != F.substr("word", at + 1, F.lit(1))
    less = places.where(last).select("id", F.overlay("word", F.lit(""), at, F.lit(1)).alias("key"))
    own = short.select("id", F.col("word").alias("key"))
    long = vocab.where(F.length("word") > LONG)
    if long.isEmpty():
        return wild, less, own
    more = saved(long.select("id", "word").mapInPandas(_long_keys(secrets.randbits(126)), "id long, kind string, key string"))
    of = lambda kind: more.where(F.col("kind") == kind).select("id", "key")
    return wild.unionByName(of("wild")), less.unionByName(of("less")), own.unionByName(of("own"))


def nearby(vocab: DataFrame) -> DataFrame:
    """(id, n_near, best): of each word that has near ones, their number and the best one's id.

    Deletions are several times as many as words, which Spark doesn't count when it sizes them, so the hint keeps their join a merge.
    """
    wild, less, own = keys(vocab)
    group = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # as many rows as letters at most
    grouped = wild.select("id", F.count("*").over(group).alias("size"), F.first("id").over(group).alias("first"), F.nth_value("id", 2).over(group).alias("second")).where("size > 1")
    replaced = grouped.select("id", (F.col("size") - 1).alias("near"), F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))
    links = less.select(F.col("id").alias("longer"), "key").join(own.select(F.col("id").alias("shorter"), "key").hint("merge"), "key").select("longer", "shorter")
    ends = F.explode(F.array(F.struct(F.col("longer").alias("id"), F.col("shorter").alias("best")), F.struct(F.col("shorter").alias("id"), F.col("longer").alias("best")))).alias("e")
    parted = links.select(ends).select("e.id", F.lit(1).cast("long").alias("near"), "e.best")
    return replaced.unionByName(parted).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(id, root) from (id, form): the end of each chain of forms, of so many steps at most. A chain's reach doubles in every round."""
    reach, out = 1, forms.select("id", F.col("form").alias("root"))
    while reach < steps:
        on = out.select(F.col("id").alias("root"), F.col("root").alias("next"))
        out = saved(out.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root")))
        reach *= 2
    return out


def variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its near words, the most frequent of them (ties: first by code points) if that is `ratio` times as frequent, and the last form of the chain.

    Counts and groups cover all texts, however long. Every step grows n tenfold at least, which bounds the length of a chain. Repeated rows count each. No words: no rows.
    """
    vocab = vocabulary(runs(docs, text_col, id_col))
    near = nearby(vocab)
    best = vocab.select(F.col("id").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    told = vocab.join(near, "id", "left").join(best, "best", "left")
    is_form = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    told = saved(told.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(is_form, F.col(b)).alias(f) for b, f in (("best", "form_id"), ("best_word", "form"), ("best_n", "form_n"))]))
    most = told.agg(F.max("n")).first()[0] or 1
    steps = 0
    while most >= ratio**(steps + 1):
        steps += 1
    ends = roots(told.where("form_id is not null").select("id", F.col("form_id").alias("form")), steps)
    ends = ends.join(vocab.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return told.join(ends, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
