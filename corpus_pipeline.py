"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Quality rules reject documents, SimHash keeps one of each group of copies, personal data is masked, the mix takes documents of each source up to its
target, once or twice, and SentencePiece encodes what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import mixing, pii, quality, simhash, spm
from tidewell.llm.common import saved, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rules nor the learned list rejects."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.passing(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies, by five-word shingles and a similarity of 0.8."""
    return simhash.near_dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked; n_chars follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all, once or twice, in the order of the schedule."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids; columns that bear the results' names give way."""
    return spm.encoded(docs, spm.read_model(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The learned rules, near-duplicate groups and SentencePiece have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shared_dir(spark)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
