"""The queries opN_<name> and pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, licenses, lm, mixing, neighbours, pii, preference, quality, simhash, spelling, spm, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": spm.op1,
    "op2_chat": chat.op2,
    "op4_licenses": licenses.op4,
    "op3_mixing": mixing.op3,
    "op5_pii": pii.op5,
    "op6_lm_scores": lm.op6,
    "op7_neighbours": neighbours.op7,
    "op8_quality_rules": quality.op8,
    "op9_urls": urls.op9,
    "op10_simhash": simhash.op10,
    "op11_whitening": whitening.op11,
    "op12_spelling": spelling.op12,
    "op13_preference": preference.op13,
}
ORACLES: dict[str, str] = {"op2_chat": chat.ORACLE}
