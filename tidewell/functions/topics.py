"""Keywords of topics, as patterns; matches and scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import AMBIGUOUS_KEYWORDS, TOPIC_KEYWORDS

#: Borders of ASCII words; \b would take accented letters into words.
WORD_START, WORD_END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def keyword_pattern(keyword: str) -> str:
    """Short and ambiguous keywords match as words, others anywhere; case doesn't matter."""
    k = keyword.strip()
    whole = (len(k) <= 3 or k.lower() in AMBIGUOUS_KEYWORDS) and re.fullmatch(r"[A-Za-z0-9]+", k)
    return f"(?i){WORD_START}{k}{WORD_END}" if whole else "(?i)" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", k)


def patterns(topic: str, topics: dict[str, list[str]] | None = None) -> list[str]:
    """A topic that isn't known stands for itself."""
    return [keyword_pattern(k) for k in (topics or TOPIC_KEYWORDS).get(topic, [topic.lower()])]


def keyword_score(text: Column, topic: str) -> Column:
    """The number of different keywords of a topic that a text has."""
    out = F.lit(0)
    for p in patterns(topic):
        out = out + F.regexp_like(F.coalesce(text, F.lit("")), F.lit(p)).cast("int")
    return out


def matches(text: Column, topic: str) -> Column:
    return keyword_score(text, topic) > 0
