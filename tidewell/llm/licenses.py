"""License scans: Aho-Corasick over whole texts, and a shunting-yard parser for license expressions.

One automaton finds notice phrases over the words of a text; another finds identifier tags over the text itself. What follows a tag is parsed as an
expression of identifiers under and, or and with, and its value is the set of licenses that a reader must accept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, others, parts_of, table

#: The phrases that the contract fixes, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method's own, with the label and how open the license is, from 0 to 1.
NOTICES = {
    "mit license": ("mit", 1.0),
    "apache license": ("apache", 1.0),
    "bsd license": ("bsd", 1.0),
    "bsd 3 clause": ("bsd", 1.0),
    "bsd 2 clause": ("bsd", 1.0),
    "mozilla public license": ("mpl", 0.7),
    "lesser general public license": ("lgpl", 0.6),
    "affero general public license": ("agpl", 0.4),
    "cc by nc": ("cc-by-nc", 0.3),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nd": ("cc-by-nd", 0.3),
    "cc0 1 0": ("cc0", 1.0),
    "public domain": ("public-domain", 1.0),
    "creative commons attribution": ("cc-by", 0.9),
    "proprietary and confidential": ("reserved", 0.0),
}
OPEN = {"cc-by": 0.9, "gpl": 0.5, "reserved": 0.0} | {label: score for label, score in NOTICES.values()}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How the families of identifiers are labelled; the longest prefix wins.
FAMILIES = {
    "mit": "mit", "apache": "apache", "bsd": "bsd", "isc": "bsd", "mpl": "mpl", "lgpl": "lgpl", "agpl": "agpl", "gpl": "gpl", "cc0": "cc0",
    "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "unlicense": "public-domain", "licenseref": "reserved",
}
#: All bytes that separate words become blanks, A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
BINDS = {"or": 1, "and": 2, "with": 3}


def parse(text: str, at: int = 0, end: int | None = None) -> list[str] | None:
    """The longest license expression between those places of text, in postfix order; None if there is none. It ends with its line or at the first word that can't go on."""
    end = len(text) if end is None else end
    out: list[str] = []
    stack: list[str] = []
    best: tuple[int, list[str]] | None = None  # the length of out and what was stacked
    operand = True
    while (m := TOKEN.match(text, at, end)) is not None:
        word = m.group()
        low = word.lower()
        if operand and word == "(":
            stack.append("(")
        elif operand and word != ")" and low not in BINDS:
            out.append(low)
            operand = False
            if "(" not in stack:
                best = len(out), stack[::-1]
        elif not operand and low in BINDS:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif not operand and word == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
            if "(" not in stack:
                best = len(out), stack[::-1]
        else:
            break
        at = m.end()
        while at < end and text[at] in " \t":
            at += 1
    return best and out[: best[0]] + best[1]


def family(identifier: str) -> str:
    found = max((f for f in FAMILIES if identifier.startswith(f)), key=len, default=None)
    return FAMILIES[found] if found else "other"


def evaluate(postfix: list[str]) -> tuple[frozenset[str], float]:
    """(licenses, openness): `and` asks for both, `or` takes the more open side, `with` adds an exception to what stands before it."""
    stack: list[tuple[frozenset[str], float]] = []
    for word in postfix:
        if word not in BINDS:
            label = family(word)
            stack.append((frozenset([label]), OPEN.get(label, 0.2)))
            continue
        b, a = stack.pop(), stack.pop()
        if word == "and":
            stack.append((a[0] | b[0], min(a[1], b[1])))
        elif word == "or":
            stack.append(max(a, b, key=lambda s: (s[1], sorted(s[0]))))
        else:
            stack.append((a[0], min(1.0, a[1] + 0.1)))
    return stack[-1]


@lru_cache(maxsize=1)
def automata():
    import ahocorasick

    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES}:
        words.add_word(f" {phrase} ", phrase)
    for tag in TAGS:
        tags.add_word(tag, tag)
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one whole text.

    Null and empty texts have no words, labels or notices, and score 1: nothing restricts them. What follows a tag is read up to the next tag, so no place is read twice.
    """
    words, tags = automata()
    text = text or ""
    folded = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    line = " " + b" ".join(folded).decode("latin-1") + " "
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    score, counted, at = 1.0, 0, 0
    hits = sorted((end - len(p) - 1, p) for end, p in words.iter(line))
    for start, phrase in hits:
        counted += line.count(" ", at, start)
        at = start
        if phrase in BASE:
            places.append(counted)
            base.add(BASE[phrase])
            score = min(score, OPEN[BASE[phrase]])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase][0])
            score = min(score, NOTICES[phrase][1])
    if ":" in text:
        low = text.translate(UPPER)
        tagged = [(last - len(tag) + 1, last + 1) for last, tag in tags.iter(low)]
        for (_, at), (end, _) in zip(tagged, [*tagged[1:], (len(text), 0)]):
            while at < end and text[at] in " \t":
                at += 1
            if (postfix := parse(text, at, end)) is not None:
                found, openness = evaluate(postfix)
                labels |= found
                score = min(score, openness)
    labels |= base
    return len(folded), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


UPPER = {c: c + 32 for c in range(65, 91)}
FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def scans(col: Column) -> Column:
    @F.arrow_udf("struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts_of(batches):
            rows = [scan(t.as_py()) for t in part]
            cols = list(zip(*rows)) if rows else [()] * len(FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, FIELDS.values())], list(FIELDS))

    return run(col)


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with FIELDS; columns of those names are replaced. Texts are read whole, however long. Rows are scanned one by one, so repeated rows are alike; no rows: no rows.

    Places of different phrases may overlap and all count; of `or` sides that are equally open the one whose labels come last is taken.
    """
    (own,) = fresh(docs, "scan")
    return docs.withColumn(own, scans(F.col(text_col))).select(*others(docs, FIELDS), *[F.col(own)[name].alias(name) for name in FIELDS])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
