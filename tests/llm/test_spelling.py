"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    others = {w: [v for v in n if near(v, w)] for w in n}
    best = {w: min(o, key=lambda v: (-n[v], v)) for w, o in others.items() if o}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(others[w]), n.get(form.get(w))) for w in n}


def result(df):
    rows = df.select(*COLUMNS).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r[c] for c in COLUMNS[1:]) for r in rows}


@pytest.fixture(scope="module")
def crowded():
    """Words of few letters, so that nearly all have near ones, at very different counts; chains of forms; slips planted by the contract."""
    rng = random.Random(5)
    base = ["".join(rng.choices("abé", k=rng.randint(6, 9))) for _ in range(150)] + ["harbour", "harbours", "harbor", "aaaaaaa", "aaaaaaaa", "×÷ÿÀabcd"]
    text = [w for w in base for _ in range(rng.choice([1, 2, 2, 3, 20, 30, 250]))] + ["Abababab"] * 2500 + ["abababaa"] * 240 + ["abababba"] * 22 + ["abababbb"] * 2
    rng.shuffle(text)
    return [(i, " ".join(text[at : at + 50])) for i, at in enumerate(range(0, len(text), 50))]


def test_against_all_pairs(make, crowded):
    want = plain(crowded)
    assert result(spelling.variants(make(crowded))) == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] and v[0] != v[1] for v in want.values())


def test_chains_of_forms_have_one_root(spark):
    forms = spark.createDataFrame([(k, k - 1) for k in range(1, 9)] + [(20, 3)], "id long, form long")
    assert {r["id"]: r["root"] for r in spelling.roots(forms, 8).collect()} == {k: 0 for k in [*range(1, 9), 20]}


def test_long_words_by_fixed_size_keys(make, monkeypatch):
    rng = random.Random(6)
    long = ["".join(rng.choices("abc", k=k)) for k in (30, 31, 40, 41, 200)] + ["a" * 30, "a" * 31, "a" * 32]
    long += [w[:7] + "z" + w[8:] for w in long] + [w[:7] + w[8:] for w in long] + [w[:20] + "q" + w[20:] for w in long]
    docs = [(i, " ".join(long * (1 + 25 * (i == 3)))) for i in range(4)] + [(9, "shorter shorter shorten shorten")]
    want = plain(docs)
    monkeypatch.setattr(spelling, "LONG", 31)
    monkeypatch.setattr(spelling._long_keys, "__defaults__", (31,))
    assert result(spelling.variants(make(docs))) == want and len(want) > 20


def test_a_very_long_word(make):
    word = "ab" * 30_000
    docs = [(1, f"{word} {word}"), (2, word + "c"), (3, word + "c"), (4, f"x {word[:-2]}cb")]
    got = result(spelling.variants(make(docs)))
    assert got[word][3] >= 1


def test_odd_rows(odd, empty, make):
    assert result(spelling.variants(empty)) == {}
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(spelling.variants(odd)) == plain(rows)
    clash = make([(1, "lantern lantern lanterns lanterns", "s", "x", 3)], ", word string, n long")
    assert result(spelling.variants(clash)) == plain([(1, "lantern lantern lanterns lanterns")])


def test_deletions_are_not_broadcast(spark):
    """Deletions are several times as many as words, and Spark sizes them like the words."""
    vocab = spark.range(2_000).select("id", F.concat(F.lit("word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("end")).alias("word"), F.lit(3).alias("n"))
    found = spelling.nearby(vocab)
    assert found.count()
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
