import random

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import quality


def slow(text):
    words = [w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\r\x0b\x0c\n"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), len(set(words)), sum("A" <= c <= "Z" for w in words for c in w)


def test_measures():
    rng = random.Random(1)
    texts = [None, "", "a", "a b c", "a b c a b c", "a a a a a", "x\x1cy\u00a0z\x85 w", "ß\n\n \nß\nß \r\nA#*<", *(" ".join(rng.choices("ab c dÉ # \n".split(" "), k=rng.randint(1, 80))) for _ in range(100))]
    assert [quality.measure(t) for t in texts] == [slow(t) for t in texts]


def test_upper_counts_ascii_only_for_long_texts_too():
    assert quality.measure("ÉA " * 2000)[6] == slow("ÉA " * 2000)[6] and quality.measure("ÉA")[6] == 1


def test_rules_separate_and_generalise():
    rng = np.random.default_rng(2)
    n = 3000
    x = {f: rng.random(n) for f in quality.FEATURES}
    bad = (x["symbol_ratio"] > 0.8) | ((x["upper_share"] > 0.7) & (x["dup_lines"] > 0.6))
    rules = quality.fit_rules(x, bad, np.arange(n))
    fresh = {f: rng.random(n) for f in quality.FEATURES}
    want = (fresh["symbol_ratio"] > 0.8) | ((fresh["upper_share"] > 0.7) & (fresh["dup_lines"] > 0.6))
    got = np.zeros(n, dtype=bool)
    for r in rules:
        got |= quality._holds(r, fresh)
    assert (got == want).mean() > 0.9 and (got & ~want).sum() < 0.1 * want.sum()
    assert quality.fit_rules(x, np.zeros(n, dtype=bool), np.arange(n)) == []


def test_learned_list_on_documents(spark, make):
    good = [(i, f"plain words number{i} " * 5 + " ".join(f"w{i}x{k}" for k in range(80))) for i in range(150)]
    junk = [(1000 + i, " ".join(f"#{i}*{k}%" for k in range(90))) for i in range(150)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk] + [(None, 1, 0), (1, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learn(make(good + junk), labels)
    assert rules
    out = {r["doc_id"]: r["kept"] for r in quality.judge(make(good + junk), rules).collect()}
    assert all(out[i] for i, _ in good) and not any(out[i] for i, _ in junk)


def test_repeated_ids_learn_alike(spark, make):
    rows = [(i % 80, f"plain words number{i} " * (5 if i % 2 else 1) + " ".join(f"{'#' if i % 80 < 40 else 'w'}{i}x{k}" for k in range(80))) for i in range(160)]
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(80)] * 2, "doc_id long, quality int, toxic int")
    learnt = [quality.learn(make(r), labels) for r in (rows, rows[::-1], rows + rows)]
    assert learnt[0] and learnt[0] == learnt[1] == learnt[2]


def test_odd_rows(spark, odd, empty):
    out = quality.judge(odd.withColumn("n_words", F.lit("clash")), [])
    rows = out.collect()
    assert len(rows) == 9 and all(r["base_failed"] and not r["kept"] for r in rows)
    assert out.columns == [*odd.columns, *quality.RESULTS]
    clash = odd.select("*", *[F.lit("mine").alias(c) for c in (*quality.RESULTS, "measures", "a.b")])
    assert quality.passing(clash, []).columns == clash.columns
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(empty, none) == [] and quality.judge(empty, []).count() == 0
