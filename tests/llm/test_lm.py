import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import lm, spm


@pytest.fixture(scope="module")
def model():
    with open(spm.MODEL, "rb") as f:
        return f.read()


def tokens(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()


def base(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, t in rows if not held[i] for w in [*tokens(t), None])
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(tokens(t)) + 1, sum(count[w] > 0 for w in [*tokens(t), None]), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*tokens(t), None])) for i, t in rows}


def texts():
    return [(i, " ".join(f"Word{(i * k) % 23} x{k}" for k in range(i % 40))) for i in range(60)] + [(100, None), (101, ""), (102, "日本 😀 ▁ " + "y" * 200), (103, "THE the The"), (104, "z" * 70 + " " + "z" * 70)]


def scored(docs, model):
    return lm.scored(docs, model, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


@pytest.mark.parametrize("heavy", [0, 5, 100_000])
def test_base_scores(make, model, monkeypatch, heavy):
    monkeypatch.setattr(lm, "HEAVY", heavy)
    rows = texts()
    want = base(rows)
    got = scored(make(rows), model).collect()
    assert len(got) == len(rows)
    for r in got:
        h, n, known, train, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, train)
        assert r["base_score"] == pytest.approx(score, rel=1e-9) and r["score"] < 0


def splits(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in splits(word[k:], pieces):
                yield [pieces[word[:k]], *rest]


def test_lattice_sums_over_all_segmentations(model):
    own = spm.Pieces(model)
    lattice = lm.Lattice(own, lm.prior_of(own))
    spelled = {b.decode(): i for i, b in enumerate(own.bytes) if i in set(own.normal.tolist())}
    for word in (b"a", b"the", b"theatre", b"xqzzk", "éa".encode()):
        want = sum(math.exp(sum(lattice.log[i] for i in s)) for s in splits(" " + word.decode(), spelled))
        assert lattice.log_prob([word])[0] == pytest.approx(math.log(want), rel=1e-9)


def test_expected_uses_add_up(model):
    own = spm.Pieces(model)
    lattice = lm.Lattice(own, lm.prior_of(own))
    uses = lattice.expected([b"the", b"cat"], [3, 5])
    chars = sum(uses[i] * len(own.bytes[i].decode()) for i in np.flatnonzero(uses) if own.bytes[i])
    assert chars == pytest.approx(3 * 4 + 5 * 4, rel=1e-9)


def test_learning_helps_on_held_out_text(make, model):
    rows = [(i, " ".join(f"zorple{k % 5} quandary{(i + k) % 7}" for k in range(30))) for i in range(80)]
    total = lambda rounds: sum(r["score"] for r in lm.scored(make(rows), model, F.col("doc_id") % 5 == 0, rounds=rounds).where("held_out").collect())
    assert total(1) > total(0)


def test_odd_rows(odd, empty, model):
    got = scored(odd, model).collect()
    assert len(got) == 9 and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (1, 2, 3))
    assert scored(empty, model).count() == 0
    none = lm.scored(odd, model, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in none)
