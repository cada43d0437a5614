import random
import time

import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from tidewell.llm import spm


@pytest.fixture(scope="module")
def model():
    with open(spm.MODEL, "rb") as f:
        return f.read()


def texts():
    rng = random.Random(3)
    letters = "aeiounrstlm  .,\nXZé日0😀"
    out = ["", " ", "  two  spaces ", "tab\tend\n", "a" * 3000, "日本語のテキスト", "the quick brown fox.", "x=1;\n    return y" + " " * 40]
    return out + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(300)]


def ids_of(encoder, rows):
    o, i, same = encoder.encode(rows)
    assert same.all()
    return [i[o[k] : o[k + 1]].tolist() for k in range(len(rows))]


def test_merging_model_gives_the_library_s_ids(model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = texts()
    assert ids_of(spm.Encoder(spm.Pieces(model)), rows) == [sp.encode(r) for r in rows]


def test_unigram_model_gives_the_library_s_ids(model):
    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # scores of equal-valued blanks would swamp the library's single precision
        p.score = max(p.score, -40000.0)
    raw = proto.SerializeToString()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    rows = [r for r in texts() if "  " not in r and len(r) < 100]
    got = ids_of(spm.Encoder(spm.Pieces(raw)), rows)
    score = lambda ids: sum(sp.get_score(i) for i in ids if not sp.is_byte(i))
    for r, own in zip(rows, got):
        assert own == sp.encode(r) or score(own) >= score(sp.encode(r))


def test_forgetting_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(spm, "CACHED", 20)
    rows = texts()
    small, large = spm.Encoder(spm.Pieces(model)), spm.Encoder(spm.Pieces(model))
    parts = [rows[k : k + 15] for k in range(0, len(rows), 15)]
    assert [x for p in parts for x in ids_of(small, p)] == ids_of(large, rows)


def test_words_that_nothing_cuts(model, monkeypatch):
    """Alone and in lots a long word gives the library's ids; a megabyte takes seconds."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(4)
    rows = ["a" * 9001, "".join(rng.choices("abcdefghilmnoprst", k=6000)), "日" * 5000 + "😀", "na" * 4000]
    assert ids_of(spm.Encoder(spm.Pieces(model)), rows) == [sp.encode(r) for r in rows]
    monkeypatch.setattr(spm, "ALONE", 1 << 30)
    assert ids_of(spm.Encoder(spm.Pieces(model)), [r[:700] for r in rows]) == [sp.encode(r[:700]) for r in rows]
    monkeypatch.undo()
    began = time.monotonic()
    assert ids_of(spm.Encoder(spm.Pieces(model)), ["a" * 1_000_000])
    assert time.monotonic() - began < 60


def test_columns_that_clash(odd, model):
    clash = odd.select("*", *[F.lit("mine").alias(c) for c in ("ids", "N_tokens", "round_trip", "encoded", "_e")])
    assert spm.encoded(clash, model).columns == [*odd.columns, "encoded", "_e", "ids", "n_tokens", "round_trip"]


def test_round_trip_of_odd_texts(spark, odd, empty, model):
    out = spm.encoded(odd.withColumn("ids", F.lit("clash")), model)
    rows = out.collect()
    assert len(rows) == 9 and all(r["round_trip"] for r in rows)
    back = out.select(F.coalesce("text", F.lit("")).alias("t"), spm.decode(F.col("ids"), model).alias("d")).collect()
    assert all(r["t"] == r["d"] for r in back)
    assert {r["n_tokens"] for r in rows if not r["text"]} == {0}
    assert spm.encoded(empty, model).count() == 0
