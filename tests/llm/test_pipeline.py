
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidewell.llm import spm
from tidewell.llm.common import saved


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with documents whose fate is known."""
    folder = tmp_path_factory.mktemp("tables")
    clean = [(i, " ".join(f"w{i}x{k}" for k in range(120)) + (f" mail me{i}@mail.example.com" if i % 10 == 0 else ""), "en", f"s{i % 4}", 0) for i in range(200)]
    near = [(500 + i, clean[i][1].replace(f"w{i}x60", "other"), "en", "s0", 0) for i in range(20)]
    exact = [(600 + i, clean[i][1], "en", "s1", 0) for i in range(20)]
    junk = [(700 + i, " ".join(f"#{i}*{k}%" for k in range(90)), "en", "s2", 0) for i in range(60)] + [(900, None, None, None, None), (901, "", "en", "s3", 0)]
    spark.createDataFrame(clean + near + exact + junk, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, 0) for i in range(0, 200, 2)] + [(700 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, small))
        kept.append({r["doc_id"] for r in docs.collect()})
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept[0] == {*range(200), *range(500, 520), *range(600, 620)}
    assert kept[1] == kept[2] == set(range(200)) and kept[3] == kept[4] <= kept[2]
    assert docs.where(F.contains("text", F.lit("@mail"))).count() == 0 and docs.where("not round_trip").count() == 0


def test_run_matches_brute_force(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r["doc_id"] < 200}
    text = {i: r["text"].replace(f"me{i}@mail.example.com", "[EMAIL]") for i, r in docs.items()}
    sp = spm.Encoder(spm.Pieces(spm.read_model(spark)))
    ids = lambda t: sp.encode([t])[1].tolist()
    assert all(r["text"] == text[r["doc_id"]] and r["ids"] == ids(r["text"]) and r["n_chars"] == len(r["text"]) for r in rows)
    total = sum(len(t.split()) for t in text.values())
    assert abs(sum(len(r["text"].split()) for r in rows) - 1.5 * total) <= 4 * 122


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


