"""The key-value table through folds and clears: what is read before, meanwhile and after."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidewell.sources.scratch import put_once
from tidewell.sources.store import KeyValue

DAY = "2024-01-01 "


def t(s):
    return F.lit(DAY + s).cast("timestamp")


@pytest.fixture
def kv(spark, tmp_path):
    store = KeyValue(spark, f"{tmp_path}/kv", ["new:", "old:"])
    other = KeyValue(spark, f"{tmp_path}/kv", ["old:"])
    put = lambda s, rows, ttl, at, seq=0: s.put(spark.createDataFrame(rows, "key string, value string"), ttl, t(at), seq)
    put(other, [("a", "1"), ("b", "2"), ("xb", "3")], 36_000, "00:00:00")
    put(store, [("a", "4"), ("c", "")], 36_000, "00:00:00", 1)
    put(store, [("c", "5")], 60, "00:01:00")
    put(store, [("d", None)], 36_000, "00:01:00")
    return store


def read(store, at="00:05:00"):
    return {r["key"]: r["value"] for r in store.get(t(at)).collect()}


def test_an_empty_store(spark, tmp_path):
    empty = KeyValue(spark, f"{tmp_path}/none", ["x:"])
    assert read(empty) == {} and empty.generation() == 0 and empty.clear_all() == 0
    assert empty.fold(t("00:00:00")) and read(empty) == {}


def test_reads_agree_through_folds(kv):
    want = {"a": "4", "b": "2", "xb": "3", "d": None}
    assert read(kv) == want
    before = kv.log()
    assert kv.fold(t("00:05:00")) and read(kv) == want
    assert {r["key"] for r in before.collect()} == {"a", "b", "c", "d", "xb"}  # planned before the fold, run after it
    assert kv.fold(t("00:05:00")) and read(kv) == want and kv.generation() == 2
    assert len(kv._names("bases")) == 2 and not kv._names("batches") and not kv._names("marks")
    assert kv.log().count() == 6  # one row a namespace and key; what expired within the grace stays, as it hides earlier writes
    assert kv.fold(t("00:05:00"), 0) and kv.log().count() == 5 and read(kv) == want


def test_a_write_that_says_an_earlier_time_stays_hidden(spark, kv):
    kv.fold(t("00:05:00"))
    kv.put(spark.createDataFrame([("c", "late")], "key string, value string"), 36_000, t("00:00:30"))
    assert "c" not in read(kv)
    kv.fold(t("00:06:00"))
    assert "c" not in read(kv)


def test_a_batch_that_comes_during_a_fold_stays(spark, kv, monkeypatch):
    rows = kv._rows

    def meanwhile(base, batches):
        kv.put(spark.createDataFrame([("e", "6")], "key string, value string"), 3600, t("00:04:00"))
        return rows(base, batches)

    monkeypatch.setattr(kv, "_rows", meanwhile)
    kv.fold(t("00:05:00"))
    monkeypatch.undo()
    assert read(kv)["e"] == "6" and kv.fold(t("00:05:00")) and read(kv)["e"] == "6"


def test_a_batch_without_its_mark_does_not_count(spark, kv):
    spark.createDataFrame([("new:", "z", "half", None, None, 0)], kv.log().schema).write.parquet(f"{kv.path}/batches/half")
    assert "z" not in read(kv) and kv.fold(t("00:05:00")) and "z" not in read(kv)


def test_clears(kv):
    assert kv.clear("b", prefix_only=True) == 1 and read(kv) == {"a": "4", "xb": "3", "d": None}
    assert kv.clear("b") == 1 and read(kv) == {"a": "4", "d": None}
    assert kv.clear_all("") == 0 and read(kv) == {"a": "4", "d": None}
    assert kv.clear_all() == 3 and read(kv) == {"a": "1"}  # a, c and d of the own namespace; the older namespace shows again
    assert kv.clear_all("old:") == 1 and read(kv) == {}


def test_one_of_several_folds_counts_and_none_loses_a_clear(kv):
    with ThreadPoolExecutor(3) as pool:
        done = [pool.submit(kv.clear, "a"), pool.submit(kv.clear, "xb"), pool.submit(kv.clear, "d")]
        assert [d.result() for d in done] == [2, 1, 1]
    assert read(kv) == {"b": "2"} and kv.generation() == 3


def test_a_file_is_made_once(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: put_once(spark, f"{tmp_path}/x y/1", str(k)), range(8)))
    assert sum(made) == 1 and (tmp_path / "x y/1").read_text() == str(made.index(True)) and [p.name for p in (tmp_path / "x y").iterdir()] == ["1"]
