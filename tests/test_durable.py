"""Streams that stop and go on: what their files hold in the end."""

import pytest
from pyspark.sql import functions as F

from tidewell import catalogue
from tidewell.streaming import durable, events

EVENTS = "event_id long, user_id long, event_type string, ts timestamp, value double"


def written(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def streamed(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder).withWatermark("ts", "60 days")


@pytest.fixture
def source(spark, tmp_path):
    for k in range(4):
        written(spark, f"{tmp_path}/in", f"part{k}", [(10 * k + i, i % 3, "view" if i % 2 else "error", f"2024-01-0{k + 1} 0{i}:00:00", 1.0) for i in range(6)])
    return f"{tmp_path}/in"


class Killed(Exception):
    pass


def dying(monkeypatch, times):
    """Writes that end, before their batch is committed, so often in an error."""
    left, write = [times], durable.file_system

    def once(spark, path):
        if left[0] and "_batch=" in path:
            left[0] -= 1
            raise Killed(path)
        return write(spark, path)

    monkeypatch.setattr(durable, "file_system", once)


def test_a_complete_stream_ends_alike_after_a_kill(spark, source, tmp_path, monkeypatch):
    run = lambda folder: {(r["start"], r["event_type"], r["n"]) for r in durable.stored(events.tumbling(streamed(spark, source)), "complete", folder).collect()}
    whole = run(f"{tmp_path}/whole")
    dying(monkeypatch, 1)
    with pytest.raises(Exception, match="Killed"):
        run(f"{tmp_path}/killed")
    assert run(f"{tmp_path}/killed") == whole and len(whole) == 8
    assert run(f"{tmp_path}/killed") == whole  # nothing new: the same rows
    written(spark, source, "later", [(99, 1, "view", "2024-01-09 00:00:00", 1.0)])
    assert len(run(f"{tmp_path}/killed")) == 9


def test_appended_rows_come_once(spark, source, tmp_path):
    folder = f"{tmp_path}/out"
    first = lambda: durable.stored(events.unique(streamed(spark, source), "user_id", "event_type"), "append", folder)
    assert first().count() == 6 and first().count() == 6


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def test_keys_come_once_over_batches_runs_and_kills(spark, source, tmp_path, monkeypatch):
    key, order, folder = F.concat_ws(":", "user_id", "event_type"), [F.col("ts")], f"{tmp_path}/once"
    rows = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    left, plain = [2], durable.first_by_key

    def dies(*args):
        left[0] -= 1
        if left[0] == 0:
            raise Killed
        return plain(*args)

    monkeypatch.setattr(durable, "first_by_key", dies)
    with pytest.raises(Exception, match="Killed"):
        durable.once_only(rows(), key, order, folder, "a")
    monkeypatch.setattr(durable, "first_by_key", plain)
    found = durable.once_only(rows(), key, order, folder, "a")
    assert len(ids(found)) == 6 and found.select("user_id", "event_type").distinct().count() == 6
    assert ids(durable.once_only(rows(), key, order, folder, "b")) == ids(found)  # another run over the same rows adds none
    written(spark, source, "later", [(100, 0, "view", "2024-01-09 00:00:00", 1.0), (101, 9, "view", "2024-01-09 00:00:00", 1.0), (102, 9, "view", "2024-01-08 00:00:00", 1.0)])
    assert ids(durable.once_only(rows(), key, order, folder, "b")) == sorted([*ids(found), 102])


def test_a_batch_that_was_written_but_not_committed_is_replaced(spark, source, tmp_path):
    """The rows and keys of a batch lie there, its commit doesn't: as if the driver had died between."""
    import shutil
    from pathlib import Path

    key, order, folder = F.col("user_id").cast("string"), [F.col("ts")], f"{tmp_path}/once"
    rows = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    want = ids(durable.once_only(rows(), key, order, folder, "a"))
    for commit in Path(f"{folder}/progress/a/commits").iterdir():
        commit.unlink() if commit.is_file() else shutil.rmtree(commit)
    assert ids(durable.once_only(rows(), key, order, folder, "a")) == want and len(want) == 3


def test_tables_in_folders_come_as_streams(spark, tmp_path):
    """A table may be a folder of files: its stream has the rows of all of them, and nothing of its neighbours."""
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "pages"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(5).write.parquet(f"{tmp_path}/more_documents.parquet")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_articles_once", "stream_velocity"):
        got, want = (sorted(map(tuple, catalogue.QUERIES[name](spark, d).collect())) for d in (str(tmp_path), "/root/testdata/sf0.001"))
        assert got == want and got
