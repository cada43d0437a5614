"""Streams with results that last: files that a stopped and restarted stream completes, each batch once, and articles that come once however often they are read.

A batch writes to a folder of its own, named for its number and replaced if the batch is run again, so a stream that dies between its write and its commit repeats itself without a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import first_by_key
from ..sources.scratch import file_system

BUCKETS = 256


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows under a path that may not be there yet, with the columns that its folders name."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema), *more])


def stored(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """All that a stream gives for what is there now, from files in folder; its progress lies beside them, so the next call goes on where the last one ended.

    complete: the rows of the last batch; update and append: those of all batches, with `_batch`, by which later updates can be told. Batches that a complete one replaces are deleted.
    """
    spark, data = stream.sparkSession, f"{folder.rstrip('/')}/data"

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{data}/_batch={number}")
        if mode == "complete" and number:
            fs, old = file_system(spark, f"{data}/_batch={number - 1}")
            fs.delete(old, True)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder.rstrip('/')}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = _written(spark, data, _ddl(stream, "_batch long"))
    if mode != "complete":
        return rows
    last = rows.agg(F.max("_batch")).first()[0]
    return rows.where(F.col("_batch") == F.lit(last)).drop("_batch")


def once_only(stream: DataFrame, key: Column, order: list[Column], folder: str, run: str = "main") -> DataFrame:
    """The rows of a stream whose key no earlier batch and no earlier run has had, the first of each key in a batch by order; from files in folder.

    Runs share the folder and have names; a name goes with its progress. Keys lie in BUCKETS folders by hash, for each run and batch, and a batch reads only the buckets of its own keys.
    A batch that is run again sees the keys of other batches alone and replaces what it wrote. Two runs at once may both give a key: let them hold a sources.lock.Lock. A null key is no key: its rows are left out.
    """
    spark, folder = stream.sparkSession, folder.rstrip("/")
    keys = f"{folder}/keys"

    def write(rows: DataFrame, number: int) -> None:
        keyed = rows.withColumn("_once", key).where("_once is not null")
        first = first_by_key(keyed, F.col("_once"), *order).withColumn("_bucket", F.pmod(F.xxhash64("_once"), F.lit(BUCKETS)).cast("int")).persist()
        own = [r["_bucket"] for r in first.select("_bucket").distinct().collect()]  # BUCKETS at most
        known = _written(spark, keys, "_once string, run string, batch long, _bucket int").where(F.col("_bucket").isin(own) & ~((F.col("run") == run) & (F.col("batch") >= number)))
        new = first.join(known.select("_bucket", "_once"), ["_bucket", "_once"], "left_anti")
        out = f"{folder}/rows/run={run}/batch={number}"
        new.write.mode("overwrite").parquet(out)
        spark.read.schema(new.schema).parquet(out).select("_once", "_bucket").repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{keys}/run={run}/batch={number}")
        first.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress/{run}").trigger(availableNow=True).start()
    query.awaitTermination()
    return _written(spark, f"{folder}/rows", _ddl(stream, "run string", "batch long"))
