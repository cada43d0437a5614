"""Intermediate results as tables in the folder that executors share, so that branches of a plan don't compute them again."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, kind: str = "scratch") -> str:
    """A new path in spark.checkpoint.dir. Where that is unset a local session gets a temporary folder, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written to a new folder and read back."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes saved() tables that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/scratch-" not in folder:
                raise ValueError(f"{folder} is not a saved table")
            fs, at = file_system(df.sparkSession, folder)
            fs.delete(at, True)


def swept(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes shuffle files only when the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM's Hadoop client, for any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_once(spark: SparkSession, path: str, content: str) -> bool:
    """Makes a small file with all of its content, unless it is there; whether this call has made it.

    It is written under another name and renamed, which Hadoop's stores refuse if the name is taken; the client of a local folder would replace it, so there it gets its name by a hard link.
    """
    fs, at = file_system(spark, path)
    fs.mkdirs(at.getParent())
    if fs.getScheme() == "file":
        target = Path(unquote(urlparse(at.toUri().toString()).path))
        draft = target.with_name(f"_{uuid.uuid4().hex}")
        draft.write_text(content, encoding="utf-8")
        try:
            os.link(draft, target)
            return True
        except FileExistsError:
            return False
        finally:
            draft.unlink()
    _, draft = file_system(spark, f"{at.getParent()}/_{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(content.encode()))
    out.close()
    if not fs.exists(at) and fs.rename(draft, at):
        return True
    fs.delete(draft, False)
    return False
