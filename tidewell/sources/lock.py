"""One run at a time: a lock as files in a store that all drivers reach."""

from __future__ import annotations

import os
import time
import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from .scratch import file_system


class Lock:
    """Generations of a lock: files 1, 2, 3, ... in a folder, each made by one owner only, and n.done when its owner has let go.

    The newest generation holds the lock until it is done or older than `seconds` by the store's own clock for files. Whoever wants it then makes the next file, which the store
    lets succeed for one. An owner that took too long finds a newer generation and must not publish: holds() tells. Generations only grow, so they also order what their owners write.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: int) -> None:
        self.spark, self.folder, self.seconds, self.owner = spark, folder.rstrip("/"), seconds, uuid.uuid4().hex
        self.generation = 0

    def _made(self, name: str) -> bool:
        """Whether this call has made the file: atomically by the store, or by the operating system where the store is a local folder, whose Hadoop client only looks before it writes."""
        fs, path = file_system(self.spark, f"{self.folder}/{name}")
        fs.mkdirs(path.getParent())
        if fs.getScheme() == "file":
            local = Path(unquote(urlparse(path.toUri().toString()).path))
            try:
                with os.fdopen(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as out:
                    out.write(self.owner)
                return True
            except FileExistsError:
                return False
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if fs.exists(path):  # someone else was first
                return False
            raise e
        out.write(bytearray(self.owner.encode()))
        out.close()
        return True

    def _newest(self) -> tuple[int, float, bool]:
        """(generation, its age in seconds, whether it is done); generation 0 stands for none."""
        fs, path = file_system(self.spark, self.folder)
        if not fs.exists(path):
            return 0, 0.0, True
        files = {f.getPath().getName(): f.getModificationTime() / 1000 for f in fs.listStatus(path)}
        newest = max((int(n) for n in files if n.isdigit()), default=0)
        return newest, time.time() - files.get(str(newest), 0.0), f"{newest}.done" in files or not newest

    def acquire(self) -> bool:
        newest, age, done = self._newest()
        if (done or age > self.seconds) and self._made(str(newest + 1)):
            self.generation = newest + 1
        return self.generation > 0

    def holds(self) -> bool:
        """Whether no one has taken over from this owner."""
        return self.generation > 0 and self._newest()[0] == self.generation

    def taken(self) -> bool:
        """Whether anyone holds it now."""
        _, age, done = self._newest()
        return not done and age <= self.seconds

    def release(self) -> None:
        if self.generation:
            self._made(f"{self.generation}.done")
            self.generation = 0
