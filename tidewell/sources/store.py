"""A key-value table with expiry, and snapshots of the page, as Parquet: appended to, the latest write wins."""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from .scratch import file_system, put_once

LOG = "ns string, key string, value string, written_at timestamp, expires_at timestamp, seq long"


class KeyValue:
    """Reads see the namespaces in order; writes go to the first.

    Every write is a batch: a folder in batches/ of its own, which counts when its mark is there. fold() and the clears put all batches into one base and name, in the next manifest, the base
    and the batches that it holds; the store lets one make that manifest, so readers see what was before or what is after. A batch that comes meanwhile isn't named and
    stays. What a manifest has replaced stays readable until the next one, for reads that are under way.
    """

    def __init__(self, spark: SparkSession, path: str, namespaces: list[str]) -> None:
        self.spark, self.path, self.namespaces = spark, path.rstrip("/"), namespaces

    def _names(self, part: str) -> list[str]:
        fs, at = file_system(self.spark, f"{self.path}/{part}")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return [n for n in names if n[0] not in "._"]

    def _manifest(self, number: int) -> dict:
        if number < 1:
            return {"base": None, "folded": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{number}", wholetext=True).first()[0])

    def generation(self) -> int:
        """The number of the newest manifest; 0 before the first."""
        return max((int(n) for n in self._names("manifests") if n.isdigit()), default=0)

    def _batches(self, folded: list[str]) -> list[str]:
        return sorted(set(self._names("marks")) - set(folded))

    def _rows(self, base: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{b}" for b in batches] + ([f"{self.path}/bases/{base}"] if base else [])
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def log(self) -> DataFrame:
        """All writes that count now; one that is made later isn't in it."""
        while True:
            number = self.generation()
            now = self._manifest(number)
            batches = self._batches(now["folded"])
            if number == self.generation():  # else the batches may be those of another manifest
                return self._rows(now["base"], batches)

    def put(self, rows: DataFrame, ttl_seconds: int, as_of: Column, seq: int = 0) -> None:
        self.append(state.cache_put(rows, self.namespaces[0], ttl_seconds, as_of).withColumn("seq", F.lit(seq).cast("long")))

    def append(self, log: DataFrame) -> None:
        """Writes rows of LOG as one batch: all of it counts at once."""
        batch = uuid.uuid4().hex
        log.write.parquet(f"{self.path}/batches/{batch}")
        put_once(self.spark, f"{self.path}/marks/{batch}", "")

    def get(self, as_of: Column) -> DataFrame:
        return state.cache_read(self.log(), self.namespaces, as_of)

    def _replace(self, stays: Column | None, keep: Column | None) -> int | None:
        """Makes the next generation of the writes that stay, the latest of each key; the number of keys that went by `stays`. None if another one was faster: nothing has changed then."""
        number = self.generation()
        now, before = self._manifest(number), self._manifest(number - 1)
        fs, _ = file_system(self.spark, self.path)

        def delete(name: str) -> None:
            fs.delete(file_system(self.spark, f"{self.path}/{name}")[1], True)

        for batch in now["folded"]:  # only readers from before this generation know them
            for part in ("batches", "marks"):
                delete(f"{part}/{batch}")
        if before["base"] and before["base"] != now["base"]:
            delete(f"bases/{before['base']}")
        batches, base = self._batches(now["folded"]), uuid.uuid4().hex
        rows = self._rows(now["base"], batches)
        latest = rows.groupBy("ns", "key").agg(F.max_by(F.struct("value", "written_at", "expires_at", "seq"), F.struct("written_at", "seq")).alias("v")).select("ns", "key", "v.*")
        gone = latest.where(~stays).count() if stays is not None else 0
        for condition in (stays, keep):
            latest = latest.where(condition) if condition is not None else latest
        latest.write.parquet(f"{self.path}/bases/{base}")
        if put_once(self.spark, f"{self.path}/manifests/{number + 1}", json.dumps({"base": base, "folded": batches})):
            return gone
        delete(f"bases/{base}")
        return None

    def fold(self, as_of: Column, grace_seconds: int = 86_400) -> bool:
        """Keeps the latest write of each key, and none that expired longer than the grace ago: a batch that is written later but says an earlier time within it is still hidden.

        Reads at as_of or later give the same before, meanwhile and after. False if another fold was faster.
        """
        return self._replace(None, F.col("expires_at") > as_of - F.make_dt_interval(secs=F.lit(grace_seconds))) is not None

    def _clear(self, stays: Column, tries: int = 5) -> int:
        for _ in range(tries):
            gone = self._replace(stays, None)
            if gone is not None:
                return gone
        raise RuntimeError(f"{self.path}: other folds were faster {tries} times")

    def clear_all(self, prefix: str | None = None) -> int:
        """Clears the keys, with their namespace, that begin with a prefix, the own namespace's if none is given; how many there were. Nothing without a prefix, as that would clear what others keep."""
        prefix = self.namespaces[0] if prefix is None else prefix
        return self._clear(~F.startswith(F.concat("ns", "key"), F.lit(prefix))) if prefix else 0

    def clear(self, pattern: str, to: str | None = None, prefix_only: bool = False) -> int | None:
        """Clears the keys that contain a text or begin with it, and says how many; with `to`, writes the entries that stay to another path instead."""
        if to is None:
            hit = F.startswith("key", F.lit(pattern)) if prefix_only else F.contains("key", F.lit(pattern))
            return self._clear(~hit)
        state.cache_clear(self.log(), pattern, prefix_only).write.mode("overwrite").parquet(to)
        return None


def namespace(env: dict[str, str]) -> str:
    """The key prefix of a deployment: one that is set, production, the branch of a preview, development, or local."""
    if env.get("CACHE_PREFIX"):
        return env["CACHE_PREFIX"]
    if env.get("NODE_ENV") == env.get("VERCEL_ENV") == "production":
        return "prod:"
    if env.get("VERCEL_ENV") == "preview":
        branch = "".join(c if c.isascii() and (c.isalnum() or c == "-") else "-" for c in env.get("VERCEL_GIT_COMMIT_REF", "")) or "preview"
        return f"staging-{branch}:"
    return "dev:" if env.get("NODE_ENV") == "development" else "local:"


def write_snapshot(stories: DataFrame, path: str, edition: str) -> None:
    """Adds the stories of an edition, which may be none: its folder then holds their columns only."""
    stories.write.mode("append").parquet(f"{path}/edition_ts={quote(edition, safe=' ')}")


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest edition with stories; only its partition is read."""
    all_of = spark.read.parquet(path)
    newest = all_of.select("edition_ts").distinct().agg(F.max("edition_ts")).first()[0]
    return all_of.where(F.col("edition_ts") == F.lit(newest))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))
