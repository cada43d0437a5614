"""spark-submit entry: makes the stories of an edition and stores them, unless another run is at it.

    spark-submit -m tidewell.refresh --articles PATH --out PATH --store PATH --as-of "2024-01-31 00:00:00"

A lock that expires after ten minutes lets one run through; the stages with their progress are rows of the key-value table.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .operators.state import progress
from .params import Params
from .plans import summaries
from .plans.intake import all_news
from .plans.stories import Model, ranked_stories
from .sources.scratch import saved
from .sources.lock import Lock
from .sources.store import KeyValue, write_snapshot

STATUS, LOCK_SECONDS, ERROR_SECONDS = "refresh-status", 600, 180


class Overtaken(Exception):
    """Raised when a run took longer than its lock lasts and another one has begun."""


class Refresh:
    """One run at a time. Stages: started 0, news 10, stories 50, with a model that writes them summaries 90, stored 95, complete 100; error on a failure, for three minutes.

    The lock lies beside the store. States carry the lock's generation, so those of a later run win whatever its as_of.
    """

    def __init__(self, spark: SparkSession, store: KeyValue, as_of: str, lock_seconds: int = LOCK_SECONDS) -> None:
        self.spark, self.store, self.now, self.step = spark, store, F.lit(as_of).cast("timestamp"), 0
        self.lock = Lock(spark, f"{store.path}.lock", lock_seconds)

    def say(self, value: str, seconds: int = LOCK_SECONDS) -> None:
        self.step += 1
        rows = self.spark.createDataFrame([(STATUS, value)], "key string, value string")
        self.store.put(rows, seconds, self.now, (self.lock.generation << 20) + self.step)

    def run(self, articles: DataFrame, out: str, edition: str, p: Params = Params(), model: Model = Model(), feed_url: str | None = None) -> bool:
        """Whether this run made the edition: not if another one holds the lock. feed_url: the column that the blocklist reads and that tells aggregators."""
        if not self.lock.acquire():
            return False
        try:
            self.say("started:0")
            news = all_news(articles, "source_name", p, feed_url).withColumn("edition", F.lit(0).cast("long"))
            self.say("news:10")
            stories = saved(ranked_stories(news, dims.category_meta(self.spark), self.now, p, model))
            self.say("stories:50")
            if model.summarise:
                asked = stories.withColumn("summary", F.lit(None).cast("string"))  # the titles there stand in for a summary
                done = summaries.generate(self.store, asked, news, model.summarise, self.now, p)
                self.say(f"summaries:{done.agg(progress(F.count('*'), F.count('*'))).first()[0]}")
            if not self.lock.holds():
                raise Overtaken(edition)
            write_snapshot(stories, out, edition)
            self.say("stored:95")
            self.say("complete:100")
            return True
        except Exception:
            if self.lock.holds():
                self.say("error:0", ERROR_SECONDS)
            raise
        finally:
            self.lock.release()


def main(args: list[str] | None = None) -> bool:
    parser = argparse.ArgumentParser()
    for name in ("articles", "out", "store", "as-of"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--feed-url", help="the column of articles that holds a feed's address")
    got = parser.parse_args(args)
    spark = SparkSession.builder.appName("refresh").getOrCreate()
    store = KeyValue(spark, got.store, ["main:"])
    made = Refresh(spark, store, got.as_of).run(spark.read.parquet(got.articles), got.out, got.as_of, feed_url=got.feed_url)
    if made:
        store.fold(F.lit(got.as_of).cast("timestamp"))
    return made


if __name__ == "__main__":
    main()
