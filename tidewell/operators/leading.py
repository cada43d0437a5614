"""Leader clustering of editions of any size: `greedy.lead`, block by block of an edition's order.

Newest first, each article joins the nearest story if that is near enough and not full, else it opens one. A round takes the next block of every edition. A join on terms, first without each article's
most frequent ones, measures its articles against the stories so far, and then only some of these matter: a story that no article of the block is near as it stood before the block gains none (its first would have met it as it stood), and one
that was full stays as it is, so the nearest of the full ones stands for all. What is left is a block's articles and the open stories near them, in one group of a grouped map, where each decision moves
the centre that the next one meets. So the stories are those of one article after the other, a group doesn't grow with its edition, and rounds are as many as the blocks of the largest edition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doc_text
from ..params import Params
from ..sources.scratch import saved
from . import tfidf
from .numbering import numbered

#: Articles of an edition in one round. A group holds the square of it as numbers, and as many again for each time as many open stories.
BLOCK = 2048
#: Sums in another order differ by less; such differences decide nothing.
SLACK, EQUAL = 1e-9, 1e-12
_ARTICLE, _TERM, _DOT, _STORY, _FULL = range(5)


def _gram(at: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, width: int = 1024, rare: int = 64) -> np.ndarray:
    """Inner products of n articles: rare terms pair by pair, the others as dense columns, some at a time."""
    order = np.argsort(term, kind="stable")
    at, w, count = at[order], w[order], np.bincount(term)
    often, flat = np.repeat(count > rare, count), np.bincount(at * n + at, w * w, n * n)
    few, few_w, few_term = at[~often], w[~often], term[order][~often]
    for shift in range(1, min(rare, len(few))):
        same = np.flatnonzero(few_term[shift:] == few_term[:-shift])
        i, j, both = few[same], few[same + shift], few_w[same] * few_w[same + shift]
        np.add.at(flat, i * n + j, both)
        np.add.at(flat, j * n + i, both)
    out = flat.reshape(n, n)
    column = np.repeat(np.arange((count > rare).sum()), count[count > rare])
    at, w = at[often], w[often]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [first, first + width])
        part = np.zeros((n, width))
        part[at[low:high], column[low:high] - first] = w[low:high]
        part = part @ part.T
        np.fill_diagonal(part, 0.0)  # counted above
        out += part
    return out


def _settle(block: pd.DataFrame, threshold: float, most: int) -> list[tuple[int, int]]:
    """(pos, story) for the articles of one edition's block; a story bears the place of the article that opened it."""
    kinds = {k: part for k, part in block.groupby("kind")}
    none = block.iloc[:0]
    places = np.sort(kinds[_ARTICLE]["pos"].to_numpy(dtype=np.int64))
    n = len(places)
    posting, dot, known, full = (kinds.get(k, none) for k in (_TERM, _DOT, _STORY, _FULL))
    row = lambda part: np.searchsorted(places, part["pos"].to_numpy(dtype=np.int64))
    gram = _gram(row(posting), pd.factorize(posting["term"])[0], posting["x"].to_numpy(), n)
    norm = np.sqrt(gram.diagonal())
    norm[norm == 0] = 1.0

    known = known.sort_values("story")
    stories = known["story"].astype("int64").tolist()
    size = known["pos"].astype("int64").tolist()
    square = np.concatenate([known["x"].to_numpy(dtype=np.float64), np.zeros(n)])
    dots = np.zeros((len(stories) + n, n))
    dots[np.searchsorted(np.array(stories, dtype=np.int64), dot["story"].to_numpy(dtype=np.int64)), row(dot)] = dot["x"].to_numpy()
    nearest_full = dict(zip(row(full).tolist(), zip(full["x"], full["story"])))

    out = []
    for k in range(n):
        m, at, top = len(stories), -1, EQUAL
        if m:
            sims = dots[:m, k] / (norm[k] * np.sqrt(np.where(square[:m] > 0, square[:m], 1.0)))
            best = sims.max()
            if best > top:
                at, top = int(np.argmax(sims >= best - EQUAL)), best
        if k in nearest_full:
            sim, story = nearest_full[k]
            if sim > top + EQUAL or (sim >= top - EQUAL and at >= 0 and story < stories[at]):
                at = -1
        if at >= 0 and top >= threshold and size[at] < most:
            size[at] += 1
        else:
            at = m
            stories.append(int(places[k]))
            size.append(1)
        square[at] += 2 * dots[at, k] + gram[k, k]
        dots[at] += gram[k]
        out.append((int(places[k]), stories[at]))
    return out


def _told(articles: DataFrame, postings: DataFrame, centres: DataFrame | None, sizes: DataFrame | None, p: Params) -> DataFrame:
    """(edition, pos, story) of a block."""

    def part(rows: DataFrame, kind: int, **cols) -> DataFrame:
        null = {"pos": F.lit(None).cast("long"), "story": F.lit(None).cast("long"), "term": F.lit(None).cast("string"), "x": F.lit(None).cast("double")}
        return rows.select("edition", F.lit(kind).alias("kind"), *[(F.col(cols[c]) if c in cols else null[c]).alias(c) for c in null])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        told = _settle(pdf, p.precluster_threshold, p.precluster_max_group)
        return pd.DataFrame([(key[0], a, s) for a, s in told], columns=["edition", "pos", "story"])

    parts = part(articles, _ARTICLE, pos="pos").unionByName(part(postings, _TERM, pos="pos", term="term", x="w"))
    if centres is not None:
        squares = centres.groupBy("edition", "story").agg(F.sum(F.col("c") * F.col("c")).alias("square")).join(sizes, ["edition", "story"])
        tails = postings.where(~F.col("head")).join(centres, ["edition", "term"]).groupBy("edition", "pos", "story", "norm", "head_norm").agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
        maybe = tails.join(squares, ["edition", "story"]).where(F.col("dot") / F.sqrt("square") + F.col("head_norm") >= (p.precluster_threshold - SLACK) * F.col("norm"))
        maybe = saved(maybe.select("edition", "story", "square", "n").distinct())
        met = postings.join(centres.join(maybe.select("edition", "story"), ["edition", "story"], "left_semi"), ["edition", "term"])
        met = met.groupBy("edition", "pos", "story", "norm").agg(F.sum(F.col("w") * F.col("c")).alias("dot")).join(maybe, ["edition", "story"])
        met = saved(met.select("edition", "pos", "story", "dot", "square", "n", (F.col("dot") / (F.col("norm") * F.sqrt("square"))).alias("sim")))
        near, filled = F.col("sim") >= p.precluster_threshold - SLACK, F.col("n") >= p.precluster_max_group
        of_full = met.where(near & filled)
        best = of_full.groupBy("edition", "pos").agg(F.max("sim").alias("top"))
        best = of_full.join(best, ["edition", "pos"]).where(F.col("sim") >= F.col("top") - EQUAL).groupBy("edition", "pos").agg(F.min_by("sim", "story").alias("sim"), F.min("story").alias("story"))
        still = saved(met.where(near & ~filled).select("edition", "story", "square", "n").distinct())
        dots = met.join(still.select("edition", "story"), ["edition", "story"], "left_semi")
        parts = parts.unionByName(part(dots, _DOT, pos="pos", story="story", x="dot")).unionByName(part(still, _STORY, pos="n", story="story", x="square"))
        parts = parts.unionByName(part(best, _FULL, pos="pos", story="story", x="sim"))
    return parts.groupBy("edition").applyInPandas(run, "edition long, pos long, story long")


def _postings(rows: DataFrame, threshold: float) -> DataFrame:
    """(edition, pos, term, w, norm, head, head_norm). An article's head are its most frequent terms, so few that they alone reach no more than 0.7 of the threshold with any story."""
    of = Window.partitionBy("edition", "pos")
    rising = of.orderBy(F.col("w") / (1 + F.log("tf")), "term").rowsBetween(Window.unboundedPreceding, 0)
    square = F.col("w") * F.col("w")
    own = tfidf.weights(rows, "pos", F.col("text"), within=["edition"]).withColumn("norm", F.sqrt(F.sum(square).over(of)))
    own = own.withColumn("head", F.sqrt(F.sum(square).over(rising)) <= 0.7 * threshold * F.col("norm"))
    return own.withColumn("head_norm", F.sqrt(F.sum(F.when(F.col("head"), square).otherwise(0.0)).over(of))).drop("tf")


def preclustered(articles: DataFrame, p: Params = Params(), block: int = BLOCK) -> DataFrame:
    """greedy.CLUSTERS from articles (edition, id, title, description, content, published_at as a number, ord): the stories of enough articles, numbered from 0 in the order in which they opened.

    Articles without a time come last, equal times by ord, then id. Rows with an equal id are articles of their own. An article without terms is a story of its own. No articles: no rows.
    """
    time = F.col("published_at").cast("double")
    untimed = time.isNull() | F.isnan(time)
    rows = articles.select("edition", "id", F.coalesce("title", F.lit("")).alias("title"), doc_text(F.col("title"), F.col("description"), F.col("content")).alias("text"), untimed.alias("untimed"), F.when(~untimed, -F.col("published_at")).alias("age"), "ord")
    rows = saved(numbered(rows, ["edition"], ["untimed", "age", "ord", "id"], "pos").select("edition", "id", "title", "text", "pos", F.floor(F.col("pos") / block).alias("block")))
    last = rows.agg(F.max("block").alias("last")).first()["last"]
    postings = _postings(rows, p.precluster_threshold).withColumn("block", F.floor(F.col("pos") / block))
    postings = saved(postings.sortWithinPartitions("block"))
    told = centres = sizes = None
    for k in range(0 if last is None else last + 1):
        own = postings.where(F.col("block") == k).drop("block")
        new = saved(_told(rows.where(F.col("block") == k), own, centres, sizes, p))
        told = new if told is None else told.unionByName(new)
        if k < last:
            moved = own.join(new, ["edition", "pos"]).select("edition", "story", "term", F.col("w").alias("c"))
            moved = moved if centres is None else moved.unionByName(centres)
            centres = saved(moved.groupBy("edition", "story", "term").agg(F.sum("c").alias("c")))
            sizes = saved(told.groupBy("edition", "story").agg(F.count("*").alias("n")))
    if told is None:
        return articles.sparkSession.createDataFrame([], "edition long, cluster_key long, cluster_title string, article_ids array<string>")
    each = told.join(rows.select("edition", "pos", "id", "title"), ["edition", "pos"]).groupBy("edition", "story")
    lists = each.agg(F.array_sort(F.collect_list(F.struct("pos", "id", "title"))).alias("m")).where(F.size("m") >= p.precluster_min_size)  # a story is as long as the greatest group, at most
    lists = lists.select("edition", "story", F.col("m")[0]["title"].alias("cluster_title"), F.transform("m", lambda x: x["id"]).alias("article_ids"))
    return saved(numbered(lists, ["edition"], ["story"], "cluster_key").select("edition", F.col("cluster_key").cast("long"), "cluster_title", "article_ids"))
