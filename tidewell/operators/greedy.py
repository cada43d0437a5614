"""Passes over clusters whose outcome depends on their order, one article or cluster after the other: leader clustering, splitting, a model's part, and the merges.

A model's calls run within one edition: a batch of bounded size (its limit is Params.news_global_limit); splitting runs within one cluster. These are groups of a grouped map and run side by
side. A group beyond the bound is refused rather than cut. Leader clustering and the merges state what `leading` and `merging` do with editions of any size, for a few articles or clusters at hand.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import STOPWORDS
from ..params import Params

Vector = dict[str, float]
_STOP = frozenset(STOPWORDS)
MOST = 50_000
ARTICLE = ["id", "title", "description", "content", "published_at", "ord"]
CLUSTERS = "edition long, cluster_key long, cluster_title string, article_ids array<string>"


def tokens(text: str | None) -> list[str]:
    text = re.sub(r"https?://\S+", " ", (text or "").lower())
    return [t for t in re.sub(r"[^a-z0-9\s]", " ", text).split() if len(t) > 2 and t not in _STOP]


def _text(row: dict) -> str:
    return " ".join([row.get("title") or "", row.get("description") or "", (row.get("content") or "")[:500]])


def vectors(rows: list[dict]) -> dict[str, Vector]:
    tf: dict[str, dict[str, int]] = {}
    df: dict[str, int] = defaultdict(int)
    for r in rows:
        counts: dict[str, int] = defaultdict(int)
        for t in tokens(_text(r)):
            counts[t] += 1
        for t in counts:
            df[t] += 1
        tf[r["id"]] = counts
    idf = {t: math.log(1 + len(rows) / (1 + n)) for t, n in df.items()}
    return {i: {t: (1 + math.log(n)) * idf[t] for t, n in c.items()} for i, c in tf.items()}


def length(v: Vector) -> float:
    return math.sqrt(sum(w * w for w in v.values())) or 1.0


class Centres:
    """Growing centroids with an index by term, so that a vector meets only the centroids that it shares a term with."""

    def __init__(self) -> None:
        self.weight: list[Vector] = []
        self.square: list[float] = []
        self.by_term: dict[str, dict[int, float]] = defaultdict(dict)

    def add(self, at: int, v: Vector) -> None:
        if at == len(self.weight):
            self.weight.append({})
            self.square.append(0.0)
        own = self.weight[at]
        for t, w in v.items():
            old = own.get(t, 0.0)
            own[t] = self.by_term[t][at] = old + w
            self.square[at] += (old + w) ** 2 - old**2

    def best(self, v: Vector) -> tuple[int, float]:
        """The nearest centroid and its cosine, the first of equals; (-1, 0) if none shares a term."""
        dots: dict[int, float] = defaultdict(float)
        for t, w in v.items():
            for at, c in self.by_term.get(t, {}).items():
                dots[at] += w * c
        norm, found, top = length(v), -1, 0.0
        for at in sorted(dots):
            sim = dots[at] / (norm * (math.sqrt(self.square[at]) or 1.0))
            if sim > top + 1e-12:
                found, top = at, sim
        return found, top


def lead(rows: list[dict], threshold: float, least: int, most: int) -> list[tuple[str, list[str]]]:
    """Newest first, each article joins the nearest story if that is near enough and not full, else it opens one. (title, ids) of the stories of enough articles."""
    vec, centres, stories = vectors(rows), Centres(), []
    order = sorted(rows, key=lambda r: (r["published_at"] is None or r["published_at"] != r["published_at"], -(r["published_at"] or 0), r["ord"]))
    for r in order:
        v = vec[r["id"]]
        at, sim = centres.best(v)
        if at >= 0 and sim >= threshold and len(stories[at][1]) < most:
            stories[at][1].append(r["id"])
        else:
            at = len(stories)
            stories.append((r["title"] or "", [r["id"]]))
        centres.add(at, v)
    return [s for s in stories if len(s[1]) >= least]


def union(a: list[str], b: list[str]) -> list[str]:
    return list(dict.fromkeys([*a, *b]))


def absorb(clusters: list[tuple[str, list[str]]], near: Callable[[int, int, tuple[str, list[str]]], bool], keys: list[set[str]], wanted: Callable[[int, tuple[str, list[str]]], Iterable[str]]) -> list[tuple[str, list[str]]]:
    """Each cluster takes in the later ones that are near it as it has grown so far: the longer title, all ids.

    Only those that have one of the wanted keys can be near, so they are looked up, in order, instead of comparing all pairs.
    """
    holders: dict[str, list[int]] = defaultdict(list)
    for j, own in enumerate(keys):
        for k in own:
            holders[k].append(j)
    out, gone = [], set()
    for i, base in enumerate(clusters):
        if i in gone:
            continue
        at, asked, queue, seen = i, set(), [], set()
        while True:
            for k in set(wanted(i, base)) - asked:
                asked.add(k)
                for j in holders.get(k, ()):
                    if j > at and j not in seen and j not in gone:
                        seen.add(j)
                        heappush(queue, j)
            if not queue:
                break
            at = heappop(queue)
            if near(i, at, base):
                other = clusters[at]
                base = (base[0] if len(base[0]) >= len(other[0]) else other[0], union(base[1], other[1]))
                gone.add(at)
        out.append(base)
    return out


def by_overlap(clusters: list[tuple[str, list[str]]], jaccard: float) -> list[tuple[str, list[str]]]:
    """Common ids are counted against a cluster's own ids, the union against the grown ones."""
    own = [set(c[1]) for c in clusters]
    return absorb(clusters, lambda i, j, base: sum(x in own[i] for x in clusters[j][1]) / (len(set(base[1]) | own[j]) or 1) >= jaccard, own, lambda i, base: own[i])


def by_title(clusters: list[tuple[str, list[str]]], threshold: float) -> list[tuple[str, list[str]]]:
    """Compared by the title that has won so far."""
    words = [frozenset(tokens(c[0])) for c in clusters]
    of: dict[str, frozenset[str]] = {c[0]: w for c, w in zip(clusters, words)}

    def near(i: int, j: int, base: tuple[str, list[str]]) -> bool:
        a, b = of[base[0]], words[j]
        return len(a & b) / (len(a | b) or 1) >= threshold

    return absorb(clusters, near, [set(w) for w in words], lambda i, base: of[base[0]]) if len(clusters) > 1 else clusters


def entities(text: str) -> set[str]:
    """Names in a text, as functions.entities has them."""
    plain = lambda s: re.sub(r"\s+", "_", s.lower()).replace("'", "")
    out = {plain(m) for m in re.findall(r"[A-Z][a-zA-Z']*(?:\s+[A-Z][a-zA-Z']*)+", text)}
    for sentence in re.split(r"[.!?]\s+", text):
        out |= {plain(w) for w in re.split(r"\s+", sentence)[1:] if len(w) >= 3 and re.fullmatch(r"[A-Z][a-zA-Z']*", w)}
    out |= {m.lower() for m in re.findall(r"\b[A-Z]{2,6}\b", text, re.A)}
    return out | {re.sub(r"\s+", "_", m.lower()) for m in re.findall(r"[A-Z][a-zA-Z]*\s*[0-9]{2,4}", text)}


def mean_cosine(a: list[str], b: list[str], vec: dict[str, Vector], norm: dict[str, float], sample: int) -> float:
    """Over the first pairs, row by row."""
    a, b = [x for x in a if x in vec], [x for x in b if x in vec]
    pairs = [(x, y) for x in a[:sample] for y in b[:sample]][:sample] if len(b) <= sample else [(a[0], y) for y in b[:sample]] if a else []
    if not pairs:
        return 0.0
    return sum(sum(w * vec[y].get(t, 0.0) for t, w in vec[x].items()) / (norm[x] * norm[y]) for x, y in pairs) / len(pairs)


def by_entity(clusters: list[tuple[str, list[str]]], rows: dict[str, dict], shared: int, least: int, coherence: float, sample: int = 20) -> list[tuple[str, list[str]]]:
    """Names are each cluster's own throughout; coherence is of the articles gathered so far."""
    if len(clusters) <= 1:
        return clusters
    used = dict.fromkeys(i for _, ids in clusters for i in ids if i in rows)
    vec = vectors([rows[i] for i in used])
    norm = {i: length(v) for i, v in vec.items()}
    names = [{e for e in entities(". ".join([t, *[rows[i]["title"] for i in ids[:10] if i in rows and rows[i]["title"]]])) if len(e) >= least} for t, ids in clusters]
    return absorb(clusters, lambda i, j, base: len(names[i] & names[j]) >= shared and mean_cosine(base[1], clusters[j][1], vec, norm, sample) >= coherence, names, lambda i, base: names[i])


def split(cluster: tuple[str, list[str]], rows: list[dict], threshold: float, least: int) -> list[tuple[str, list[str]]]:
    """Stories within a cluster; articles of too small ones go to the nearest that is left, which moves with them. Empty if none is left."""
    own = set(cluster[1])
    subset = [r for r in rows if r["id"] in own]
    if len(subset) < least:
        return []
    found = lead(subset, threshold, 1, 50)
    kept = [(t, list(ids)) for t, ids in found if len(ids) >= least]
    loose = [i for _, ids in found if len(ids) < least for i in ids]
    if not kept or not loose:
        return kept
    vec, centres = vectors(subset), Centres()
    for at, (_, ids) in enumerate(kept):
        for i in ids:
            centres.add(at, vec[i])
    for i in loose:
        at = max(centres.best(vec[i])[0], 0)
        kept[at][1].append(i)
        centres.add(at, vec[i])
    return kept


def _rows(pdf: pd.DataFrame) -> list[dict]:
    if len(pdf) > MOST:
        raise ValueError(f"an edition of {len(pdf)} rows; {MOST} at most")
    return pdf.sort_values("ord").to_dict("records") if len(pdf) else []


def _out(edition: int, clusters: list[tuple[str, list[str]]]) -> pd.DataFrame:
    return pd.DataFrame([(edition, k, t, ids) for k, (t, ids) in enumerate(clusters)], columns=["edition", "cluster_key", "cluster_title", "article_ids"])


def _clusters(pdf: pd.DataFrame) -> list[tuple[str, list[str]]]:
    return [(t or "", list(ids)) for t, ids in zip(pdf.sort_values("cluster_key")["cluster_title"], pdf.sort_values("cluster_key")["article_ids"])]


def _apply(clusters: DataFrame, articles: DataFrame, step: Callable[[list, list[dict]], list]) -> DataFrame:
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _out(key[0], step(_clusters(left), _rows(right)))

    return clusters.groupBy("edition").cogroup(articles.select("edition", *ARTICLE).groupBy("edition")).applyInPandas(run, CLUSTERS)


def split_all(clusters: list, rows: list[dict], p: Params) -> list:
    """A cluster that falls apart entirely stays as it is, if it is large enough."""
    out = []
    for c in clusters:
        parts = split(c, rows, p.cluster_coherence_threshold, p.cluster_coherence_min)
        out += parts or ([c] if len(c[1]) >= p.cluster_coherence_min else [])
    return out


def coherent(clusters: DataFrame, articles: DataFrame, p: Params = Params()) -> DataFrame:
    """split_all for each cluster, side by side: a group is one cluster's articles. Keys keep the order of clusters and of their parts."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        own = (pdf["cluster_title"].iloc[0] or "", pdf["id"].dropna().tolist())
        parts = split_all([own], _rows(pdf[pdf["ord"].notna()].drop(columns=["pos", "cluster_title"])), p)
        return pd.DataFrame([(key[0], (key[1] << 20) + k, t, ids) for k, (t, ids) in enumerate(parts)], columns=["edition", "cluster_key", "cluster_title", "article_ids"])

    each = clusters.select("edition", "cluster_key", "cluster_title", F.posexplode_outer("article_ids").alias("pos", "id")).join(articles.select("edition", *ARTICLE), ["edition", "id"], "left")
    return each.groupBy("edition", "cluster_key").applyInPandas(run, CLUSTERS)


#: A model's part in clustering. Refine: rows of articles to (title, ids) clusters of them. Merge: clusters to groups of their numbers that tell the same story.
Refine = Callable[[list[dict]], list[tuple[str, list[str]]]]
Merge = Callable[[list[tuple[str, list[str]]]], list[list[int]]]


class Limited(Exception):
    """Raised by a model that takes no more calls for now."""


def asked_of(clusters: DataFrame, articles: DataFrame, p: Params, refine: Refine) -> DataFrame:
    """What a model makes of an edition's seeds; see asked."""
    return _apply(clusters, articles, lambda c, r: asked(c, r, p, refine))


def grouped_by(clusters: DataFrame, articles: DataFrame, merge: Merge) -> DataFrame:
    """An edition's clusters as a model groups them; see grouped."""
    return _apply(clusters, articles, lambda c, _: grouped(c, merge) if len(c) > 1 else c)


def asked(seeds: list, rows: list[dict], p: Params, refine: Refine) -> list:
    """What a model makes of the seeds, long ones in overlapping chunks, and then of the articles that no cluster has, if there are three at least.

    At its limit the seeds stay as they are, or the articles beyond that chunk alone; a call that fails otherwise gives nothing.
    """
    place, out = {r["id"]: r for r in rows}, []

    def call(part: list[dict]) -> list:
        try:
            return [(t, list(ids)) for t, ids in refine(part) if t and len(ids) >= 2]
        except Limited:
            raise
        except Exception:
            return []

    try:
        for seed in seeds:
            for _, ids in chunked([seed], rows, p):
                out += call([place[i] for i in ids if i in place])
    except Limited:
        return chunked(seeds, rows, p)
    covered = {i for _, ids in out for i in ids}
    rest = [r for r in rows if r["id"] not in covered]
    for at in range(0, len(rest) if len(rest) >= 3 else 0, p.cluster_uncovered_chunk):
        try:
            out += call(rest[at : at + p.cluster_uncovered_chunk])
        except Limited:
            break
    return out


def grouped(clusters: list, merge: Merge) -> list:
    """Clusters joined as a model groups them, under the longest title, in the place of the first; numbers that it makes up or repeats are left out. A model that fails changes nothing."""
    try:
        groups = merge(clusters)
    except Exception:
        return clusters
    first: dict[int, int] = {}
    for group in groups:
        own = [k for k in dict.fromkeys(group) if 0 <= k < len(clusters) and k not in first]
        first |= dict.fromkeys(own, min(own, default=0))
    out: dict[int, tuple[str, list[str]]] = {}
    for k, c in enumerate(clusters):
        at = first.get(k, k)
        t, ids = out.get(at, ("", []))
        out[at] = (t if len(t) >= len(c[0]) else c[0], union(ids, c[1]))
    return list(out.values())


def chunked(clusters: list, rows: list[dict], p: Params) -> list:
    """What a refiner that changes nothing makes of the seeds: each as it is; long ones in overlapping chunks, in the articles' order, with the seed's title."""
    place = {r["id"]: k for k, r in enumerate(rows)}
    out = []
    for t, ids in clusters:
        if len(ids) <= p.cluster_seed_chunk:
            out.append((t, ids))
            continue
        ids = sorted((i for i in ids if i in place), key=place.__getitem__)
        parts = (ids[k : k + p.cluster_seed_chunk] for k in range(0, len(ids), max(1, p.cluster_seed_chunk - p.cluster_seed_overlap)))
        out += [(t, part) for part in parts if len(part) >= 2]
    return out
