"""Merges of clusters, whose outcome depends on their order, in rounds of joins.

In order, each cluster takes in the later ones that are near it as it has grown so far. A round settles everything that no open question comes before: a cluster
that no earlier one can still take in is a base; a base takes what is near it whatever else it takes, as long as no earlier base may still take that; what can't be
near it any more is struck out. So rounds follow the longest chain of such questions, not the number of clusters, and every step is a join or an aggregate:
neither an edition nor the clusters around one name lie in one task. The clusters are those of `greedy`, which states the passes one cluster after the other.

Clusters are (edition, cluster_key, cluster_title, article_ids), in the order of cluster_key; ids count once in a cluster. Results are numbered from 0 in each edition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entities import cluster_text, entities
from ..functions.text import doc_text, title_tokens
from ..params import Params
from ..sources.scratch import saved
from . import tfidf
from .numbering import components, numbered
from .stories import near_sets


def keyed(clusters: DataFrame) -> DataFrame:
    """(c, edition, title, ids): c numbers the clusters of all editions in their order."""
    rows = clusters.orderBy("edition", "cluster_key").select("edition", F.coalesce("cluster_title", F.lit("")).alias("title"), F.array_distinct("article_ids").alias("ids"))
    return saved(rows.select(F.monotonically_increasing_id().alias("c"), "*"))


def chunked(clusters: DataFrame, articles: DataFrame, p: Params = Params()) -> DataFrame:
    """Clusters of many articles in overlapping chunks, in the articles' order, each with the cluster's title; the others as they are. Keys keep the order."""
    long, key = F.size("article_ids") > p.cluster_seed_chunk, F.col("cluster_key") * (1 << 20)
    each = clusters.where(long).select("edition", "cluster_key", "cluster_title", F.explode("article_ids").alias("id")).join(articles.select("edition", "id", "ord"), ["edition", "id"])
    lists = each.groupBy("edition", "cluster_key", "cluster_title").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(max(1, p.cluster_seed_chunk - p.cluster_seed_overlap)))
    parts = lists.select("edition", key.alias("key"), "cluster_title", F.posexplode(F.transform(starts, lambda k: F.slice("ids", k, p.cluster_seed_chunk))).alias("part", "article_ids"))
    parts = parts.where(F.size("article_ids") >= 2).select("edition", (F.col("key") + F.col("part")).alias("cluster_key"), "cluster_title", "article_ids")
    return clusters.where(~long).select("edition", key.alias("cluster_key"), "cluster_title", "article_ids").unionByName(parts)


def gathered(own: DataFrame, owner: DataFrame) -> DataFrame:
    """The clusters that are left when each c of owner (c, base) has gone to its base: the longest title, the first of equals, and all ids in order."""
    named = own.join(owner, "c", "left").withColumn("base", F.coalesce("base", "c"))
    titles = named.groupBy("edition", "base").agg(F.max(F.struct(F.length("title").alias("n"), -F.col("c"), "title"))["title"].alias("cluster_title"))
    first = named.select("base", "c", F.posexplode("ids").alias("pos", "id")).groupBy("base", "id").agg(F.min(F.struct("c", "pos")).alias("at"))
    lists = first.groupBy("base").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("article_ids"))
    out = titles.join(lists, "base", "left").withColumn("article_ids", F.coalesce("article_ids", F.array().cast("array<string>")))
    return numbered(out, ["edition"], ["base"], "cluster_key").select("edition", "cluster_key", "cluster_title", "article_ids")


Judge = Callable[[DataFrame, DataFrame], DataFrame]


def settled(alive: DataFrame, judge: Judge) -> DataFrame:
    """(c, base) from pairs (i, j, ...) that may be near, i before j.

    judge gets the pairs with `open` (an earlier cluster may still take i, or take j before i can) and `base` (none may still take i), and the owners so far; it answers (i, j, take)
    for the pairs that it can decide. Of the first pair that is left it always can, so rounds end.
    """
    spark = alive.sparkSession
    owner, alive = spark.createDataFrame([], "c long, base long"), saved(alive)
    while not alive.isEmpty():
        first = alive.groupBy("j").agg(F.min("i").alias("first"))
        pairs = alive.join(first.select(F.col("j").alias("i"), F.lit(False).alias("base")), "i", "left").withColumn("base", F.coalesce("base", F.lit(True)))
        decided = saved(judge(pairs.join(first, "j").withColumn("open", ~F.col("base") | (F.col("first") < F.col("i"))).drop("first"), owner))
        taken = decided.where("take").select(F.col("j").alias("c"), F.col("i").alias("base"))
        owner = saved(owner.unionByName(taken))
        gone = taken.select("c")
        left = alive.join(decided.select("i", "j"), ["i", "j"], "left_anti")
        alive = saved(left.join(gone.withColumnRenamed("c", "j"), "j", "left_anti").join(gone.withColumnRenamed("c", "i"), "i", "left_anti"))
    return owner


def _bases(members: DataFrame, owner: DataFrame, wanted: DataFrame) -> DataFrame:
    """members with the base that they belong to by now, of the bases wanted (i)."""
    return members.join(owner, "c", "left").withColumn("i", F.coalesce("base", "c")).drop("base").join(wanted.select("i").distinct(), "i", "left_semi")


def merged_by_overlap(clusters: DataFrame, jaccard: float = 0.4) -> DataFrame:
    """A cluster is near if the ids that it has in common with the base's own, over all ids of both as the base has grown, are at least `jaccard` > 0.

    A base only grows, so a pair that fails with what it has before j fails for good, and one that passes with everything before j taken in passes in any case.
    """
    own = keyed(clusters)
    members = own.select("c", "edition", F.explode("ids").alias("id"))
    a, b = members.select("edition", "id", F.col("c").alias("i")), members.select("edition", "id", F.col("c").alias("j"))
    sizes = own.select("c", F.size("ids").alias("n"))
    pairs = a.join(b, ["edition", "id"]).where("i < j").groupBy("i", "j").agg(F.count("*").alias("common"))
    pairs = pairs.join(sizes.select(F.col("c").alias("i"), F.col("n").alias("ni")), "i").join(sizes.select(F.col("c").alias("j"), F.col("n").alias("nj")), "j")
    alive = pairs.where(F.col("common") / (F.col("ni") + F.col("nj") - F.col("common")) >= jaccard).select("i", "j", "common")

    def judge(ready: DataFrame, owner: DataFrame) -> DataFrame:
        ready = saved(ready.where("base"))
        mine = _bases(members.select("c", "id"), owner, ready).groupBy("i", "id").agg(F.min("c").alias("at"))  # where a base's ids come from first
        theirs = ready.select("i", "j").join(members.select(F.col("c").alias("j"), "id"), "j")
        alone = theirs.join(mine, ["i", "id"], "left").where(F.coalesce(F.col("at") > F.col("j"), F.lit(True))).groupBy("i", "j").agg(F.count("*").alias("alone"))
        fresh = mine.unionByName(theirs.select("i", "id", F.col("j").alias("at"))).groupBy("i", "id").agg(F.min("at").alias("at")).groupBy("i", "at").agg(F.count("*").alias("fresh"))
        held = mine.groupBy("i", "at").agg(F.count("*").alias("held"))
        places = ready.select("i", F.col("j").alias("at")).unionByName(held.select("i", "at")).join(held, ["i", "at"], "left").join(fresh, ["i", "at"], "left")
        so_far = Window.partitionBy("i").orderBy("at")
        sums = places.select("i", F.col("at").alias("j"), F.sum(F.coalesce("held", F.lit(0))).over(so_far).alias("size"), F.sum(F.coalesce("fresh", F.lit(0))).over(so_far).alias("all"))
        told = ready.join(sums, ["i", "j"]).join(alone, ["i", "j"], "left").na.fill(0, ["alone"])
        told = told.withColumn("take", (F.col("common") / F.col("all") >= jaccard) & ~F.col("open"))
        return told.where(F.col("take") | (F.col("common") / (F.col("size") + F.col("alone")) < jaccard)).select("i", "j", "take")

    return gathered(own, settled(alive, judge))


def merged_by_entity(clusters: DataFrame, articles: DataFrame, p: Params = Params()) -> DataFrame:
    """A cluster is near if it has enough names in common with the base's own and its articles are like the base's: the mean cosine of the first pairs of both, as the base has grown.

    What a base is judged by are its first articles, `similarity_sample` at most. Until it has so many, it takes in one cluster a round that adds to them; from then on all at once.
    Pairs that aren't near before the first that is are struck out of any cluster, base or not yet, as nothing can change what it is judged by before them.
    """
    own, sample = keyed(clusters), p.similarity_sample
    doc = F.concat_ws(":", "edition", "id").alias("doc")
    known = articles.select("edition", "id", "title", doc_text(F.col("title"), F.col("description"), F.col("content")).alias("text"))
    listed = own.select("c", "edition", F.posexplode("ids").alias("pos", "id")).join(known.select("edition", "id", "title"), ["edition", "id"]).select("c", "pos", doc, "edition", "id", "title")
    listed = saved(listed)
    heads = listed.where((F.col("pos") < 10) & F.col("title").isNotNull()).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("titles"))
    told = own.join(heads, "c", "left").select("c", "edition", entities(cluster_text(F.col("title"), F.coalesce("titles", F.array().cast("array<string>")))).alias("names"))
    names = told.select("c", "edition", F.explode(F.filter("names", lambda e: F.length(e) >= p.cluster_entity_min_length)).alias("name"))
    alive = sharing_names(names, p.cluster_entity_min_shared)
    texts = known.join(listed.select("edition", "id").distinct(), ["edition", "id"], "left_semi").select("edition", doc, "text")
    units = saved(tfidf.unit(saved(tfidf.weights(texts, "doc", F.col("text"), within=["edition"])), "doc").select("doc", "term", "u"))
    place = F.row_number().over(Window.partitionBy("c").orderBy("pos")) - 1
    members = saved(listed.select("c", place.alias("pos"), "doc"))
    counts = members.groupBy(F.col("c").alias("j")).agg(F.count("*").alias("nj"))
    others = members.where(F.col("pos") < sample).select(F.col("c").alias("j"), F.col("pos").alias("pj"), F.col("doc").alias("y"))

    def judge(ready: DataFrame, owner: DataFrame) -> DataFrame:
        ready = saved(ready)
        held = _bases(members, owner, ready).groupBy("i", "doc").agg(F.min(F.struct("c", "pos")).alias("at"))
        rank = F.row_number().over(Window.partitionBy("i").orderBy("at"))
        held = saved(held.withColumn("pi", rank - 1).where(F.col("pi") < sample).select("i", "pi", "doc"))
        few = held.groupBy("i").agg(F.count("*").alias("ni")).where(F.col("ni") < sample)
        met = ready.select("i", "j").join(counts, "j").join(held.withColumnRenamed("doc", "x"), "i").where(F.col("pi") * F.col("nj") < sample).join(others, "j")
        met = met.where(F.col("pi") * F.col("nj") + F.col("pj") < sample).select("i", "j", "x", "y")
        left, right = units.select(F.col("doc").alias("x"), "term", F.col("u").alias("ux")), units.select(F.col("doc").alias("y"), "term", F.col("u").alias("uy"))
        dots = met.select("x", "y").distinct().join(left, "x").join(right, ["y", "term"]).groupBy("x", "y").agg(F.sum(F.col("ux") * F.col("uy")).alias("dot"))
        means = met.join(dots, ["x", "y"], "left").groupBy("i", "j").agg(F.avg(F.coalesce("dot", F.lit(0.0))).alias("sim"))
        adds = ready.select("i", "j").join(few.select("i"), "i").join(members.select(F.col("c").alias("j"), "doc"), "j").join(held.select("i", "doc"), ["i", "doc"], "left_anti").select("i", "j").distinct()
        seen = ready.join(means, ["i", "j"], "left").join(adds.withColumn("adds", F.lit(True)), ["i", "j"], "left")
        seen = seen.select("i", "j", "open", (F.coalesce("sim", F.lit(0.0)) >= p.cluster_entity_min_coherence).alias("near"), F.coalesce("adds", F.lit(False)).alias("adds"))
        stop = F.min(F.when(F.col("near") & (F.col("open") | F.col("adds")), F.col("j"))).over(Window.partitionBy("i"))
        seen = seen.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("j") <= F.col("stop")))
        return seen.withColumn("take", F.col("near") & ~F.col("open")).where(F.col("take") | ~F.col("near")).select("i", "j", "take")

    return gathered(own, settled(alive, judge))


def sharing_names(names: DataFrame, least: int) -> DataFrame:
    """(i, j), i < j, of clusters of one edition with so many names in common: they share one outside the least - 1 most frequent names of each, so those needn't meet."""
    rate = names.groupBy("edition", "name").agg(F.count("*").alias("df"))
    lists = names.join(rate, ["edition", "name"]).groupBy("c", "edition").agg(F.array_sort(F.collect_list(F.struct("df", "name"))).alias("s"))
    lists = saved(lists.select("c", "edition", F.transform("s", lambda x: x["name"]).alias("s")).where(F.size("s") >= least))
    head = lists.select("c", "edition", F.explode(F.slice("s", F.lit(1), F.size("s") - (least - 1))).alias("name"))
    a, b = head.select("edition", "name", F.col("c").alias("i")), head.select("edition", "name", F.col("c").alias("j"))
    pairs = a.join(b, ["edition", "name"]).where("i < j").select("i", "j").distinct()
    pairs = pairs.join(lists.select(F.col("c").alias("i"), F.col("s").alias("si")), "i").join(lists.select(F.col("c").alias("j"), F.col("s").alias("sj")), "j")
    return pairs.where(F.size(F.array_intersect("si", "sj")) >= least).select("i", "j")


def merged_by_title(clusters: DataFrame, threshold: float = 0.7) -> DataFrame:
    """A cluster is near if its title's words are like those of the title that has won so far; the longer one wins.

    The winner is always some cluster's own title, so whatever happens stays within a connected group of like titles. The groups go on side by side, each with its first cluster left
    as the base. It takes in all that are near up to the first whose title wins with other words, and goes on with that; without such a one it is done.
    """
    own = keyed(clusters)
    titled = own.select("c", "edition", F.length("title").alias("len"), F.array_sort(title_tokens(F.col("title"))).alias("words")).where(F.size("words") > 0)
    node = titled.groupBy("edition", "words").agg(F.min("c").alias("node"))
    sets = node.select(F.col("node").alias("cluster_key"), F.explode(F.transform("words", lambda w: F.concat_ws(":", "edition", w))).alias("word"))
    near = near_sets(sets, "word", threshold).select("a", "b")
    edges = saved(near.unionAll(near.select("b", "a")).unionAll(node.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    placed = titled.join(node, ["edition", "words"]).join(components(edges), "node").select("c", "comp", "node", "len")
    several = lambda rows: rows.join(rows.groupBy("comp").agg(F.count("*").alias("k")).where("k > 1").select("comp"), "comp", "left_semi")
    left, state, owner = saved(several(placed)), None, own.sparkSession.createDataFrame([], "c long, base long")
    while True:
        if state is None or state.isEmpty():
            left = saved(several(left))
            if left.isEmpty():
                return gathered(own, owner)
        idle = left.join(state.select("comp"), "comp", "left_anti") if state is not None else left
        start = idle.groupBy("comp").agg(F.min(F.struct("c", "node", "len")).alias("s")).select("comp", F.col("s.c").alias("i"), F.col("s.node").alias("own"), F.col("s.len").alias("most"), F.col("s.c").alias("at"))
        now = saved(start.unionByName(state) if state is not None else start)
        rest = left.join(now.select(F.col("i").alias("c")), "c", "left_anti")
        met = saved(now.join(edges.select(F.col("a").alias("own"), F.col("b").alias("node")), "own").join(rest, ["comp", "node"]).where(F.col("c") > F.col("at")))
        # The first that wins with other words is the first of its length, and no longer title comes before it: told from the first places of each length.
        firsts = met.groupBy("comp", "most", "len").agg(F.min("c").alias("any"), F.min(F.when(F.col("node") != F.col("own"), F.col("c"))).alias("other"))
        longer = F.min("any").over(Window.partitionBy("comp").orderBy(F.desc("len")))
        stop = firsts.withColumn("longer", longer).where((F.col("len") > F.col("most")) & (F.col("other") <= F.col("longer"))).groupBy("comp").agg(F.min("other").alias("stop"))
        taken = saved(met.join(stop, "comp", "left").where(F.col("stop").isNull() | (F.col("c") <= F.col("stop"))).select("comp", "c", F.col("i").alias("base"), "node", "len", "stop"))
        state = saved(taken.where("c = stop").select("comp", F.col("base").alias("i"), F.col("node").alias("own"), F.col("len").alias("most"), F.col("c").alias("at")))
        owner = saved(owner.unionByName(taken.select("c", "base")))
        left = saved(rest.join(taken.select("c"), "c", "left_anti"))
