from pyspark.sql import functions as F

from tidewell import dims
from tidewell.functions.text import doc_text
from tidewell.operators import stories, tfidf
from tidewell.plans.stories import Model, ranked_stories

TEXTS = [
    "Olympic Committee opens Winter Games in Paris with skating gold", "Winter Games skating gold for Olympic Committee favourite in Paris", "Olympic Committee praises Winter Games skating gold",
    "Storm Ciara floods Dublin harbour and closes schools", "Dublin harbour floods as Storm Ciara closes schools", "Parliament votes on budget", "Olympic Committee and Winter Games costs worry Paris council",
    "Paris council asks Olympic Committee about Winter Games costs",
]


def articles(spark, editions=2):
    rows = [(e, f"{e}-{k}", t, t, f"https://site{k}.example/{e}/{k}", "Politics", k) for e in range(editions) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "edition long, id string, title string, description string, url string, category string, ord long")
    at = F.timestamp_add("MINUTE", F.col("ord").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return df.select("*", F.lit("").alias("content"), F.lit("Site").alias("source_name"), F.lit("").alias("source_url"), at.alias("published_at"), F.lit("").alias("url_to_image"), F.lit(0).alias("image_width"), F.lit(0).alias("image_height"))


def test_editions_stay_apart(spark):
    out = ranked_stories(articles(spark), dims.category_meta(spark), F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")).collect()
    assert out and {r["edition"] for r in out} == {0, 1}
    own = {r["id"]: r["edition"] for r in out}
    for r in out:
        assert {i.split("-")[0] for i in r["article_ids"]} == {str(r["edition"])}
        assert all(own[x] == r["edition"] for x in r["related_ids"] or [])
        assert r["label"] == "National Politics" and r["n"] >= 2
    assert sorted(r["rank"] for r in out if r["edition"] == 0) == list(range(1, len(out) // 2 + 1))


def test_links_go_both_ways(spark):
    rows = articles(spark, 1)
    members = spark.createDataFrame([(1, 0, "0-0"), (1, 1, "0-1"), (2, 0, "0-6"), (2, 1, "0-7"), (3, 0, "0-3"), (3, 1, "0-4")], "cluster_key long, pos long, id string")
    clusters = spark.createDataFrame([(1, "Winter Games in Paris", ["0-0", "0-1"]), (2, "Costs of the Winter Games", ["0-6", "0-7"]), (3, "Storm Ciara", ["0-3", "0-4"])], "cluster_key long, cluster_title string, article_ids array<string>")
    assert {(r["cluster_key"], r["related_key"]) for r in stories.related(clusters, members, rows).collect()} == {(1, 2), (2, 1)}


def test_cosine_pairs_match_all_pairs(spark):
    rows = articles(spark, 1)
    postings = tfidf.weights(rows, "id", doc_text(F.col("title"), F.col("description"), F.col("content")))
    u = tfidf.unit(postings, "id")
    a, b = u.select(F.col("id").alias("a"), "term", F.col("u").alias("x")), u.select(F.col("id").alias("b"), "term", F.col("u").alias("y"))
    plain = {(r["a"], r["b"]): r["s"] for r in a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect()}
    for threshold in (0.1, 0.4, 0.8):
        got = {(r["a"], r["b"]): r["sim"] for r in tfidf.cosine_pairs(postings, "id", threshold).collect()}
        assert got.keys() == {p for p, s in plain.items() if s >= threshold} and all(abs(got[p] - plain[p]) < 1e-9 for p in got)


def test_a_model_in_the_plan(spark):
    """Seeds renamed, articles that no seed has gathered, and severity judged for what is unclear, then ranked anew."""
    rows = articles(spark, 1).withColumn("category", F.lit("World News"))
    asked = []

    def refine(part):
        return [(f"Story {len(part)} {part[0]['title']}", [r["id"] for r in part])]

    def assess(unclear):
        asked.append({(r["label"], r["ambiguous"]) for r in unclear.collect()})
        return unclear.where(F.contains("cluster_title", F.lit("Storm"))).select("cluster_key", F.lit(5).alias("level"), F.lit("War/Conflict").alias("label"))

    as_of, meta = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"), dims.category_meta(spark)
    plain = {frozenset(r["article_ids"]): r for r in ranked_stories(rows, meta, as_of).collect()}
    told = {frozenset(r["article_ids"]): r for r in ranked_stories(rows, meta, as_of, model=Model(refine=refine, assess=assess)).collect()}
    assert asked == [{("Other", True)}]
    storm = next(ids for ids, r in told.items() if "Storm" in r["cluster_title"])
    assert told[storm]["label"] == "War/Conflict" and plain[storm]["label"] == "Other"
    assert told[storm]["score"] > plain[storm]["score"]


def test_expansion_keeps_what_the_time_allows(spark):
    """Like articles at both ends of the window, beyond it, and without a time; a cluster without times meets all."""
    text = "Winter Games skating gold in Paris"
    times = ["2024-01-10 00:00:00", "2024-01-08 00:00:00", "2024-01-07 23:59:59", "2024-01-12 00:00:00", "2024-01-12 00:00:01", None, "2024-03-01 00:00:00", None]
    rows = spark.createDataFrame([(str(k), text, at, "Sports", k) for k, at in enumerate(times)], "id string, title string, at string, category string, ord long").withColumn("published_at", F.col("at").cast("timestamp_ntz"))
    postings = tfidf.weights(rows, "id", F.col("title"))
    members = spark.createDataFrame([(1, 0, "0"), (2, 0, "7")], "cluster_key long, pos long, id string")
    got = {(r["cluster_key"], r["id"]) for r in stories.expanded(members, rows, postings).collect()}
    assert got == {(1, i) for i in "1357"} | {(2, str(i)) for i in range(7)}
