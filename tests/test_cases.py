"""Cases of single rows that the tables don't hold."""

from pyspark.sql import functions as F

from tidewell.functions import digest, images, titles, urls
from tidewell.operators import ingest, page, state, stories

HOST_ROWS = [
    (1, "https://news.google.com/rss/articles/q1", "Coast News", "https://www.coast.example/front", "coast.example"), (2, "https://www.farmer.example/barley", "The Farmer", "", "farmer.example"),
    (3, "https://news.google.com/q2", "Coast News", "https://news.google.com/rss/articles/q1", "news.google.com:coast news"), (4, "no address", "Isle", "none either", ""), (5, "https://WWW.ISLE.EXAMPLE/a", "Isle", "https://WWW.ISLE.EXAMPLE", "isle.example"),
]

IMG_ROWS = [
    (1, '<p><img src="https://a.example/x.png" width="640" height=480></p>', "https://a.example/x.png", 640, 480), (2, "<img alt='no source'><img src='https://b.example/y.png'>", None, None, None),
    (3, "<IMG class='c' SRC='https://c.example/z.png' />", "https://c.example/z.png", None, None), (4, "plain", None, None, None), (5, None, None, None, None),
]

IMAGE_ROWS = [
    (1, "https://ichef.bbci.co.uk/ace/standard/240/cps/a.jpg", "https://ichef.bbci.co.uk/ace/standard/976/cps/a.jpg", 240, None, False), (2, "https://ichef.bbci.co.uk/news/624/x.jpg", "https://ichef.bbci.co.uk/news/976/x.jpg", 624, None, True),
    (3, "https://ichef.bbci.co.uk/images/ic/320x180/p.jpg", "https://ichef.bbci.co.uk/images/ic/976x976/p.jpg", 320, 180, False), (4, "https://i.guim.co.uk/img/m.jpg?width=140&quality=85", "https://i.guim.co.uk/img/m.jpg?width=140&quality=85", 140, None, False),
    (5, "https://techmeme.com/i.jpg", "https://techmeme.com/i.jpg", 120, None, False), (6, "https://img.example.com/a.jpg?width=9", "https://img.example.com/a.jpg?width=9", None, None, True),
]

TITLE_ROWS = [
    (1, "Harbour-Lindqvist leaves as Tarn coach – Coast News", "Harbour-Lindqvist leaves as Tarn coach", None), (2, "Hail ruins late barley crop | The Farmer", "Hail ruins late barley crop", None),
    (3, "Ferry line adds 12 ships for summer – Isle News | Travel", "Ferry line adds 12 ships for summer", None), (4, "Up – down days", "Up – down days", None), (5, "Tea | Milk", "Tea | Milk", None), (6, "", "", None),
    (7, "9/9: Monday Evening – DAILY > Town News", "9/9: Monday Evening", None), (8, "Headline - Part two - The Paper", "Headline - Part two - The Paper", "The Paper"), (9, " - x", " - x", None),
]

SOURCE_ROWS = [(1, "BBC", "t - x", "feed", "BBC"), (2, "Google News", "Big story - Reuters", "feed", "Reuters"), (3, "https://www.cnn.com/a", "Big story", "feed", "Cnn"), (4, None, "Big story - AP", "Google News", "AP"), (5, "Google News", "Big story", "feed", "Google News")]

#: Failures by feed, in minutes of the day: two, a pause and a third; three and one within the pause; three and one after it; three long ago; one.
FAILURE_ROWS = [("late third", [0, 5, 595]), ("within", [560, 570, 575, 590]), ("after", [480, 485, 490, 580]), ("long ago", [0, 1, 2]), ("one", [3]), ("exactly", [10, 20, 30, 60, 61])]

JSON_ROWS = [(1, '{"lede": " L. ", "takeaways": ["a", " b ", "", "c", "d"]}', "L.", "a|b|c"), (2, "One. Two! Three? Four.", "One.", "Two!|Three?"), (3, "", "", ""), (4, None, "", ""), (5, "{bad json. Yes.", "{bad json.", "Yes.")]

ERROR_ROWS = [(1, "Error 429: slow down", None, None, True), (2, "Spend Limit hit", None, None, True), (3, "x", "rate_limit_exceeded", None, True), (4, "x", None, 429, True), (5, "invalid api key", None, 403, False), (6, None, None, None, False)]
FEED_TITLES = [(1, "The Title", "About", "https://a.example/f"), (2, "", "About", "https://a.example/f"), (3, None, None, "https://www.b.example/f"), (4, "", "", "junk")]


def got(spark, rows, schema, *columns):
    """The values of columns over rows, by their first one."""
    df = spark.createDataFrame(rows, schema)
    return {r[0]: tuple(r)[1:] for r in df.select(df.columns[0], *columns).collect()}


def test_hosts(spark):
    out = got(spark, [r[:4] for r in HOST_ROWS], "k int, url string, name string, source string", urls.resolved_host(F.col("url"), F.col("source"), F.col("name")))
    assert out == {r[0]: (r[4],) for r in HOST_ROWS}


def test_first_images(spark):
    i = images.first_img(F.col("html"))
    assert got(spark, [r[:2] for r in IMG_ROWS], "k int, html string", i["src"], i["width"], i["height"]) == {r[0]: r[2:] for r in IMG_ROWS}


def test_sizes_of_images(spark):
    url = F.col("url")
    d = images.inferred_dims(url)
    out = got(spark, [r[:2] for r in IMAGE_ROWS], "k int, url string", images.normalized(url), d["width"], d["height"], images.large_enough(d["width"], d["height"], 320, 200))
    assert out == {r[0]: r[2:] for r in IMAGE_ROWS}


def test_titles_and_publishers(spark):
    c = F.col("title")
    assert got(spark, [r[:2] for r in TITLE_ROWS], "k int, title string", titles.clean(c), titles.publisher(c)) == {r[0]: r[2:] for r in TITLE_ROWS}
    out = got(spark, [r[:4] for r in SOURCE_ROWS], "k int, name string, title string, feed string", titles.source_name(F.col("name"), F.col("title"), F.col("feed")))
    assert out == {r[0]: (r[4],) for r in SOURCE_ROWS}
    out = got(spark, FEED_TITLES, "k int, name string, about string, url string", titles.feed_title(F.col("name"), F.col("about"), F.col("url")))
    assert out == {1: ("The Title",), 2: ("About",), 3: ("www.b.example",), 4: ("Unknown Source",)}


def test_pauses_of_breakers(spark):
    """As one after the other would have it, at ten o'clock."""
    rows = [(feed, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00") for feed, ms in FAILURE_ROWS for m in ms]
    at = spark.createDataFrame(rows, "feed string, moment string").select("feed", F.col("moment").cast("timestamp").alias("ts"))
    out = {r["feed"]: (r["failures"], r["skip"]) for r in state.breaker(at, "feed", "ts", F.lit(True), F.lit("2024-01-01 10:00:00").cast("timestamp")).collect()}
    want = {}
    for feed, ms in FAILURE_ROWS:
        n, last = 0, None
        for m in ms:
            if n < 3:
                n, last = n + 1, m
            elif m - last >= 30:
                n, last = 1, m
        want[feed] = (0, False) if n >= 3 and 600 - last >= 30 else (n, n >= 3)
    assert out == want


def test_digests(spark):
    d = digest.parsed(F.col("s"))
    assert got(spark, [r[:2] for r in JSON_ROWS], "k int, s string", d["lede"], F.array_join(d["takeaways"], "|")) == {r[0]: r[2:] for r in JSON_ROWS}


def test_limits_told_by_errors(spark):
    out = got(spark, [r[:4] for r in ERROR_ROWS], "k int, message string, code string, status int", page.is_rate_limit(F.col("message"), F.col("code"), F.col("status")))
    assert out == {r[0]: (r[4],) for r in ERROR_ROWS}


def test_clusters_of_a_model(spark):
    rows = [(1, "t", ["a", "b"]), (2, "", ["a", "b"]), (3, "t", ["a"]), (4, None, None)]
    assert got(spark, rows, "k int, title string, ids array<string>", page.is_valid_cluster(F.col("title"), F.col("ids"))) == {1: (True,), 2: (False,), 3: (False,), 4: (False,)}
    own = spark.createDataFrame([(0, ["a", "b"]), (1, ["b", "c"]), (2, ["d"]), (3, ["e", "a"])], "cluster_key int, article_ids array<string>")
    joined = stories.apply_groups(own, spark.createDataFrame([(0, 0), (0, 3)], "group int, cluster_key int"))
    assert {r["group"]: r["ids"] for r in joined.collect()} == {0: ["a", "b", "e"], -2: ["b", "c"], -3: ["d"]}


def test_cells_of_a_grid(spark):
    rows = [(f"{c}{i}{r}", c, i, 1.5 if r else 1.0) for c in range(1, 5) for i in range(c) for r in range(2)]
    out = got(spark, rows, "k string, c long, i long, r double", page.grid_cell(F.col("c"), F.col("i"), F.col("r"), F.col("r")))
    assert [out[k][0] for k in ("100", "200", "201", "300", "301", "310", "311", "400")] == ["2x2", "1x2", "2x1", "1x2", "2x1", "1x1", "1x1", "1x1"]


def test_lookups_of_feeds(spark):
    """One lookup minds the case, the other doesn't; a source without categories has none."""
    rows = [("a", "Technology", "u1", 1), ("a", "World", "u0", 0), ("b", "technology", "u2", 0), ("c", None, "u3", 0)]
    out = {r["source_key"]: (r["has_feed"], r["has_category"], r["urls"]) for r in ingest.lookups(spark.createDataFrame(rows, "source_key string, category string, url string, ord int"), "Technology").collect()}
    assert out == {"a": (True, True, ["u0", "u1"]), "b": (True, False, ["u2"]), "c": (False, False, ["u3"])}
