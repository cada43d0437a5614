import json

from pyspark.sql import functions as F

from tidewell.fixtures import as_of
from tidewell.operators import state
from tidewell.sources import feeds, store

RSS = """<?xml version="1.0"?><rss><channel><title>Feed</title>
<item><title>Big story - The Paper</title><link>https://a.example/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>&lt;img src="https://i.example/x.png" width="640"&gt; text</description><source url="https://paper.example">The Paper</source></item>
<item><title>Second</title><guid>https://a.example/2</guid><pubDate>2024-01-01T11:00:00Z</pubDate></item>
</channel></rss>"""


def test_registry(spark, tmp_path):
    path = tmp_path / "feeds.json"
    path.write_text(json.dumps({"bbc": {"name": "BBC", "feeds": [{"id": "w", "category": "World", "url": "https://b.example"}]}}))
    row = feeds.registry(spark, str(path)).first()
    assert (row["source_key"], row["name"], row["feeds"][0]["category"]) == ("bbc", "BBC", "World")


def test_items_to_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    rows = feeds.items(spark, str(tmp_path / "a.xml"))
    out = feeds.to_articles(rows, F.lit("World"), F.lit("Google News"), F.lit("https://news.google.com/rss"), as_of().cast("timestamp")).orderBy("ord").collect()
    assert [(r["title"], r["source_name"], r["url"]) for r in out] == [("Big story", "The Paper", "https://a.example/1"), ("Second", "Google News", "https://a.example/2")]
    assert out[0]["url_to_image"] == "https://i.example/x.png" and out[0]["image_width"] == 640 and out[0]["id"].startswith("world-")
    assert [str(r["published_at"]) for r in out] == ["2024-01-01 10:00:00", "2024-01-01 11:00:00"] and out[0]["source_url"] == "https://paper.example"


def test_dates(spark):
    df = spark.createDataFrame([("Tue, 2 Jan 2024 03:04:05 +0100",), ("2024-01-02T03:04:05Z",), ("nonsense",), (None,)], "s string")
    assert [str(r[0]) for r in df.select(feeds.published(F.col("s"))).collect()] == ["2024-01-02 02:04:05", "2024-01-02 03:04:05", "None", "None"]


def test_decoded_links_from_a_table(spark):
    rows = spark.createDataFrame([("https://news.google.com/rss/articles/x", "https://news.google.com/a"), ("https://o.example/p", "")], "url string, source_url string")
    table = spark.createDataFrame([("https://news.google.com/rss/articles/x", "https://real.example/p")], "url string, real_url string")
    assert {(r["url"], r["source_url"]) for r in feeds.with_decoded_urls(rows, table).collect()} == {("https://real.example/p", "https://real.example"), ("https://o.example/p", "")}


def test_store(spark, tmp_path):
    path = str(tmp_path / "kv")
    t = lambda s: F.lit(s).cast("timestamp")
    old, new = store.KeyValue(spark, path, ["old:"]), store.KeyValue(spark, path, ["new:", "old:"])
    old.put(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), 3600, t("2024-01-01 00:00:00"))
    new.put(spark.createDataFrame([("a", "3")], "key string, value string"), 60, t("2024-01-01 00:00:00"), seq=1)
    read = lambda at: {r["key"]: r["value"] for r in new.get(t(at)).collect()}
    assert read("2024-01-01 00:00:30") == {"a": "3", "b": "2"} and read("2024-01-01 00:30:00") == {"a": "1", "b": "2"} and read("2024-01-01 02:00:00") == {}
    assert state.cleared(new.log(), "a").first()["deleted"] == 2
    new.clear("a", str(tmp_path / "kv2"))
    assert spark.read.parquet(str(tmp_path / "kv2")).count() == 1


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    for edition in ("2024-01-01", "2024-01-02"):
        store.write_snapshot(spark.createDataFrame([(edition,)], "story string"), path, edition)
    assert [r["story"] for r in store.latest_snapshot(spark, path).collect()] == ["2024-01-02"]


def test_namespaces():
    assert store.namespace({"CACHE_PREFIX": "x:"}) == "x:" and store.namespace({"NODE_ENV": "production", "VERCEL_ENV": "production"}) == "prod:"
    assert store.namespace({"VERCEL_ENV": "preview", "VERCEL_GIT_COMMIT_REF": "a/b"}) == "staging-a-b:" and store.namespace({}) == "local:"


BAD = """<?xml version="1.0" encoding="ISO-8859-1"?><rss xmlns:media="http://m" xmlns:content="http://c"><channel>
<item><title>Caf\u00e9 &nbsp;&amp; bar</title><media:thumbnail url="https://i.example/t.jpg" width="640" height="x"/><content:encoded><![CDATA[<b>&nbsp; one</item> two</b>]]></content:encoded><odd:thing>1</odd:thing></item>
<item><title>Broken <b>title</title></item>
<item><title>Also fine</title><enclosure url="https://i.example/e.png" type="image/png"/></item>
<item><title>Cut off"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom</title><link href="https://a.example/x"/><id>urn:1</id><updated>2024-01-01T00:00:00Z</updated><summary>s</summary></entry></feed>'


def test_every_item_is_read_or_quarantined(spark, tmp_path):
    """Items in = articles + rejects, whatever a file holds; a bad item spoils no other, and reruns give the same ids."""
    files = {"a.xml": RSS.encode(), "b.xml": BAD.encode("latin-1"), "c.xml": ATOM.encode(), "d.xml": b"\n", "e.xml": b"<!DOCTYPE html><html>blocked</html>", "f.xml": b"<rss><channel></channel></rss>", "g.xml": b'<?xml version="1.0" encoding="utf-8"?><item>\xff</item>', "h.xml": b'<?xml encoding="nonsense"?><item/>'}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    good, bad = feeds.quarantined(spark, str(tmp_path))
    got = {(r["feed_file"][-5:], r["item"]): r for r in good.collect()}
    rejected = {(r["feed_file"][-5:], r["item"]): r["reason"].split(":")[0] for r in bad.collect()}
    assert set(got) == {("a.xml", 0), ("a.xml", 1), ("b.xml", 0), ("b.xml", 2), ("c.xml", 0)}
    assert rejected == {("b.xml", 1): "malformed", ("b.xml", 3): "not closed", ("d.xml", -1): "empty", ("e.xml", -1): "a page, not a feed", ("f.xml", -1): "no items", ("g.xml", -1): "encoding", ("h.xml", -1): "encoding"}
    first, atom = got["b.xml", 0], got["c.xml", 0]
    assert first["title"] == "Caf\u00e9 \u00a0& bar" and first["content:encoded"] == "<b>&nbsp; one</item> two</b>" and first["media:thumbnail"].asDict() == {"_url": "https://i.example/t.jpg", "_width": 640, "_height": None}
    assert (atom["link"], atom["guid"], atom["isoDate"], atom["description"]) == ("https://a.example/x", "urn:1", "2024-01-01T00:00:00Z", "s") and got["b.xml", 2]["enclosure"]["_type"] == "image/png"
    articles = lambda rows: sorted((r["ord"], r["id"]) for r in feeds.to_articles(rows, F.lit("World"), F.lit("Paper"), F.lit("https://p.example"), as_of().cast("timestamp")).collect())
    once, again = articles(good), articles(feeds.items(spark, str(tmp_path)).repartition(7))
    assert once == again and len(once) == 5 and [i.rsplit("-", 1)[1] for _, i in once] == ["0", "1", "0", "2", "0"]


def test_outcomes_are_counted_while_reading(spark, tmp_path):
    """They equal a second scan's."""
    files = {"a.xml": RSS.encode(), "b.xml": BAD.encode("latin-1"), "c.xml": ATOM.encode(), "d.xml": b"\n", "e.xml": b"<!DOCTYPE html><html>blocked</html>", "f.xml": b"<rss><channel></channel></rss>", "g.xml": b'<?xml encoding="nonsense"?><item/>', "h.xml": b"<item><title>open"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    good, bad, counts = feeds.counted(spark, str(tmp_path))
    assert (counts["feeds"], counts["items"], counts["rejects"]) == (len(files), good.count(), bad.count())
    assert counts["feeds_ok"] == good.select("feed_file").distinct().count() == 3
    kinds = {r["k"]: r["count"] for r in bad.groupBy(F.split("reason", ":")[0].alias("k")).count().collect()}
    names = {"not closed": "not_closed", "malformed": "malformed", "encoding": "encoding", "empty": "empty", "a page, not a feed": "not_a_feed", "no items": "no_items"}
    assert {names[k]: n for k, n in kinds.items()} == {n: counts[n] for n in names.values() if counts[n]}
    failed = {r["feed_file"].rsplit("/", 1)[1]: r["reason"] for r in feeds.failed_feeds(good, bad).collect()}
    assert set(failed) == {"d.xml", "e.xml", "f.xml", "g.xml", "h.xml"} and failed["e.xml"] == "a page, not a feed" and failed["h.xml"] == "not closed"
