import pytest
from pyspark.sql import functions as F

from tidewell import dims, params
from tidewell.functions import digest, hashing, images, text, times, titles, topics, urls


@pytest.fixture(scope="module")
def one(spark):
    """The value of an expression over texts."""

    def run(expr, *texts):
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{k} string" for k in range(len(texts))))
        return df.select(expr(*[F.col(f"c{k}") for k in range(len(texts))]).alias("v")).first()["v"]

    return run


def signed32(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return h


def base36(n):
    out = ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out or "0"


@pytest.mark.parametrize("s", ["", "a", "hello world", "Zürich", "x" * 300, "Some | Title – here"])
def test_short_hash(one, s):
    assert one(hashing.short_hash, s) == base36(abs(signed32(s)))


def test_tokens(one):
    assert one(text.tokens, "The Wörld's https://x.y/z NEW gold-rush of 2024!") == ["rld", "gold", "rush", "2024"]
    assert one(text.tokens, None) == []


def test_truncation_and_payload(one):
    assert one(lambda c: text.truncated(c, 5), "abcdef") == "ab..." and one(lambda c: text.truncated(c, 6), "abcdef") == "abcdef"
    assert one(text.payload, "a", " ", "b") == "a\n\nb" and one(text.slug, " Hello, World! ") == "hello-world"


def test_aggregator_links(one):
    import base64

    code = base64.urlsafe_b64encode(b"\x08\x13\x22\x20https://real.example/a?b=1\xd2\x01\x00").decode().rstrip("=")
    assert one(urls.decoded_aggregator_url, f"https://news.google.com/rss/articles/{code}?oc=5") == "https://real.example/a?b=1"
    assert one(urls.decoded_aggregator_url, "https://news.google.com/rss/articles/%%%") is None and one(urls.decoded_aggregator_url, "https://a.example/") is None


def test_urls(one):
    assert one(urls.origin_and_path, "HTTP://A.example:80?q=1") == "http://a.example/" and one(urls.origin_and_path, "https://a.example:8080/P#f") == "https://a.example:8080/P"
    assert one(urls.host, "junk") is None and one(urls.url_component, "a b~(c)'!*") == "a%20b~(c)'!*"


def test_titles_and_images(one):
    assert one(titles.clean, "Hail ruins late barley crop | The Farmer") == "Hail ruins late barley crop" and one(titles.clean, "Tea | Milk") == "Tea | Milk"
    assert one(lambda c: images.picked(F.lit("junk"), c), "https://ichef.bbci.co.uk/news/624/x.jpg").endswith("/news/976/x.jpg")


def test_keywords(one):
    ai = lambda c: topics.matches(c, "Artificial Intelligence")
    assert one(ai, "the AI boom") and not one(ai, "he said so") and one(lambda c: topics.keyword_score(c, "Sports").cast("int"), "a game and a match, game") == 2
    assert one(lambda c: topics.matches(c, "Gardening"), "my GARDENING page")


def test_digest(one):
    assert one(digest.json_text, 'so: {"a": 1} end') == '{"a": 1}' and one(digest.json_text, "none") is None
    assert not one(digest.cacheable, " Summary not available ") and one(digest.cacheable, "x")
    assert one(lambda c: digest.summary_key("article", c), " ") == "Summary-v1-article-unknown"


def test_ages(one):
    at = lambda c: c.cast("timestamp_ntz")
    assert one(lambda a, b: times.age_label(at(a), at(b)), "2024-01-01 00:00:00", "2024-01-01 00:30:00") == "30m"
    assert one(lambda a, b: times.recency_weight(at(a), at(b)), "2024-01-02 00:00:00", "2024-01-01 00:00:00") == 1.0


def test_parameters():
    p = params.from_env({"PRECLUSTER_THRESHOLD": "0.5", "NEWS_GLOBAL_LIMIT": "12abc", "CLUSTER_LLM_MERGE": "off", "FEED_BLOCKLIST": "  ", "CLUSTER_DISPLAY_CAP": "x"})
    assert (p.precluster_threshold, p.news_global_limit, p.cluster_llm_merge, p.feed_blocklist, p.cluster_display_cap) == (0.5, 12, False, "", 50)


def test_dimensions(spark):
    assert dims.topic_keywords(spark).count() == sum(map(len, dims.TOPIC_KEYWORDS.values())) and dims.category_alias(spark).where("category_lc = 'world news'").count() == 1
