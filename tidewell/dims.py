"""Small dimension tables. They are parameters of the operators that use them; these are the defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Words that carry no topic.
STOPWORDS = """the a an of and or to in on for with at by from as that this these those is are was were be been being it its into about
after before over under up down out off than then but not no so just only more most less least new latest""".split()

# Topics and the keywords that hint at them, in order.
TOPIC_KEYWORDS = {
    "Crypto": ["crypto", "cryptocurrency", "bitcoin", "btc", "ethereum", "eth", "blockchain", "defi", "stablecoin", "web3", "nft", "solana", "binance", "coinbase"],
    "Artificial Intelligence": ["ai", "artificial intelligence", "gpt", "llama", "mistral", "claude", "openai", "anthropic", "xai", "deepmind", "groq"],
    "Social Media": ["twitter", "x.com", " x ", "facebook", "meta", "instagram", "tiktok", "snapchat", "youtube", "reddit", "social media"],
    "Technology": ["tech", "software", "hardware", "semiconductor", "chip", "gpu", "tpu", "iphone", "android", "cloud", "saas"],
    "Business": ["startup", "earnings", "ipo", "merger", "acquisition", "funding", "revenue", "valuation", "venture"],
    "Science": ["science", "research", "study", "paper", "experiment", "peer-reviewed", "arxiv"],
    "Climate": ["climate", "emissions", "carbon", "warming", "wildfire", "hurricane", "storm"],
    "Health": ["health", "covid", "vaccine", "disease", "who", "cdc"],
    "US Politics": ["congress", "senate", "house", "biden", "trump", "gop", "democrats", "republicans", "white house"],
    "World": ["israel", "gaza", "ukraine", "russia", "china", "europe", "asia", "africa", "middle east", "war", "conflict"],
    "Sports": ["soccer", "nfl", "nba", "mlb", "premier league", "match", "game"],
}
AMBIGUOUS_KEYWORDS = ["ai", "x", "gop", "cdc", "who", "ipo", "gpu", "tpu", "saas"]

# Feed categories that a topic of the page stands for.
CATEGORY_ALIASES = {
    "Artificial Intelligence": ["AI", "Artificial Intelligence"],
    "Technology": ["Technology"],
    "Business": ["Business"],
    "Science": ["Science"],
    "World": ["World", "World News"],
    "Politics": ["Politics", "US Politics"],
    "Climate": ["Environment", "Climate"],
    "Health": ["Health"],
    "Crypto": ["Crypto", "Cryptocurrency"],
}

# Categories whose severity is known; all others are ambiguous.
CATEGORY_META = {"Sports": (0, "Other"), "Technology": (1, "Tech/Business"), "Business": (2, "Economy/Markets"), "Politics": (3, "National Politics")}
SEVERITY_MULTIPLIERS = {"War/Conflict": 1.3, "Mass Casualty/Deaths": 1.25, "National Politics": 1.15, "Economy/Markets": 1.1, "Tech/Business": 1.05}

PLACEHOLDER = "https://placehold.co/600x400?text="
AGGREGATOR_HOST = "news.google.com"


def topic_keywords(spark: SparkSession, topics: dict[str, list[str]] | None = None) -> DataFrame:
    from .functions.topics import keyword_pattern

    rows = [(t, i, k, keyword_pattern(k)) for i, (t, ks) in enumerate((topics or TOPIC_KEYWORDS).items()) for k in ks]
    return spark.createDataFrame(rows, "topic string, topic_ord int, keyword string, pattern string")


def category_alias(spark: SparkSession, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    rows = sorted({(t, a.lower()) for t, names in (aliases or CATEGORY_ALIASES).items() for a in [*names, t]})
    return spark.createDataFrame(rows, "topic string, category_lc string")


def category_meta(spark: SparkSession, meta: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    return spark.createDataFrame([(c, level, label) for c, (level, label) in (meta or CATEGORY_META).items()], "category string, level int, label string")
