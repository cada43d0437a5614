"""URL filters: prefix rules, and for all other urls the propagation of trust and distrust over the links between hosts.

Pages link to hosts in their markup. Personalised PageRank from the trusted hosts (those under an allow rule) flows along links; reversed distrust from the
blocked ones flows against them, as who links to a blocked host is suspect. A host is blocked if its distrust is greater than its trust by
MARGIN. All of it is joins and sums over edges between hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, fresh, saved, table

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DAMPING, MARGIN = 0.85, 2.0
#: Propagation ends when no host's mass changes by more than TOLERANCE of the whole in a round, and fails after MOST_ROUNDS; every SAVED_ROUNDS it is written.
TOLERANCE, MOST_ROUNDS, SAVED_ROUNDS = 1e-7, 200, 5
#: A host with more rules than this would need a join rather than an expression.
MOST_RULES = 1000
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?([a-z][a-z0-9+.-]*://[^\s"'<>]+)"""


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does. A rule fits its host and all subdomains."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_col == h) | F.endswith(host_col, F.lit("." + h))) & F.startswith(path_col, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b, w): from host a to host b, with the number of a's linking pages. Links within a host don't count."""
    linked = pages.select(host(F.col(url_col)).alias("a"), F.array_distinct(F.transform(F.regexp_extract_all(html_col, F.lit(LINK), 1), host)).alias("bs"))
    each = linked.select("a", F.explode("bs").alias("b")).where("a <> '' and b <> '' and a <> b")
    return each.groupBy("a", "b").agg(F.count("*").alias("w"))


def parents(hosts: DataFrame) -> DataFrame:
    """(a, b, w): a host belongs to the host one label up, if pages have it too."""
    up = hosts.select(F.col("host").alias("a"), F.regexp_replace("host", r"^[^.]*\.?", "").alias("b"))
    return up.join(hosts.select(F.col("host").alias("b")), "b", "left_semi").select("a", "b", F.lit(1).cast("long").alias("w"))


def propagate(links: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(flow, host, mass): personalised PageRank from (flow, host, seed) along (flow, a, b, w), all flows at once, until it has settled. Mass without a way out is lost.

    Some rounds at a time end in the shared folder, so lineage stays short, and tell how far the last of them was from the one before.
    """
    out = links.groupBy("flow", "a").agg(F.sum("w").alias("total")).withColumnsRenamed({"flow": "_f", "a": "_a"})
    share = saved(links.join(out, (links["flow"] == out["_f"]) & (links["a"] == out["_a"])).select("flow", "a", "b", (F.col("w") / F.col("total")).alias("p")))
    seeds = saved(seeds.select("flow", "host", F.col("seed").alias("mass")))
    kept, mass, last = seeds.withColumn("mass", F.lit(1 - DAMPING) * F.col("mass")), seeds, None
    for _ in range(0, MOST_ROUNDS, SAVED_ROUNDS):
        for turn in range(SAVED_ROUNDS):
            before, own = mass, mass.select(F.col("flow").alias("_f"), "host", F.col("mass").alias("_m"))
            moved = share.join(own, (share["flow"] == own["_f"]) & (share["a"] == own["host"])).select("flow", F.col("b").alias("host"), (F.lit(DAMPING) * F.col("p") * F.col("_m")).alias("mass"))
            mass = kept.unionByName(moved).groupBy("flow", "host").agg(F.sum("mass").alias("mass"))
        both = mass.withColumn("before", F.lit(0.0)).unionByName(before.select("flow", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("before")))
        now = saved(both.groupBy("flow", "host").agg(F.sum("mass").alias("mass"), F.sum("before").alias("before")))
        if last is not None:
            dropped(last)
        last, mass = now, now.where("mass > 0").select("flow", "host", "mass")
        if (now.agg(F.max(F.abs(F.col("mass") - F.col("before")))).first()[0] or 0) <= tolerance:
            return mass
    raise RuntimeError(f"masses did not settle in {MOST_ROUNDS} rounds")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without the markup, with host, path, rule, trust, distrust and verdict; columns of those names are replaced.

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed. Null markup has no links. Urls and markup are read whole, however long; repeated rows each keep a
    row and each count, no rows give no rows, and of rules that fit and are equally long the last in order wins. Seeds are the hosts of pages that a rule
    allows or blocks, by the share of their pages; hosts that neither flow reaches are allowed.
    """
    rules = RULES if rules is None else rules
    read = pages.withColumns({"host": F.coalesce(host(F.col(url_col)), F.lit("")), "path": F.coalesce(path(F.col(url_col)), F.lit(""))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    said, at = fresh(read, "rule_verdict", "flow_host")
    read = read.withColumns({"rule": rule, said: verdict})
    per_host = saved(read.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col(said) == "allow").alias("good"), F.count_if(F.col(said) == "block").alias("bad")))
    links = edges(pages, url_col, html_col).unionAll(parents(per_host.select("host")))
    links = saved(links.groupBy("a", "b").agg(F.sum("w").alias("w")))
    total = per_host.agg(F.greatest(F.sum("good"), F.lit(1)).alias("good"), F.greatest(F.sum("bad"), F.lit(1)).alias("bad")).first() or (1, 1)
    flows = links.select(F.lit("trust").alias("flow"), "a", "b", "w").unionAll(links.select(F.lit("distrust"), "b", "a", "w"))
    seed = lambda name, of, whole: per_host.where(F.col(of) > 0).select(F.lit(name).alias("flow"), "host", (F.col(of) / (whole or 1)).alias("seed"))
    mass = propagate(flows, seed("trust", "good", total[0]).unionAll(seed("distrust", "bad", total[1])))
    flows = saved(mass.groupBy(F.col("host").alias(at)).agg(*[F.sum(F.when(F.col("flow") == name, F.col("mass")).otherwise(0.0)).alias(name) for name in ("trust", "distrust")]))
    out = read.drop(html_col, "trust", "distrust").join(flows, F.col("host") == F.col(at), "left").drop(at)
    out = out.withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    method = F.when((F.col("distrust") > 0) & (F.col("distrust") > F.col("trust") * MARGIN), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(said, method)).drop(said)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "trust", "distrust", "verdict")
