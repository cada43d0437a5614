import re

import pytest

from tidewell.llm import urls

SCHEMA = "page_id long, url string, html string, trust string"
URLS = [None, "", "no scheme", "http://example.org/es/a", "https://EXAMPLE.org/es", "http://sub.example.org/en/1x", "http://a.org", "http://b.org?x=1", "http://c.org/p#f", "x://h.com/fr/q?z", "http://notexample.org/es/", "http://org/", "http://com/de/", "http://z.net/de/", "a://b://c/d", "http://é.com/de/\nx"]


def slow(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m.group(1)) if m else ""
    path = m.group(2) if m else ""
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules(spark):
    rows = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(URLS)], SCHEMA)
    for r in urls.judge(rows).collect():
        host, path, rule, verdict = slow(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_distrust_flows_against_links(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://friend.net/a", link("bad.com")), (3, "http://good.org/a", link("fine.net")), (4, "http://fine.net/a", ""), (5, "http://lonely.net/", None), (6, "http://friend.net/a", link("bad.com"))]
    out = {r["page_id"]: r for r in urls.judge(spark.createDataFrame([(*r, "t") for r in rows], SCHEMA)).collect()}
    assert {k: out[k]["verdict"] for k in out} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}
    assert out[4]["trust"] > 0 and out[2]["distrust"] > 0


def plain_rank(edges, seeds):
    mass = dict(seeds)
    for _ in range(300):
        new = {h: 0.15 * s for h, s in seeds.items()}
        for a, b, w in edges:
            new[b] = new.get(b, 0) + 0.85 * mass.get(a, 0) * w / sum(x for p, _, x in edges if p == a)
        mass = new
    return {h: m for h, m in mass.items() if m > 0}


def ranked(spark, flows):
    links = spark.createDataFrame([(f, *e) for f, (edges, _) in flows.items() for e in edges], "flow string, a string, b string, w long")
    seeds = spark.createDataFrame([(f, h, s) for f, (_, seeds) in flows.items() for h, s in seeds.items()], "flow string, host string, seed double")
    return {(r["flow"], r["host"]): r["mass"] for r in urls.propagate(links, seeds).collect()}


def test_ranks_match_a_plain_model(spark):
    """Two flows at once; one is a chain far longer than the rounds of one save."""
    ring = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 2), ("d", "a", 1)]
    flows = {"ring": (ring, {"a": 0.5, "d": 0.5}), "chain": ([(f"h{k}", f"h{k + 1}", 1) for k in range(23)], {"h0": 1.0})}
    got = ranked(spark, flows)
    want = {(f, h): m for f, (edges, seeds) in flows.items() for h, m in plain_rank(edges, seeds).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_rounds_that_never_settle(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_ROUNDS", 5)
    with pytest.raises(RuntimeError):
        ranked(spark, {"ring": ([("a", "b", 1), ("b", "a", 1)], {"a": 1.0})})


def test_columns_that_clash(spark):
    rows = spark.createDataFrame([(1, URLS[3], None, "mine", "mine", "mine", "mine")], SCHEMA + ", _said string, rule_verdict string, flow_host string")
    row = urls.judge(rows).first()
    assert (row["_said"], row["rule_verdict"], row["flow_host"], row["trust"], row["verdict"]) == ("mine", "mine", "mine", 0.0, "block")


def test_repeated_and_long_rows(spark):
    long = "http://a.net/" + "x" * 200_000
    rows = [(1, "http://bad.com/de/1", "", "t")] * 3 + [(2, long, '<a href="http://bad.com/">' * 20_000, "t")] * 2
    out = urls.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in out) == [(1, "block")] * 3 + [(2, "block")] * 2 and {len(r["path"]) for r in out if r["page_id"] == 2} == {200_001}


def test_no_rows(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0
