import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def reshared(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing the excess again and again; sizes: (source, words), in order."""
    total = share * sum(n for _, n in sizes)
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    full: dict = {}
    while True:
        free = [s for s, _ in sizes if s not in full]
        left = total - sum(full.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: most * n for s, n in sizes if s in target and target[s] > most * n}
        if not over:
            return target | full
        full |= over


def rows():
    out = [(i, "w " * (i % 37), f"src{i % 7}") for i in range(400)]
    return out + [(1000 + i, "hot word here " * 20, "hot") for i in range(300)] + [(2000, None, "none"), (2001, "a b", None), (2002, "x", "Z"), (2003, "é\u00a0b c", "ä")]


@pytest.mark.parametrize("block", [16, 1024])
def test_targets_and_words_taken(make, monkeypatch, block):
    monkeypatch.setattr(mixing, "PART_ROWS", 50)
    monkeypatch.setattr(mixing, "SLOT_PART", 64)
    data = rows()
    got = mixing.taken(make(data), block=block).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in data)
    sums: dict = {}
    for i, t, s in data:
        sums[s] = sums.get(s, 0) + words(t)
    want = reshared(sorted(sums.items(), key=lambda x: (x[0] is None, (x[0] or "").encode())))
    text = {i: t for i, t, _ in data}
    for s in sums:
        own = [r for r in got if r["source"] == s]
        assert all(r["size"] == words(text[r["doc_id"]]) and 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sums[s] for r in own)
        assert own[0]["target"] == pytest.approx(want[s], rel=1e-12)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
    plain = lambda rows: sorted(tuple((x is None, x) for x in r) for r in rows)
    assert plain(got) == plain(mixing.taken(make(data[::-1]).repartition(5), block=block).collect())


def test_words_follow_the_schedule(make):
    """Each document's words and position, from the schedule's slots one by one."""
    data, block = rows(), 16
    got = {r["id"]: r for r in mixing.placed(make(data), block=block).collect()}
    size = {i: words(t) for i, t, _ in data}
    line: dict = {}
    for r in sorted(got.values(), key=lambda r: r["start"]):
        if r["size"]:
            line.setdefault(r["source"], []).extend([r["id"]] * r["size"])
    assert all(line[got[i]["source"]].index(i) == got[i]["start"] for i in got if size[i])
    sizes = make(data).select("source", mixing.n_words(F.col("text")).alias("size"))
    count, first = dict.fromkeys(got, 0), {}
    for s in mixing.schedule(mixing.targets(sizes), block).orderBy("slot").collect():
        for i in line[s["source"]][s["block"] * block : s["block"] * block + s["to_word"]]:
            count[i] += 1
            first.setdefault(i, s["slot"])
    assert {i: r["taken"] for i, r in got.items()} == count
    assert {i: r["position"] for i, r in ((r["doc_id"], r) for r in mixing.taken(make(data), block=block).collect())} == {i: first.get(i) for i in got}


def test_points_decide_the_order(make, monkeypatch):
    order = lambda: [r["position"] for r in sorted(mixing.taken(make(rows()), block=16).collect(), key=lambda r: r["doc_id"])]
    golden = order()
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    assert order() != golden


def test_mix_is_written_in_the_order_of_the_schedule(make):
    docs = make(rows())
    at = {r["doc_id"]: r["position"] for r in mixing.taken(docs, block=64).collect()}
    out = [r["doc_id"] for r in mixing.mixed(docs, block=64).collect()]
    firsts = [at[i] for i in dict.fromkeys(out)]
    assert firsts == sorted(firsts) and len(set(firsts)) > 50


def test_schedule_spreads_sources(make):
    sizes = make([(i, "a b c d " * 50, f"s{i % 3}") for i in range(300)]).select("source", mixing.n_words(F.col("text")).alias("size"))
    slots = mixing.schedule(mixing.targets(sizes), 64).orderBy("slot").collect()
    share = [sum(r["source"] == "s0" for r in slots[: len(slots) * k // 4]) / (len(slots) * k // 4) for k in (1, 2, 3, 4)]
    assert max(share) - min(share) < 0.05


def test_mixed_repeats_whole_documents(make):
    docs = make(rows())
    out = mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r["count"] for r in out} <= {1, 2} and 2000 not in {r["doc_id"] for r in out}


def test_odd_rows(odd, empty, make):
    got = mixing.taken(odd).collect()
    assert len(got) == 9 and all(r["taken"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    clash = odd.select("*", *[F.lit("mine").alias(c) for c in ("size", "copy", "slot", "copies", "copy_key", "start_word", "taken", "target", "_part", "a.b")])
    out = mixing.mixed(clash)
    assert out.columns == clash.columns and {tuple(r[5:]) for r in out.collect()} == {("mine",) * 10}
    assert mixing.taken(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert [r["taken"] for r in mixing.taken(make([(1, None), (2, "")])).collect()] == [0, 0]


def test_equal_rows_are_each_taken_as_often_as_their_words(make):
    """A third of all rows is one row, another third differs by a column only; a source's words stay within a document of its target."""
    docs = make([(7, "ten words of one text that many rows here have", "s")] * 300 + [(k, f"other text number {k} with a few words", f"t{k % 2}") for k in range(200)]).withColumn("extra", F.lit(1))
    docs = docs.unionByName(make([(8, "ten words of one text that many rows here have", "s")] * 150).withColumn("extra", (F.rand(1) * 3).cast("int"))).withColumn("kinds", F.create_map(F.lit("k"), F.col("extra")))
    want = {r["source"]: r["target"] for r in mixing.taken(docs, block=16).select("source", "target").distinct().collect()}
    got = mixing.mixed(docs, block=16).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n"), F.count("*").alias("rows")).collect()
    assert all(abs(r["n"] - want[r["source"]]) <= 0.1 * want[r["source"]] for r in got)
    own = mixing.placed(docs, block=16, alike=mixing._whole(docs)).where("size > 0").withColumn("times", F.round(F.col("taken") / F.col("size"))).groupBy("source").agg(F.sum("times").alias("rows")).collect()
    assert {r["source"]: r["rows"] for r in got} == {r["source"]: r["rows"] for r in own}
    per = {tuple(r[:2]): r["n"] for r in mixing.mixed(docs, block=16).groupBy("doc_id", "extra").agg(F.count("*").alias("n")).collect()}
    have = {tuple(r[:2]): r["n"] for r in docs.groupBy("doc_id", "extra").agg(F.count("*").alias("n")).collect()}
    assert all(n <= 2 * have[k] for k, n in per.items())


def test_many_sources_share_few_cells(make, monkeypatch):
    """The schedule is the same however fine its cells are."""
    sizes = make([(i, "a b c d e", f"s{i % 300:03d}") for i in range(900)]).select("source", mixing.n_words(F.col("text")).alias("size"))
    goals = mixing.targets(sizes)
    plain = sorted(map(tuple, mixing.schedule(goals, 2).collect()))
    monkeypatch.setattr(mixing, "CELLS", 2)
    assert sorted(map(tuple, mixing.schedule(goals, 2).collect())) == plain
    monkeypatch.setattr(mixing, "CELL_SLOTS", 1)
    assert sorted(map(tuple, mixing.schedule(goals, 2).collect())) == plain
