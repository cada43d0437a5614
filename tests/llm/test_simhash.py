import random

import xxhash
from pyspark.sql import functions as F

from tidewell.llm import simhash


def slow_print(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near_texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(3, 200))) for _ in range(n // 4)]
    out = list(base)
    while len(out) < n:
        t = rng.choice(base).split()
        t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


def test_fingerprints(make):
    texts = [None, "", "A b", "a B", "one two three four five", *near_texts(1)]
    assert [simhash.fingerprint(t) & (1 << 64) - 1 for t in texts] == [slow_print(t) for t in texts]


def test_groups_match_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base) | {0}
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert {(r["a"], r["b"]) for r in simhash.links(df).collect()} == want
    roots = components(sorted(signed), want)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    assert got == {n: r for n, r in roots.items() if any(n in p for p in want)}


def test_query_matches_brute_force(spark, make):
    rows = [(i, t) for i, t in enumerate([None, "", " ", *near_texts(2)])]
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_groups(make(rows)).collect()}
    prints = {i: slow_print(t) for i, t in rows}
    want = components(sorted(prints), [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4])
    assert got == {i: (prints[i], want[i]) for i in prints}


def test_long_path_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_stars_take_no_rounds(spark, monkeypatch):
    """Edges that are stars already are written and looked at once, others once more after their last round; the roots are those of a plain search."""
    tables, write = [], simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df: tables.append(df.columns) or write(df))
    rng = random.Random(15)
    stars = [(10 * k, 10 * k + j) for k in range(-20, 20) for j in range(1, 8)]
    loose = [(a, b) for a, b in (sorted(rng.sample(range(1000, 1060), 2)) for _ in range(40))]
    for edges, most in ((stars, 2), ([], 2), (stars + loose + [(5, 5)], 14)):
        tables.clear()
        got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(rng.sample(edges, len(edges)), "a long, b long")).collect()}
        assert got == components({n for a, b in edges if a != b for n in (a, b)}, edges)
        assert len(tables) <= most


def test_odd_rows(odd, empty):
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == 9 and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_groups(empty).count() == 0


def jaccard(a, b, k=5):
    s = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_dedup_keeps_one_of_each_group(make):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choices(words, k=200) for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for j in range(3):
            edited = list(b)
            edited[rng.randrange(200)] = "changed"
            rows.append((100 + 10 * i + j, " ".join(edited)))
        other = list(b)
        for p in range(0, 200, 8):
            other[p] = f"new{p}"
        rows.append((1000 + i, " ".join(other)))  # far below 0.8
    rows += [(5000, None), (5001, ""), (5002, "short"), (5003, "short")]
    kept = {r["doc_id"] for r in simhash.near_dedup(make(rows)).collect()}
    assert kept == {*range(20), *range(1000, 1020), 5000, 5002}


def test_near_dedup_odd_rows(odd, empty):
    clash = odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("node", "n", "_k", "row", "row_key", "copy", "fp", "component_id"))])
    out = simhash.near_dedup(clash)
    assert out.columns == clash.columns and {tuple(r[5:]) for r in out.collect()} == {tuple(range(8))}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.select("doc_id", F.substring("text", 1, 20).alias("text")).collect()) == sorted(
        [(False, 1, ""), (False, 4, "lorem lorem lorem lo"), (False, 5, "a b c"), (False, 5, "other words here"), (True, 0, "null id text"), (False, 7, "Zürich ▁ 日本 😀 end")]
    )
    assert out.where("doc_id = 5").count() == 2
    assert simhash.near_dedup(empty).count() == 0


def families(seed, count=40):
    """Pairs of texts of a similarity just above 0.8, all sharing so much of one passage that other texts are at 0.6 to 0.79."""
    rng = random.Random(seed)
    shared = [f"s{k}" for k in range(170)]
    out = []
    for f in range(count):
        at = rng.randrange(171)
        one = shared[:at] + [f"f{f}x{k}" for k in range(30)] + shared[at:]
        other = list(one)
        for p in (15, 65, 115, 165):
            other[p] = f"f{f}y{p}"
        out += [" ".join(one), " ".join(other)]
    return out


def least_of_groups(rows):
    """The smallest id of each group, by all pairs."""
    pairs = [(i, j) for i, t in rows for j, u in rows if i < j and jaccard(t, u) >= 0.8]
    return pairs, set(components([i for i, _ in rows], pairs).values())


def test_near_copies_apart_in_crowded_buckets(make):
    """Near copies far from each other in the order by number of copies, among many texts with much the same fingerprint."""
    texts = families(3)
    rows = list(enumerate(texts))
    rows += [(1000 + i, t) for i, t in rows if i % 2 == 0]
    pairs, want = least_of_groups(rows)
    assert {(2 * k, 2 * k + 1) for k in range(40)} <= set(pairs)
    assert {r["doc_id"] for r in simhash.near_dedup(make(rows)).collect()} == want


def test_all_candidates_are_checked(make):
    """The true partner is one of many candidates, most of them below the similarity."""
    rows = list(enumerate(families(4)))
    pairs, want = least_of_groups(rows)
    assert {(2 * k, 2 * k + 1) for k in range(40)} <= set(pairs)
    assert {r["doc_id"] for r in simhash.near_dedup(make(rows)).collect()} == want


def test_pairs_around_the_similarity(make):
    """Pairs without a third copy, from below the similarity to well above it, and texts too short for a shingle."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    rows = [(5000, "one two"), (5001, "One  two"), (5002, " "), (5003, "\t\n")]
    for i in range(200):
        one = rng.choices(words, k=rng.randint(60, 300))
        other = list(one)
        for p in rng.sample(range(len(one)), max(1, len(one) * rng.randint(10, 28) // 1000)):
            other[p] = f"e{i}"
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other))]
    pairs, want = least_of_groups([r for r in rows if r[0] < 5000])
    assert 60 < len(pairs) < 190
    assert {r["doc_id"] for r in simhash.near_dedup(make(rows)).collect()} == want | {5000, 5002}


def test_frequent_shingles_go_last_and_lose_no_pair(make, monkeypatch):
    """Most shingles of these texts are frequent, so most prefixes hold some."""
    monkeypatch.setattr(simhash, "EVERY", 1)
    rows = list(enumerate(families(6, 15)))
    _, want = least_of_groups(rows)
    assert len(simhash.frequent_shingles(make(rows), "text", 5)[0]) > 100
    assert {r["doc_id"] for r in simhash.near_dedup(make(rows)).collect()} == want
    monkeypatch.setattr(simhash, "MOST_FREQUENT", 20)
    assert len(simhash.frequent_shingles(make(rows), "text", 5)[0]) <= 20
    assert {r["doc_id"] for r in simhash.near_dedup(make(rows)).collect()} == want


def joined_rows(spark, run):
    """run()'s result, and the most rows that a join made meanwhile."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before, out, most = store.executionsCount(), run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = store.executionsList(before, store.executionsCount() - before)
    for k in range(done.size()):
        at = done.apply(k).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for n in (nodes.apply(i) for i in range(nodes.size())):
            found = [n.metrics().apply(i) for i in range(n.metrics().size())] if "Join" in n.name() else []
            made = [values.get(m.accumulatorId()) for m in found if m.name() == "number of output rows"]
            most = max([most, *(int(v.get().replace(",", "")) for v in made if v.isDefined())])
    return out, most


def test_large_group_of_near_copies_makes_no_rows_for_its_pairs(spark, make):
    """Texts near one another of which many reach the similarity with few or none: joins make far fewer rows than there are pairs."""
    rng = random.Random(13)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(200):
        text = list(base)
        for p in rng.sample(range(150), rng.randint(1, 6)):
            text[p] = f"e{i}x{p}"
        rows.append((i, " ".join(text)))
    _, want = least_of_groups(rows)
    assert 20 < len(want) < 180
    kept, most = joined_rows(spark, lambda: {r["doc_id"] for r in simhash.near_dedup(make(rows)).collect()})
    assert kept == want and 200 <= most < 200 * 199 // 2


def test_sketches_lose_no_pair(make, monkeypatch):
    """Sketches far too short, and every token crowded; sketches differ in no more bits than sets in shingles."""
    rng = random.Random(14)
    for _ in range(50):
        one = simhash.shingle_set(" ".join(rng.choices("abcdefgh", k=rng.randint(0, 300))), 5)
        other = simhash.shingle_set(" ".join(rng.choices("abcdefgh", k=rng.randint(0, 300))), 5)
        bits = sum(int(x).bit_count() for x in (simhash.sketch_of(one) ^ simhash.sketch_of(other)).view("<u8"))
        assert bits <= len(set(one.tolist()) ^ set(other.tolist()))
    rows = list(enumerate(families(8, 15)))
    _, want = least_of_groups(rows)
    monkeypatch.setattr(simhash, "CROWD", 1)
    for size, back in ((64, 1), (512, 50)):
        monkeypatch.setattr(simhash, "SKETCH", size)
        monkeypatch.setattr(simhash, "BACK", back)
        assert {r["doc_id"] for r in simhash.near_dedup(make(rows)).collect()} == want


def test_keys_of_fingerprints_are_not_broadcast(spark):
    """A fingerprint becomes a key for each table, which Spark sizes like the fingerprints: 20,000 of them look small and make 1,400,000 rows."""
    prints = spark.range(20_000).select(F.xxhash64("id").alias("fp"))
    found = simhash.links(prints)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_dedup_broadcasts_no_keys_of_fingerprints(make, monkeypatch):
    """The pipeline's search over fingerprints, whose links go to components() first."""
    plans, real = [], simhash.components

    def seen(edges):
        edges.collect()
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return real(edges)

    monkeypatch.setattr(simhash, "components", seen)
    rows = list(enumerate(families(8, 15)))
    _, want = least_of_groups(rows)
    assert {r["doc_id"] for r in simhash.near_dedup(make(rows)).collect()} == want
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
