"""SimHash near-duplicate groups with a pigeonring search.

A 64-bit fingerprint is cut into a ring of SEGMENTS equal segments. If two fingerprints differ in at most BITS
bits, some segment starts a chain whose first l segments differ in at most l * BITS / SEGMENTS bits, for every l.
With BITS = 4 and 8 segments the budgets are 0 1 1 2 2 3 3 4, so along the chain at least four segments agree: the
32 bits of those four are an index key. Every candidate met under a key must pass the chain test before
the full Hamming distance is taken, and it is reported under its first agreeing key only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, fresh, parts_of, saved, swept, table

BITS, SEGMENTS = 4, 8
WIDTH = 64 // SEGMENTS
BUDGET = [length * BITS // SEGMENTS for length in range(1, SEGMENTS + 1)]


def shingles(text: str | None, words_per_shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a text, A-Z lower-cased, joined by blanks, and where its shingles start and stop; fewer words than a shingle are one, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b"", [], []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    stops = ends[min(words_per_shingle, len(words)) - 1 :].tolist()
    return b" ".join(words), [0, *(ends[: len(stops) - 1] + 1).tolist()], stops


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """Signed 64-bit SimHash of a whole text; 0 for a text without words.

    Texts of fewer words than a shingle count as one shingle. A bit is 1 if more than half of the shingles' XXH64
    hashes (seed 42, repeats counted) have it.
    """
    return print_of(*shingles(text, words_per_shingle))


def print_of(joined: bytes, starts: list[int], stops: list[int]) -> int:
    if not stops:
        return 0
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(stops), 4096):
        part = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[at : at + 4096], stops[at : at + 4096])), dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(stops), bitorder="little").view("<i8")[0])


def fingerprint_col(col, words_per_shingle: int = 4):
    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts_of(batches):
            yield pa.array([fingerprint(t.as_py(), words_per_shingle) for t in part], pa.int64())

    return run(col)


#: The agreeing segments that a chain within budget guarantees, as segment masks in a fixed order.
TABLES = [sum(1 << s for s in chosen) for chosen in combinations(range(SEGMENTS), SEGMENTS - BITS)]
#: For each mask of agreeing segments, the first index table under which such a pair meets.
FIRST_TABLE = [next((t for t, m in enumerate(TABLES) if m & agree == m), -1) for agree in range(1 << SEGMENTS)]


def _segment_mask(segment: int) -> int:
    mask = ((1 << WIDTH) - 1) << (segment * WIDTH)
    return mask - (1 << 64) if mask >> 63 else mask


def _key(fp, mask: int):
    """The bits of the segments in mask, packed."""
    out = F.lit(0).cast("long")
    for rank, segment in enumerate(s for s in range(SEGMENTS) if mask >> s & 1):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, segment * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")), rank * WIDTH))
    return out


def _chain_ok(diffs):
    """Some segment starts a chain whose running differences all stay within the proportional budgets."""
    any_start = F.lit(False)
    for start in range(SEGMENTS):
        ok, total = F.lit(True), F.lit(0)
        for length in range(SEGMENTS - 1):
            total = total + diffs[(start + length) % SEGMENTS]
            ok = ok & (total <= BUDGET[length])
        any_start = any_start | ok
    return any_start


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column fp that differ in at most BITS bits.

    Fingerprints are few bytes and become many keys, so they are dealt out to all tasks first. Spark sizes what explode() makes as if each row stayed one, so it
    would broadcast keys by the size of the fingerprints; the hint keeps the join a merge.
    """
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = prints.select("fp").repartition(tasks, "fp").select("fp", F.posexplode(F.array(*[_key(F.col("fp"), m) for m in TABLES])).alias("t", "key"))
    a, b = keyed.select("t", "key", F.col("fp").alias("a")), keyed.select("t", "key", F.col("fp").alias("b"))
    pairs = a.join(b.hint("merge"), ["t", "key"]).where("a < b").withColumn("x", F.col("a").bitwiseXOR(F.col("b")))
    diffs = [F.bit_count(F.col("x").bitwiseAND(F.lit(_segment_mask(s)).cast("long"))) for s in range(SEGMENTS)]
    agree = sum((F.when(d == 0, 1 << s).otherwise(0) for s, d in enumerate(diffs)), F.lit(0))
    first = F.element_at(F.array(*[F.lit(t) for t in FIRST_TABLE]), agree + 1)
    return pairs.where(F.col("t") == first).where(_chain_ok(diffs)).where(F.bit_count("x") <= BITS).select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over the undirected edges (a, b), for every node of an edge.

    Alternates large-star and small-star until only stars are left, so the rounds grow with the logarithm of the longest path; stars take none.
    Each round is written to the shared folder. The table of least neighbours that a round begins with tells whether it is needed, and is the result if not.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = edges.select("u", "v", F.lit(1).alias("up")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("up")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), ((F.sum("up") > 0) & (F.count("*") > 1)).alias("open"))  # open: has a smaller neighbour and another one
        least = saved(least)  # as a table, so that a hub's edges can be split in the join
        if not least.agg(F.count_if("open")).first()[0]:
            dropped(edges)
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        large = saved(both.drop("up").join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("p"), F.col("m").alias("q")), F.struct(F.col("v").alias("p"), F.col("m").alias("q")))).alias("e"))
        now = saved(small.select(F.col("e.p").alias("u"), F.col("e.q").alias("v")).where("u <> v").distinct())
        dropped(edges, least, large, low)
        edges = now
    raise RuntimeError("components did not settle")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """docs' ids with `fp` (long) and `component_id`, the smallest id among all documents linked over fingerprints.

    Null and empty texts, and texts of white space only, have fingerprint 0 and are linked like any other. Rows with equal ids
    each keep a row. Null ids: the group's smallest id that is not null, null if there is none. Texts are read whole, however long; other columns play no part. No rows: no rows.
    Equal fingerprints are merged before the search, so a group of copies costs as much as one document.
    """
    own = saved(docs.select(F.col(id_col).alias("id"), fingerprint_col(F.col(text_col), words_per_shingle).alias("fp")))
    prints = own.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(prints.select("fp")))
    rooted = saved(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = saved(groups)
    found = rooted.join(groups, "root").select(F.col("fp").alias("f"), "component_id")
    return own.join(found, own["fp"] == found["f"], "left").select(F.col("id").alias(id_col), "fp", "component_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: near_dedup(): every n-th text is looked at for frequent shingles, of which so many at most go last in the order; the rounds of likely copies, and
#: the part of these that must be copies for another round; the keys that may be broadcast. They only steer the work; the result doesn't depend on them.
EVERY, MOST_FREQUENT, ROUNDS, FEW, SMALL = 8, 1_000_000, 6, 20, 500_000
#: Slack of the candidate filters, so that rounding never loses a pair.
SLACK = 1e-6
#: across_pairs(): the rows under a token that are paired without a look at their sketches; the bits of a sketch, a power of two; how many tokens back a pair
#: is looked for that has met before. They only steer the work as well.
CROWD, SKETCH, BACK = 8, 512, 8


def shingle_set(text: str | None, words_per_shingle: int) -> np.ndarray:
    """The distinct 32-bit hashes of a text's shingles, sorted; two texts of a thousand words share one by chance once in four thousand times."""
    return set_of(*shingles(text, words_per_shingle))


def set_of(joined: bytes, starts: list[int], stops: list[int]) -> np.ndarray:
    digest = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, stops)), dtype="<u4", count=len(stops)).view("<i4"))


def sketch_of(s: np.ndarray) -> np.ndarray:
    """SKETCH bits: for each rest of the hashes, whether an odd number of them has it. A shingle that only one of two sets holds flips one bit, so sketches differ in no more bits than the sets do in shingles."""
    return np.packbits(np.bincount(s & (SKETCH - 1), minlength=SKETCH).astype(np.uint8) & 1, bitorder="little").view("<i8")


def _lists(parts: list[np.ndarray], of: pa.DataType = pa.int32()) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], of))


def shingle_hashes(col, words_per_shingle: int):
    """array<int>: shingle_set() of a column."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts_of(batches):
            yield _lists([shingle_set(t.as_py(), words_per_shingle) for t in part])

    return run(col)


def prefix_of(s: np.ndarray, similarity: float, frequent: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The head of a set of shingles that two sets of that similarity must both have a shingle in; 0 for an empty set, so that empty sets meet.

    All sets are put in one order: shingles that aren't frequent by hash, then the sorted `frequent` ones by step. If sets of n and m shingles share
    at least similarity * n and similarity * m, then the first shared one stands among the first n - ceil(similarity * n) + 1, and likewise for m.
    """
    if not len(s):
        return np.zeros(1, dtype=np.int32)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        known = frequent[at] == s
        s = np.concatenate((s[~known], s[known][np.argsort(step[at[known]], kind="stable")]))
    return s[: len(s) - math.ceil(similarity * len(s) - SLACK) + 1]


def heads(col, words_per_shingle: int, similarity: float, frequent: np.ndarray, step: np.ndarray):
    """struct<fp, size, prefix, sketch>: a text's fingerprint, the number of its distinct shingles, prefix_of() and sketch_of() them."""

    @F.arrow_udf("struct<fp: long, size: int, prefix: array<int>, sketch: array<long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts_of(batches):
            prints, sizes, prefixes, sketches = [], [], [], []
            for text in part:
                found = shingles(text.as_py(), words_per_shingle)
                own = set_of(*found)
                prints.append(print_of(*found))
                sizes.append(len(own))
                prefixes.append(prefix_of(own, similarity, frequent, step).copy())
                sketches.append(sketch_of(own))
            columns = [pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), _lists(prefixes), _lists(sketches, pa.int64())]
            yield pa.StructArray.from_arrays(columns, ["fp", "size", "prefix", "sketch"])

    return run(col)


def frequent_shingles(docs: DataFrame, text_col: str, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, step of their number) of shingles that several of every EVERY-th text hold. They only go last in the order, so a miss costs time and no pair.

    A histogram of the steps, a few hundred rows, tells first from which on there are MOST_FREQUENT at most; no others reach the driver.
    """
    some = docs.select(F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text")).where(F.pmod("hash", F.lit(EVERY)) == 0).dropDuplicates(["hash"])
    counts = some.select(F.explode(shingle_hashes(F.col("text"), words_per_shingle)).alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    counts = saved(counts.select("s", F.floor(F.log2("c") * 8).cast("int").alias("step")))
    least, total = None, 0
    for row in sorted(counts.groupBy("step").count().collect(), reverse=True):
        total += row["count"]
        if total > MOST_FREQUENT:
            break
        least = row["step"]
    top = counts.where(F.col("step") >= (1 << 30 if least is None else least)).toArrow()
    dropped(counts)
    hashes, step = top["s"].to_numpy(), top["step"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], step[order]


def _filtered(docs: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """docs joined on a column with a table of keys; it is broadcast if it is small, which is counted first."""
    return docs.join(F.broadcast(keys) if keys.count() <= SMALL else keys, on, how)


def meetings(nodes: DataFrame) -> DataFrame:
    """(token, node, size, i) of the prefixes in (node, size, prefix), for tokens of more than one row."""
    each = nodes.select("node", "size", F.posexplode("prefix").alias("i", "token"))
    return each.withColumn("c", F.count("*").over(Window.partitionBy("token"))).where("c > 1").drop("c")


def _sizes_fit(a, b, similarity: float):
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - F.lit(SLACK)


def print_pairs(nodes: DataFrame) -> DataFrame:
    """(node, other): each node of (node, fp) with the least node among the fingerprints that links() connects to its own, itself left out."""
    prints = saved(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    roots = components(links(prints.select("fp")))
    rooted = saved(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("other"))
    found = rooted.join(least, "root").select(F.col("fp").alias("f"), "other")
    return nodes.join(found, nodes["fp"] == found["f"]).where("node <> other").select("node", "other")


def _parted(met: DataFrame, roots: DataFrame) -> DataFrame:
    """met with the part of each node, which is its root in (node, root) or itself."""
    return met.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")


def likely_pairs(met: DataFrame, roots: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(node, other): for each node at most one likely copy out of another part.

    A shortcut: what these link makes large groups of near copies one part before across_pairs() takes all pairs between parts. Under each token of its prefix
    a node meets two nodes of the largest part there, others in every turn; the one it meets most often, and three times at least, is taken.
    """
    weight = roots.groupBy(F.col("root").alias("part")).agg(F.count("*").alias("weight"))
    own = _parted(met, roots).join(weight, "part", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    own = saved(own.select("token", "node", "size", F.struct("weight", "part", F.xxhash64("node", F.lit(turn)).alias("place"), "node", "size").alias("me")))
    hubs = own.groupBy("token").agg(F.array(F.max("me"), F.min(F.struct((-F.col("me.weight")).alias("weight"), "me.part", "me.place", "me.node", "me.size"))).alias("hubs"))
    each = own.join(hubs, "token").select("node", "size", F.col("me.part").alias("part"), F.explode("hubs").alias("o")).where("o.part <> part").where(_sizes_fit(F.col("size"), F.col("o.size"), similarity))
    counts = each.groupBy("node", F.col("o.node").alias("other")).agg(F.count("*").alias("c")).where("c > 2")
    return counts.groupBy("node").agg(F.max(F.struct("c", "other")).alias("p")).select("node", "p.other")


def _sketches_fit(a, b, m, n, similarity: float):
    """Sets of m and n shingles that reach the similarity differ in so many shingles at most, and their sketches in no more bits."""
    bits = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(SKETCH // 64)), F.lit(0))
    return bits <= (m + n) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(SLACK)


def crowded_pairs(own: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b): two nodes of different parts under one token of (token, node, size, i, part) whose sizes and sketches fit, each a struct of node, size and i.

    The largest part under a token is held against the others and never against itself. A pair is left out under a token if both nodes have another one in common among the last
    BACK before it: under the first one that they share it is always found. So texts that are near each other, but not near enough, make no rows, and others a few.
    """
    before = F.collect_list("token").over(Window.partitionBy("node").orderBy("i").rowsBetween(-BACK, -1))
    largest = own.groupBy("token", "part").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "part")).alias("l")).select("token", F.col("l.part").alias("largest"))
    each = own.withColumn("before", before).join(largest, "token").withColumn("rest", F.col("part") != F.col("largest")).join(sketches, "node")
    each = saved(each.select("token", "part", "rest", "before", "sketch", F.struct("node", "size", "i").alias("me")))
    a, b = each.where("rest").drop("rest"), each
    a, b = (df.select("token", *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c != "token"]) for df, side in ((a, "a"), (b, "b")))
    m, n = F.col("me_a.size"), F.col("me_b.size")
    fits = (F.col("part_a") != F.col("part_b")) & (~F.col("rest_b") | (F.col("part_a") < F.col("part_b"))) & _sizes_fit(m, n, similarity)
    fits = fits & _sketches_fit(F.col("sketch_a"), F.col("sketch_b"), m, n, similarity) & ~F.arrays_overlap("before_a", "before_b")
    a, b = a.withColumnRenamed("token", "token_a"), b.withColumnRenamed("token", "token_b")
    found = saved(a.join(b, (F.col("token_a") == F.col("token_b")) & fits).select(F.col("me_a").alias("a"), F.col("me_b").alias("b")))
    dropped(each)
    return found


def across_pairs(met: DataFrame, roots: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(node, other): all pairs that share a token of their prefixes and may reach the similarity, but those that roots (node, root) has linked already.

    Sizes and the sketches of (node, sketch) must fit, and what stands from the first shared token on in both sets must be able to make up the shared part.
    Under a token of CROWD rows at most each row meets all others; under any other, crowded_pairs() looks at sizes and sketches before it makes a row.
    """
    own = saved(_parted(met, roots).select("token", "node", "size", "i", "part"))
    several = saved(own.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("c")).where("x <> y").select("token", "c"))
    few = own.join(several.where(F.col("c") <= CROWD).select("token"), "token")
    one, other = (few.select("token", F.col("part").alias(f"part_{side}"), F.struct("node", "size", "i").alias(side)) for side in "ab")
    each = one.join(other, "token").where("part_a < part_b").where(_sizes_fit(F.col("a.size"), F.col("b.size"), similarity)).select("a", "b")
    each = each.unionByName(crowded_pairs(own.join(several.where(F.col("c") > CROWD).select("token"), "token"), sketches, similarity))
    each = each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy(F.col("a.node").alias("node"), F.col("b.node").alias("other"))
    pairs = each.agg(F.max("a.size").alias("m"), F.max("b.size").alias("n"), F.min("a.i").alias("i"), F.min("b.i").alias("j"))
    needed = (F.col("m") + F.col("n")) * F.lit(similarity / (1 + similarity)) - F.lit(SLACK)
    pairs = saved(pairs.where((F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= needed) | (F.col("m") + F.col("n") == 0)).select("node", "other", "m", "n"))
    dropped(own, several)
    a, b = sketches.select("node", F.col("sketch").alias("sketch_a")), sketches.select(F.col("node").alias("other"), F.col("sketch").alias("sketch_b"))
    return pairs.join(a, "node").join(b, "other").where(_sketches_fit(F.col("sketch_a"), F.col("sketch_b"), F.col("m"), F.col("n"), similarity)).select("node", "other")


def merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) after the links (a, b) have joined parts of (node, root)."""
    left, right = (roots.select(F.col("node").alias(f"{side}_node"), F.col("root").alias(f"{side}_root")) for side in "ab")
    ends = found.join(left, found["a"] == left["a_node"], "left").join(right, found["b"] == right["b_node"], "left")
    joined = components(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    new = joined.select(F.col("node").alias("old"), F.col("root").alias("now"))
    moved = roots.join(new, roots["root"] == new["old"], "left").select("node", F.coalesce("now", "root").alias("root"))
    return saved(moved.unionByName(joined.join(roots.select("node"), "node", "left_anti")))


def near_dedup(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of copies: the one of smallest id, null ids last. Columns are docs' own, whatever their names.

    Copies are equal texts, and texts whose sets of shingles have a Jaccard similarity of at least `similarity`; groups are what such links connect. Fingerprints
    that links() connects give the first pairs to check. At that similarity fingerprints may differ in far more bits than it finds, so all other pairs are found by an
    exact search over sets: every such pair of texts shares a shingle of their prefixes, and all pairs that do are checked unless they are in one group already.
    Null and empty texts, and others without words, are copies of each other. Of equal rows one stays. Texts are read whole, however long. No rows: no rows.
    """
    (key,) = fresh(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    frequent, step = frequent_shingles(docs, text_col, words_per_shingle)
    copy = F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), F.length(text).alias("h3"))
    rows = saved(keyed.select(F.col(key).alias("row"), F.col(id_col).alias("id"), copy.alias("copy"), heads(F.col(text_col), words_per_shingle, similarity, frequent, step).alias("p")))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))
    nodes = saved(rows.groupBy("copy").agg(F.min(order).alias("o")).select(F.col("o.row").alias("node"), "o"))
    times = saved(rows.groupBy("row").agg(F.count("*").alias("times")).where("times > 1"))

    own = _filtered(rows.select(F.col("row").alias("node"), "p.*"), nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])
    met = saved(meetings(own.select("node", "size", "prefix")))
    often = times.select(F.col("row").alias(key)) if not times.isEmpty() else None

    def checked(pairs: DataFrame) -> DataFrame:
        wanted = saved(pairs.select(F.col("node").alias(key)).union(pairs.select("other")).distinct())
        texts = _filtered(keyed.select(key, text_col), wanted, key, "left_semi")
        if often is not None:  # equal rows
            texts = _filtered(texts, often, key, "left_anti").unionByName(_filtered(texts, often, key, "left_semi").dropDuplicates([key]))
        sets = saved(texts.select(F.col(key).alias("of"), shingle_hashes(F.col(text_col), words_per_shingle).alias("s")))
        a, b = sets.select(F.col("of").alias("node"), F.col("s").alias("sa")), sets.select(F.col("of").alias("other"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        found = pairs.join(a, "node").join(b, "other").where(both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both))
        found = saved(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
        dropped(wanted, sets)
        return found

    roots = components(checked(saved(print_pairs(own.select("node", "fp")))))
    for turn in range(ROUNDS):
        swept(docs.sparkSession)
        pairs = saved(likely_pairs(met, roots, similarity, turn))
        found = checked(pairs)
        roots = merged(roots, found)
        if found.count() * FEW <= pairs.count():
            break
    swept(docs.sparkSession)
    roots = merged(roots, checked(saved(across_pairs(met, roots, own.select("node", "sketch"), similarity))))
    dropped(met)
    swept(docs.sparkSession)
    grouped = saved(nodes.join(roots, "node", "left").select("node", "o", F.coalesce("root", "node").alias("root")))
    stay = saved(grouped.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.row").alias(key)))
    gone = saved(rows.select(F.col("row").alias(key)).distinct().join(stay, key, "left_anti"))
    often = saved(times.select(F.col("row").alias(key)).join(stay, key, "left_semi"))
    dropped(rows, nodes, times, grouped, stay)  # what is left to do reads gone and often alone
    out = _filtered(keyed, gone, key, "left_anti")
    if not often.isEmpty():
        out = _filtered(out, often, key, "left_anti").unionByName(_filtered(keyed, often, key, "left_semi").dropDuplicates([key]))
    return out.drop(key)
