"""Mixing sources to target weights by a low-discrepancy schedule.

Every slot of the schedule is a golden-ratio point that falls into one source's share of the line of cumulative targets. A source's slots,
ranked, take its blocks of BLOCK words, one after another and over again, from its documents in a shuffled order. The block that
reaches a source's target is cut there, and a source whose points came a little short gets its last slots at the end of the schedule. A slot's number is
a place in the mix: documents are told the place of their first word, and mixed() writes them in that order.

A source may hold a third of all rows, and there may be as many sources as hosts, so ranks and running totals are taken in two steps: within
parts of bounded size, and over the parts' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, fresh, others, saved, table, text_or_empty

BLOCK, PART_ROWS, SLOT_PART = 1024, 10_000, 1 << 14
#: Points of the schedule lie on a grid of LINE cells; GOLDEN is LINE over the golden ratio, made odd.
LINE, GOLDEN, CELLS, CELL_SLOTS = 1 << 31, 1_327_217_885, 4096, 64
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _by_source() -> list[Column]:
    """Sources by code point, null last."""
    return [F.col("source").isNull(), F.col("source")]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, part, docs, source_size, weight, target) from (source, size) rows; parts are ranges of sources in order.

    Sources by code point, null last, weigh `weights` in turn and share `share` times all words. A source takes `most` times its words at most;
    the rest is shared again by weight among the others until none is above: each round is one sum over the sources. No rows: no rows.
    """
    own = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    own = saved(own.repartitionByRange(*_by_source()).withColumn("part", F.spark_partition_id()))
    placed = _running(own, [], F.col("part"), _by_source(), F.lit(1), "place")
    placed = placed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    placed = saved(placed.select("source", "part", "docs", "source_size", "weight", (F.col("source_size") * most).alias("cap")))
    dropped(own)
    total = (placed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        above = F.col("cap") <= F.lit(level) * F.col("weight")
        n, caps, rest = placed.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not rest:
            break
        level, full = (total - (caps or 0)) / rest, n
    return placed.select("source", "part", "docs", "source_size", "weight", F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _running(df: DataFrame, keys: list[str], part: Column, order: list[Column], amount: Column, out: str) -> DataFrame:
    """df with `out`: the sum of amount over the rows of equal keys before each row, by (part, order). Parts are of bounded size."""
    df = df.withColumn("_part", part).withColumn("_amount", amount)
    totals = df.groupBy(*keys, "_part").agg(F.sum("_amount").alias("_sum"))
    lead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(lead), F.lit(0)).alias("_lead"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    same = df["_part"] == totals["_p"]
    for k in keys:
        same = same & df[k].eqNullSafe(totals[f"_{k}"])
    return df.join(totals, same).withColumn(out, F.col("_lead") + F.col("_inside")).drop(*[f"_{k}" for k in keys], "_p", "_lead", "_inside", "_part", "_amount")


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, pass, block, to_word): what each slot takes of its source's blocks, up to to_word within the block.

    goals: targets(). Points that fall to a source beyond its target take nothing and are not in the result.
    """
    spark = goals.sparkSession
    goals = goals.where("target >= 1").withColumn("goal", F.floor("target").cast("long"))
    goals = goals.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    goals = goals.withColumn("whole", F.floor(F.col("goal") / F.col("source_size")).cast("long"))
    goals = goals.withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil((F.col("goal") - F.col("whole") * F.col("source_size")) / block).cast("long"))
    goals = saved(_running(goals, [], F.col("part"), _by_source(), F.col("slots"), "slots_before"))
    n = goals.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    at = lambda slots: F.floor(slots / max(n, 1) * LINE).cast("long")
    goals = goals.withColumns({"from": at(F.col("slots_before")), "to": at(F.col("slots_before") + F.col("slots"))})

    cells = CELLS
    while cells < min(n // CELL_SLOTS, LINE):  # a cell then holds few slots, and so few sources, however many there are
        cells *= 2
    cell = LINE // cells
    pieces = goals.where(F.col("from") < F.col("to")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("to") - 1) / cell))))
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("x", (F.col("slot") % LINE) * GOLDEN % LINE)
    points = points.withColumn("at", F.floor(F.col("x") / cell))
    dealt = points.join(pieces, points["at"] == pieces["cell"]).where((F.col("from") <= F.col("x")) & (F.col("x") < F.col("to"))).select("slot", "source")
    ranked = saved(_running(dealt, ["source"], F.floor(F.col("slot") / SLOT_PART), [F.col("slot")], F.lit(1), "rank"))
    got = ranked.groupBy("source").agg(F.count("*").alias("got")).withColumnRenamed("source", "_s")
    short = goals.join(got, goals["source"].eqNullSafe(got["_s"]), "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col("got") < F.col("slots"))
    short = short.select("source", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank")).select((F.col("rank") + n).alias("slot"), "source", "rank")
    own = goals.select(F.col("source").alias("_s"), "goal", "source_size", "blocks", "slots")
    all_slots = ranked.select("slot", "source", "rank").union(short).join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("rank") < F.col("slots")))
    passes, at = F.floor(F.col("rank") / F.col("blocks")).cast("long"), F.col("rank") % F.col("blocks")
    taken_before = passes * F.col("source_size") + at * block
    end = F.least(F.lit(block), F.col("source_size") - at * block, F.col("goal") - taken_before)
    return all_slots.select("slot", "source", passes.alias("pass"), at.alias("block"), end.cast("long").alias("to_word"))


def laid_out(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """sizes' rows with words, in a shuffled order within their source, with `start`: the words of the source before them.

    A source's order is cut into parts of about PART_ROWS. Ties, that is equal ids, go by size and text; after that the rows are alike.
    """
    parts = goals.select(F.col("source").alias("_g"), "docs", "source_size", "target")
    out = sizes.join(parts, sizes["source"].eqNullSafe(parts["_g"])).drop("_g")
    shuffled = F.xxhash64(F.col("id"), F.lit("shuffle"))
    part = F.pmod(F.when(F.col("id").isNull(), F.col("copy.a")).otherwise(shuffled), F.greatest(F.lit(1), F.ceil(F.col("docs") / PART_ROWS)).cast("long"))
    order = [shuffled, F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size"), F.col("copy")]
    return _running(out, ["source"], part, order, F.col("size"), "start").drop("docs")


def _copy(*cols: Column) -> Column:
    """Two hashes of what makes a row, 128 bits together; rows of equal hashes are alike."""
    return F.struct(F.xxhash64(*cols, F.lit("copy")).alias("a"), F.xxhash64(F.lit("again"), *cols).alias("b"))


def _whole(docs: DataFrame) -> list[Column]:
    """All columns of docs, such as can't be hashed as JSON."""
    return [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c for c, (_, kind) in zip(others(docs, []), docs.dtypes)]


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, alike: list[Column] | None = None) -> DataFrame:
    """(id, source, copy, size, source_size, target, start, taken, slots) for every row of docs; slots: pass by pass, the slot that takes its first word. copy: a key of the columns by which rows are alike, of those three by default."""
    copy = _copy(*(alike or [F.col(id_col), F.col(source_col), F.col(text_col)]))
    sizes = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), copy.alias("copy"), n_words(text_or_empty(text_col)).alias("size")))
    goals = saved(targets(sizes))
    slots = schedule(goals, block)
    rows = laid_out(sizes, goals)
    spread = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    uses = slots.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "slot", "to_word"))).alias("uses")).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "uses")
    met = spread.join(uses, spread["source"].eqNullSafe(uses["_s"]) & (spread["block"] == uses["_b"]), "left")
    met = met.withColumn("uses", F.coalesce("uses", F.array().cast("array<struct<pass: bigint, slot: bigint, to_word: bigint>>")))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.col("start") + F.col("size") - F.col("block") * block
    words = F.aggregate("uses", F.lit(0).cast("long"), lambda acc, u: acc + F.greatest(F.lit(0), F.least(high, u["to_word"]) - low))
    begins = F.when(F.col("block") == F.floor(F.col("start") / block), F.transform(F.filter("uses", lambda u: u["to_word"] > low), lambda u: u["slot"]))
    one = ["id", "source", "copy", "start", "size", "source_size", "target"]
    sums = met.select(*one, words.alias("words"), begins.alias("begins")).groupBy(*one).agg(F.sum("words").alias("taken"), F.max("begins").alias("slots"))
    none = rows.where("size = 0").select(*one, F.lit(0).cast("long").alias("taken"), F.array().cast("array<bigint>").alias("slots"))
    return sums.unionByName(none)


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """(id, source, size, source_size, target, taken, position) for every row of docs; position: the slot of the mix that first takes a word of it, else null.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own. Texts of any length are spread over as many blocks as they fill.
    Rows with equal ids, and equal rows, each keep a row. Columns of docs but the three named play no part. No rows: no rows.
    """
    out = placed(docs, id_col, text_col, source_col, block)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, F.get("slots", F.lit(0))).alias("position"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "position")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """docs' rows in the order of the schedule, as often as their words are taken, to the nearest whole number: a source's words differ from its target by
    a document at most.

    A copy stands where its pass takes the row's first word; a copy that only rounding gives stands where its last words are. Equal rows are each taken as often as their own words are. The
    order is that of the partitions and of the rows in them. Columns are docs' own, whatever their names; null, empty and blank texts are not in the mix. No rows: no rows.
    """
    (key, copies, at, slot) = fresh(docs, "copy_key", "copies", "start_word", "slot")
    alike = _whole(docs)
    used = placed(docs, id_col, text_col, source_col, block, alike).where("size > 0").withColumn("times", F.round(F.col("taken") / F.col("size")).cast("int"))
    slots = F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda i: F.coalesce(F.get("slots", i), F.element_at("slots", -1), F.lit(0)))
    used = saved(used.select(F.col("copy").alias(key), "start", F.when(F.col("times") > 0, slots).alias("slots")))
    rows = used.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("start", "slots")).alias(copies))
    keyed = docs.withColumn(key, _copy(*alike))
    out = keyed.join(rows.where((F.col("n") == 1) & F.col(copies)["slots"].isNotNull()).drop("n"), key)
    again = saved(rows.where("n > 1").select(key))
    if not again.isEmpty():  # one of each group of equal rows stands for all of them, and each has its own uses
        one = keyed.join(again, key, "left_semi").dropDuplicates([key])
        out = out.unionByName(one.join(used.where("slots is not null").join(again, key, "left_semi").select(key, F.struct("start", "slots").alias(copies)), key))
    out = out.select("*", F.col(f"{copies}.start").alias(at), F.explode(f"{copies}.slots").alias(slot))
    return out.repartitionByRange(slot, at).sortWithinPartitions(slot, at).drop(key, copies, at, slot)
