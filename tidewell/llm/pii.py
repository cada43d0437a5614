"""Personal data: spans by weak supervision.

Strict patterns give the base spans. What they match without passing their tests (a card number with a wrong check digit, a part above 255, too few
digits) and the matches of looser patterns are further candidates. Labelers (pattern, gazetteer, context, shape) vote on every candidate;
expectation-maximisation estimates each labeler's reliability from how the votes agree over the whole corpus, and a final classifier, trained on the posteriors,
decides on the candidates that are not base spans. Only DataFrame functions see rows; the driver sees the numbers of vote patterns, of which there are at
most 4 * 3**4 * 9.

Texts are read whole, however long and however full of matches, in time that grows little faster than their length. A null or empty text has no spans. Repeated rows and ids each count and are each judged alike. Of candidates of one kind that
overlap, base spans win, then near misses, then the looser patterns in order. Votes look at the 40 characters before a candidate on its own line and at the next one after it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, others, saved, table, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
MARK = "\x01"
#: Matches of a text that are gathered one by one; an even number.
CHUNK = 128
#: Java patterns. Each starts where a run begins or the last match ended, and loops are possessive, so long runs cost no more than their length.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text may hold a match.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "card": ""}
#: Looser patterns: addresses with words or brackets for their signs or without a dot; long and shortened IPv6, and bracketed dots; card numbers with dots,
#: slashes or wide gaps; national phone numbers and those with 00 for the plus. A run of characters that can begin a match is tried at its start alone.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)| at (?=[A-Za-z0-9-]{1,63}+ dot )|@(?![A-Za-z0-9-]++\.[A-Za-z0-9-])) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z0-9-]{1,63}+){0,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:{1,2}+){2,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])|(?<![0-9])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9./-])[0-9]{4,6}+(?:[ ./-]{1,3}+[0-9]{2,7}+){2,4}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(./-])(?!(?:[0-9]++\.){3})(?:00[1-9][0-9]{0,2}+[ /-]|0[1-9][0-9]{1,4}+[ /-]|\([0-9]{3,5}\) ?|[0-9]{3}[-. ])[0-9]{2,4}+(?:[-. ][0-9]{2,4}+){1,3}+(?![0-9])",
}
#: Cheap tests that a text may hold a match, any of them; those of phones are the separators between digits.
LOOSE_NEEDS = {"email": "(at)|[at]|@| dot ", "ip": ":|[.]", "card": r"~[0-9]{4}[ ./-]{1,3}[0-9]{2}", "phone": r"~[0-9][-. )/]"}
#: What the text of a loose match must be to be a candidate at all.
LOOSE_DIGITS = {"card": (13, 19), "phone": (8, 15)}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?:(?!0\.|127\.|10\.|192\.168\.|255\.)[0-9]++(?:\.|\[)|[23][0-9A-Fa-f]{3}:|[Ff][DdEe][0-9A-Fa-f]{2}:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2})",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|from|to|cc)\b[^\n]{0,12}$",
    "ip": r"(?i)\b(?:ip|address|host|server|client|from|login)\b[^\n]{0,12}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pan|payment)\b[^\n]{0,12}$",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|contact|dial)\b[^\n]{0,12}$",
}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|order|invoice|serial|part|section|ref|sku|id|date|at|doi|no)\b[^\n]{0,8}$"
VOTES = ["pattern", "gazetteer", "context", "shape"]
FEATURES = ["before", "after"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    d = F.reverse(_digits(c))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _octets_ok(c: Column) -> Column:
    """Every part is at most 255, however many zeros lead it."""
    return F.forall(F.split(c, r"\."), lambda p: F.lpad(F.ltrim(p, F.lit("0")), 3, "0").between("000", "255") & (F.length(F.ltrim(p, F.lit("0"))) <= 3))


def valid(kind: str, c: Column) -> Column:
    """Whether a match of a base pattern counts."""
    n = F.length(_digits(c))
    if kind == "ip":
        return _octets_ok(c)
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(c)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda's variable is, and an expression inside a lambda is for each element."""
    return F.transform(F.array(value), use)[0]


def _in_chunks(n: Column, total: Callable[[Column], Column], combine: Callable[[Column, Column], Column], fold: Callable[[Column, Column], Column]) -> Column:
    """The arrays fold(first, carry) of the chunks of n > 0 places, joined; carry: the totals of the chunks before, combined, 0 to begin with.

    An array that grows by one element at a time is copied each time, so only arrays of a chunk grow so, and one with an element for each chunk.
    """
    firsts = F.sequence(F.lit(0), n - 1, F.lit(CHUNK))
    begin = F.struct(F.lit(0).alias("carry"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(combine(acc["carry"], x).alias("carry"), F.concat(acc["out"], F.array(acc["carry"])).alias("out"))
    carries = F.aggregate(F.transform(firsts, total), begin, step, lambda acc: acc["out"])
    return _let(carries, lambda carry: F.flatten(F.transform(firsts, lambda first, i: fold(first, F.get(carry, i)))))


def _matches(text: Column, pattern: str, need: str) -> Column:
    """array<struct<start, end, hit, before, after>> of a pattern's leftmost matches, in code points, end exclusive."""
    kind = "array<struct<start: int, end: int, hit: string, before: string, after: string>>"
    none = F.array().cast(kind)

    def fold(parts: Column) -> Column:
        """Over the parts of odd number, which are the matches."""
        n = F.size(parts)

        def step(acc: Column, at: Column) -> Column:
            start = acc["pos"] + F.length(parts[at - 1])
            end = start + F.length(parts[at])
            hit = F.struct(start.alias("start"), end.alias("end"), parts[at].alias("hit"), F.right(parts[at - 1], F.lit(40)).alias("before"), F.left(parts[at + 1], F.lit(1)).alias("after"))
            return F.struct(end.alias("pos"), F.concat(acc["found"], F.array(hit)).alias("found"))

        def of_chunk(first: Column, carry: Column) -> Column:
            last = F.least(first + CHUNK - 1, n - 2)
            hits = F.aggregate(F.sequence(first + 1, last, F.lit(2)), F.struct(carry.alias("pos"), none.alias("found")), step, lambda acc: acc["found"])
            return F.when(first < last, hits).otherwise(none)

        length = lambda first: F.aggregate(F.sequence(first, F.least(first + CHUNK - 1, n - 1)), F.lit(0), lambda s, at: s + F.length(parts[at]))
        return _in_chunks(n, length, lambda a, b: a + b, of_chunk)

    found = _let(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1), fold)
    may = F.lit(not need)
    for n in need.split("|") if need[:1] != "~" else []:
        may = may | F.contains(text, F.lit(n))
    if need[:1] == "~":
        may = F.regexp_like(text, F.lit(need[1:]))
    return F.when(may & F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _keep(found: Column, good: Callable[[Column], Column]) -> Column:
    return F.filter(found, lambda m: good(m["hit"]))


def _free(found: Column, taken: Column) -> Column:
    """Those that overlap none of the others, which are in order and apart: only the last that begins before one's end can, and halving finds it."""

    def halved(range_: Column, end: Column) -> Column:
        low, high = range_["low"], range_["high"]
        middle = F.shiftright(low + high, 1)
        before = F.get(taken, middle)["start"] < end
        return F.when(low >= high, range_).otherwise(F.struct(F.when(before, middle + 1).otherwise(low).alias("low"), F.when(before, high).otherwise(middle).alias("high")))

    def free(m: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(taken) + 1)).cast("int"))
        begun = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(taken).alias("high")), lambda r, _: halved(r, m["end"]), lambda r: r["low"])
        return F.coalesce(F.get(taken, begun - 1)["end"] <= m["start"], F.lit(True))

    return F.when(F.size(taken) == 0, found).otherwise(F.filter(found, free))


def _votes(found: Column, kind: str, number: int, base: bool, loose: bool = False) -> Column:
    return F.transform(found, lambda m: _vote(m, kind, number, base, loose))


def _of(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _long_enough(kind: str, c: Column) -> Column:
    return F.length(_digits(c)).between(*LOOSE_DIGITS[kind])


def candidates(docs: DataFrame, out: str, text_col: str = "text") -> DataFrame:
    """docs with a column `out`: array<struct<kind int, start, end, base, votes..., features...>>, by kind, then base, near misses and loose ones."""
    (text, *own) = fresh(docs, "text_read", *[f"{k}_matches" for k in KINDS])
    read = docs.withColumn(text, F.replace(text_or_empty(text_col), F.lit(MARK), F.lit("\x02")))
    lists = []
    for number, kind in enumerate(KINDS):
        read = read.withColumn(own[number], _matches(F.col(text), BASE[kind], NEEDS[kind]))
        found, good = F.col(own[number]), partial(valid, kind)
        loose = _matches(F.col(text), LOOSE[kind], LOOSE_NEEDS[kind])
        if kind in LOOSE_DIGITS:
            loose = _keep(loose, partial(_long_enough, kind))
        lists += [_votes(_keep(found, good), kind, number, True), _votes(_keep(found, lambda c, good=good: ~good(c)), kind, number, False), _votes(_free(loose, found), kind, number, False, loose=True)]
    return read.withColumn(out, F.concat(*lists)).drop(text, *own)


def _vote(m: Column, kind: str, number: int, base: bool, loose: bool) -> Column:
    """Votes: 1 for, -1 against, 0 abstains. A near miss of a strict pattern is against; of the loose matches only card numbers have a test to pass."""
    digits = F.length(_digits(m["hit"]))
    pattern = F.lit(1 if base else 0 if loose else -1)
    if loose and kind == "card":
        pattern = F.when(_luhn(m["hit"]), 1).otherwise(-1)
    if loose and kind == "email":  # a lone @ without a dot behind it is no address
        pattern = F.when(F.rlike(m["hit"], F.lit(r"@[^.]*$")), -1).otherwise(0)
    if loose and kind == "ip":  # eight groups or two colons in a row; a time of day has neither
        pattern = F.when(F.contains(m["hit"], F.lit("[")) | F.rlike(m["hit"], F.lit(r"^(?:[^:]+:){7}[^:]+$")), 1).when(F.contains(m["hit"], F.lit("::")), 0).otherwise(-1)
    shape = {
        "email": F.when(F.length(m["hit"]) > 80, -1).otherwise(F.when(F.length(m["hit"]) >= 8, 1).otherwise(0)),
        "ip": F.when(F.rlike(m["hit"], F.lit(r"(?:^|\.)0[0-9]|^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?$")), -1).otherwise(1),
        "card": F.when(digits.isin(15, 16), 1).otherwise(0),
        "phone": F.when(digits.between(10, 13), 1).otherwise(-1),
    }[kind]
    context = F.when(F.rlike(m["before"], F.lit(CONTEXT[kind])), 1).when(F.rlike(m["before"], F.lit(AGAINST)), -1).otherwise(0)
    kind_of = lambda c: F.when(c == "", 0).when(F.rlike(c, F.lit(r"^\s$")), 1).otherwise(2)
    return F.struct(
        F.lit(number).alias("kind"),
        m["start"].alias("start"),
        m["end"].alias("end"),
        F.lit(base).alias("base"),
        pattern.cast("int").alias("pattern"),
        F.when(F.rlike(m["hit"], F.lit(GAZETTEER[kind])), 1).otherwise(-1).alias("gazetteer"),
        context.alias("context"),
        shape.alias("shape"),
        kind_of(F.right(m["before"], F.lit(1))).alias("before"),
        kind_of(m["after"]).alias("after"),
    )


def fit(spans: DataFrame, col: str = "spans", rounds: int = 25) -> dict[str, float]:
    """Log odds by "kind:field:value" ("kind" alone: the prior's) that a candidate is personal data, from the numbers of vote patterns."""
    e = spans.select(F.explode(col).alias("s")).select("s.*")
    rows = [r.asDict() for r in e.groupBy("kind", *VOTES, *FEATURES).count().collect()]
    odds: dict[str, float] = {}
    for kind in range(len(KINDS)):
        own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: [r[f] for f in VOTES + FEATURES])
        if not own:
            continue
        post = [1 / (1 + math.exp(-2.0 * (r["pattern"] + sum(r[v] for v in VOTES) - 1))) for r in own]  # to begin with, patterns count twice

        def reliability(fields: list[str], post=post, own=own) -> tuple[dict, float]:
            """By field, value and class, the smoothed share; and the prior."""
            mass = [1.0 + sum((1 - p) * r["count"] for p, r in zip(post, own)), 1.0 + sum(p * r["count"] for p, r in zip(post, own))]
            seen: dict = defaultdict(lambda: [0.0, 0.0])
            for p, r in zip(post, own):
                for f in fields:
                    seen[f, r[f]][1] += p * r["count"]
                    seen[f, r[f]][0] += (1 - p) * r["count"]
            return {k: math.log((v[1] + 1) / (mass[1] + 3)) - math.log((v[0] + 1) / (mass[0] + 3)) for k, v in seen.items()}, math.log(mass[1] / mass[0])

        for _ in range(rounds):
            share, prior = reliability(VOTES)
            post = [1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(share[v, r[v]] for v in VOTES))))) for r in own]
        share, prior = reliability(VOTES + FEATURES)
        odds[str(kind)] = prior
        odds |= {f"{kind}:{f}:{v}": x for (f, v), x in share.items()}
    return odds


def decided(spans: Column, odds: dict[str, float]) -> Column:
    """The base spans, and the candidates that the classifier accepts, as array<struct<kind, start, end, base>> by kind and start."""
    lookup = F.create_map(*[F.lit(x) for k, v in (odds or {"": 0.0}).items() for x in (k, v)])
    value = lambda s, f: F.coalesce(F.element_at(lookup, F.concat_ws(":", s["kind"].cast("string"), F.lit(f), s[f].cast("string"))), F.lit(0.0))

    def accepted(s: Column) -> Column:
        total = F.coalesce(F.element_at(lookup, s["kind"].cast("string")), F.lit(0.0))
        for f in VOTES + FEATURES:
            total = total + value(s, f)
        return s["base"] | (total > 0)

    return F.array_sort(F.transform(F.filter(spans, accepted), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; spans that overlap become one, named for the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def pieces(order: Column) -> Column:
        furthest = lambda first: F.array_max(F.transform(F.slice(order, first + 1, F.lit(CHUNK)), lambda s: s["end"]))

        def of_chunk(first: Column, carry: Column) -> Column:
            """The pieces of a chunk's spans, cut from the part of the text that they lie in, which begins at carry."""
            own = F.substring(text, carry + 1, F.greatest(furthest(first), carry) - carry)

            def cut(part: Column) -> Column:
                def step(acc: Column, s: Column) -> Column:
                    more = F.concat(acc["out"], F.array(F.substring(part, acc["at"] - carry + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1)))
                    return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

                begin = F.struct(carry.alias("at"), F.array().cast("array<string>").alias("out"))
                return F.aggregate(F.slice(order, first + 1, F.lit(CHUNK)), begin, step, lambda acc: acc["out"])

            return _let(own, cut)

        end = F.array_max(F.transform(order, lambda s: s["end"]))
        return F.concat(F.array_join(_in_chunks(F.size(order), furthest, F.greatest, of_chunk), ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _let(order, pieces)).otherwise(text)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with `found`: every span, as array<struct<kind, start, end, base>>; a column of that name is replaced. No rows: no rows."""
    (name,) = fresh(docs, "spans")
    spans = saved(candidates(docs, name, text_col).select(*others(docs, [text_col, "found"]), name))
    return spans.select(*others(spans, [name]), decided(F.col(name), fit(spans, name)).alias("found"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the personal data in their texts masked, and their own columns, whatever their names. Null texts stay null; no rows: no rows."""
    (name,) = fresh(docs, "spans")
    found = saved(candidates(docs, name, text_col))
    return found.withColumn(text_col, redacted(F.col(text_col), decided(F.col(name), fit(found, name)))).drop(name)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda s: s["base"])
    counts = [F.size(_of(base, n)).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
