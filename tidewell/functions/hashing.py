"""The short hash of identifiers: h * 31 + character in 32 bits, its absolute value in base 36."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(c: Column) -> Column:
    chars = F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    start, half, full = F.lit(0).cast("long"), 1 << 31, 1 << 32
    value = F.aggregate(chars, start, lambda h, x: F.pmod(h * 31 + F.ascii(x) + half, F.lit(full)) - half)
    return F.lower(F.conv(F.abs(value).cast("string"), 10, 36))


def set_id(ids: Column, prefix: str = "cluster-") -> Column:
    """One id for a set of ids, whatever their order."""
    return F.concat(F.lit(prefix), short_hash(F.array_join(F.array_sort(ids), "|")))
