"""Headlines: publishers' names in them, and headlines without them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import host, hostname


def _last(c: Column, mark: str) -> Column:
    """Characters before the last mark; -1 if there is none."""
    behind = F.length(F.substring_index(c, mark, -1))
    return F.when(F.contains(c, F.lit(mark)), F.length(c) - behind - len(mark)).otherwise(-1)


def cut_at_last(c: Column, mark: str, more_than: int = 0) -> Column:
    at = _last(c, mark)
    return F.when(at > more_than, F.trim(F.substring(c, F.lit(1), at))).otherwise(c)


def publisher(c: Column) -> Column:
    """The name behind the last " - "; null without one."""
    at = _last(c, " - ")
    return F.when((at > 0) & (at < F.length(c) - 3), F.trim(F.substring_index(c, " - ", -1)))


def without_publisher(c: Column) -> Column:
    return cut_at_last(c, " - ")


def clean(c: Column) -> Column:
    """Without what follows the last en dash or bar, if more than eight characters stand before it."""
    return cut_at_last(cut_at_last(c, " – ", 8), " | ", 8)


def source_name(name: Column, title: Column, fallback: Column) -> Column:
    """A readable publisher: the item's, unless it is the aggregator's own or an address; then the title's, then the host's first label."""
    own = F.coalesce(F.nullif(name, F.lit("")), fallback)
    address = F.startswith(own, F.lit("http")) | F.contains(own, F.lit("://"))
    label = F.split(host(own), r"\.")[0]
    from_host = F.when(address, F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, F.lit(2), F.length(label))))
    vague = (own == "Google News") | F.contains(own, F.lit("news.google.com")) | address
    return F.when(vague, F.coalesce(publisher(title), from_host, own)).otherwise(own)


def feed_title(title: Column, description: Column, url: Column) -> Column:
    """A feed's title, else its description, else its host."""
    given = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(given(title), given(description), given(hostname(url)), F.lit("Unknown Source"))
