"""Numbers and labels that need more than one task: places in an order, connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved


def numbered(rows: DataFrame, within: list[str], order: list, name: str) -> DataFrame:
    """rows with their place (from 0) within each scope. Ranges are sorted side by side, then each gets the number of rows in the ranges before it, so no task sees a whole scope.

    The order must be total within a scope, else ties take any order among themselves.
    """
    parts = rows.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    parts = saved(parts.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = parts.groupBy(*within, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each range and scope in it
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(w).alias(f"_{w}") for w in within], F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for w in within:
        same &= F.col(w).eqNullSafe(F.col(f"_{w}"))
    return parts.join(offsets, same).withColumn(name, F.col("_at") + F.col("_shift")).select(*rows.columns, name)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for edges (a, b): the smallest node that a node is connected to. Each round takes the smallest label around, then that label's own."""
    both = saved(edges.select("a", "b").unionAll(edges.select("b", "a")).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        further = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = saved(lower.join(further, "comp", "left").select("node", "old", F.least("comp", "far").alias("comp")))
        labels = new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            return labels
