"""Neighbours in an order, without a task per key: rows are windowed within (key, block), and blocks are linked by their end rows.

A block is a fixed stretch of the ordering column, so the rows of one task are bounded by what a block holds, and the second window
sees one row per block of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbour(df: DataFrame, keys: list[str], block: Column, order: list[Column], row: Column, name: str, forward: bool = False) -> DataFrame:
    """df with column name: the struct row of the next (forward) or previous row of the key, null at the end.

    order must be a total order of the key's rows that is compatible with block. Keys and rows mustn't be null."""
    d = df.withColumn("nb__block", block).withColumn("nb__row", row)
    within = Window.partitionBy(*keys, "nb__block").orderBy(*order)
    step = F.lead("nb__row") if forward else F.lag("nb__row")
    d = d.withColumn("nb__in", step.over(within))
    edge = F.struct(*order, F.col("nb__row").alias("r"))
    edges = d.groupBy(*keys, "nb__block").agg((F.min if forward else F.max)(edge).alias("e"))
    across = Window.partitionBy(*keys).orderBy("nb__block")
    links = edges.select(*keys, "nb__block", (F.lead if forward else F.lag)(F.col("e.r")).over(across).alias("nb__link"))
    j = d.join(links, [*keys, "nb__block"], "left")
    return j.withColumn(name, F.coalesce("nb__in", "nb__link")).drop("nb__block", "nb__row", "nb__in", "nb__link")
