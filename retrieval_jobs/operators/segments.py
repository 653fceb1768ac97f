"""Scans over the rows of a key that are cut to blocks, so that no key is one task.

Each block is scanned for itself; block totals, one row a block, are scanned over the blocks of their key and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
ROWS = 4096


def blocked(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with _block, the number of the block of their order."""
    return rows.withColumn("_block", F.floor(F.col(order) / ROWS))


def within(keys: list[str], order: str, last: int = 0) -> Window:
    """From the start of a block to the row itself, or ``last`` rows after it."""
    return Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, last)


def earlier(keys: list[str]) -> Window:
    """The blocks before a block."""
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def totals(rows: DataFrame, keys: list[str], **of: Column) -> DataFrame:
    return rows.groupBy(*keys, "_block").agg(*[c.alias(name) for name, c in of.items()])


def carried(rows: DataFrame, keys: list[str], blocks: DataFrame) -> DataFrame:
    """``rows`` with the columns of their block; rows with a null key have none, each of their blocks stands alone."""
    return rows.join(blocks, [*keys, "_block"], "left")
