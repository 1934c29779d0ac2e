"""The order of rows in files: by the file's name, then as they stand in it, however Spark packs blocks of files into tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sinks


def place() -> Column:
    """The place of a row of a scan, to order by: file, start of the block, number among the rows of its task, which reads a block
    from its start to its end. Spark deals blocks to tasks by size, so the number alone is no order of files."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def number_rows(df: DataFrame, name: str, block: str, row: str) -> DataFrame:
    """df with a column `name`: 0, 1, 2, ... in the order of blocks and of rows in each, without bringing rows to one task.

    block orders the blocks; row numbers a block's rows without a gap, from any number on. Both go. Only counts, one for each
    block, are summed up in one task and joined back.
    """
    df = sinks.materialize(df, "placed")  # numbers of tasks and rows are fixed from here on
    counts = df.groupBy(F.col(block).alias("_b")).agg(F.count("*").alias("_n"), F.min(row).alias("_least"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n") - F.col("_least")).alias("_shift"))
    out = df.join(before, F.col(block) == F.col("_b"))
    return out.withColumn(name, F.col(row) + F.col("_shift")).drop(block, row, "_b", "_shift")
