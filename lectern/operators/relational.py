"""Relational steps that curation shares: unions, groups, ranks and heads, with every order made total."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_fill(df: DataFrame, values: dict) -> DataFrame:
    """df with NULL of the named columns replaced; columns that it lacks are skipped."""
    return df.na.fill({c: v for c, v in values.items() if c in df.columns})


def semi_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among keys; a NULL key is not."""
    return df.join(keys.select(key), key, "left_semi")


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all, columns by name; repeated rows stay."""
    return reduce(DataFrame.unionByName, others, first)


def ordered_union(parts: list[DataFrame], key: str, place: str) -> DataFrame:
    """key, part, place: each key once, where it first stands: in the first part that has it, at its least place there."""
    numbered = [p.select(key, F.lit(i).alias("part"), place) for i, p in enumerate(parts)]
    first = union_all(*numbered).groupBy(key).agg(F.min(F.struct("part", place)).alias("_f"))
    return first.select(key, F.col("_f.part").alias("part"), F.col(f"_f.{place}").alias(place))


def tagged_distinct(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Different rows of all parts, each with the name of its part."""
    return union_all(*[p.withColumn(tag, F.lit(name)) for name, p in parts.items()]).dropDuplicates()


def group_list(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """All values of each group in order, comma-joined."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)).cast("array<string>"), ",").alias(name))


def unique_set(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.select(value.alias(name)).distinct()


def count_distinct(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: the number of different values of each column, under its name."""
    return df.agg(*[F.count_distinct(c).alias(n) for c, n in columns.items()])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Groups with their number of rows, most first, equals in order."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def longest_by_key(df: DataFrame, key: str, text: str, row: str) -> DataFrame:
    """key, row, n: of each key the row with the longest text, the least row of equals. Pre-aggregated, no sort."""
    best = F.max_by(F.struct(F.col(row), F.length(text).cast("long").alias("n")), F.struct(F.length(text), -F.col(row)))
    return df.groupBy(key).agg(best.alias("_b")).select(key, f"_b.{row}", "_b.n")


def sorted_head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows; order must be total."""
    return df.orderBy(*order).limit(n)


def head_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by `order`, numbered from 1. The window sees n rows only."""
    return df.orderBy(order).limit(n).withColumn("k", F.row_number().over(Window.orderBy(order)).cast("long"))


def ranked_dedupe(df: DataFrame, group: str, row: str, order: list[Column], fetch: int, keep: int) -> DataFrame:
    """Of each group the first `fetch` rows by order, of those each `row` once (blank ones are never merged), and of those
    the first `keep`, with their place."""
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    top = df.withColumn("place", place(group)).filter(F.col("place") <= fetch)
    named = F.coalesce(F.col(row).cast("string"), F.lit("")) != ""
    once = top.withColumn("_again", place(group, row)).filter(~named | (F.col("_again") == 1)).drop("_again")
    return once.withColumn("place", place(group)).filter(F.col("place") <= keep)


def first_k(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """keys and value: of each group its first k different values in order, a row each; a group of nulls only has one row, of null.

    Values are made different in a shuffle by themselves, and each task hands on at most k of a group before the next one, so
    no group's set is gathered whole, however many values it has.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    return df.select(*keys, value).distinct().withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).drop("_place")


def first_of_sorted_set(df: DataFrame, key: str, value: Column, k: int, name: str) -> DataFrame:
    """The first k different values of each key, in order, comma-joined."""
    some = first_k(df.select(key, value.alias(name)), [key], name, k)
    return some.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias(name))  # at most k


def share_known(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, known, known_pct: how many rows of each key have the column, and what share that is."""
    from ..functions.exprs import percent

    known = F.count(column)
    return df.groupBy(key).agg(known.alias("known"), F.round(percent(known, F.count("*")), 4).alias("known_pct"))
