"""Readers with explicit schemas, and the guards around them. Nothing is inferred, so no file is read twice."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import order, split_csv

#: What a NULL-aware text scan takes for missing; fixed values.
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def resolve_path(variable: str, default: str) -> str:
    """A path that the environment may override."""
    return os.environ.get(variable) or default


def require_path(spark: SparkSession, path: str) -> str:
    """FileNotFoundError unless path exists in its own file system, local or not."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    return path


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return df


def require_arity(df: DataFrame, least: int) -> DataFrame:
    if len(df.columns) < least:
        raise ValueError(f"{least} columns expected, {len(df.columns)} found")
    return df


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def add_missing(df: DataFrame, columns: list[str], value: Column | None = None) -> DataFrame:
    """df with those of columns that it lacks, as empty strings or value."""
    return df.withColumns({c: F.lit("") if value is None else value for c in columns if c not in df.columns})


#: A table is dealt over all cores only up to this many bytes, so what that shuffles does not grow with the input.
DEALT_BYTES = 32 << 20  # of files, for each task that rows are dealt to
SMALL_BYTES = 64 << 20


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def deal_small(df: DataFrame) -> DataFrame:
    """A small file, which may be one row group, over all cores; anything larger as it is split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _bytes(df) <= SMALL_BYTES and df.rdd.getNumPartitions() < cores else df


def deal(df: DataFrame) -> DataFrame:
    """deal_small, and larger files too if one task would have over twice its share of the rows: files are split by bytes, but a row
    group has one reader. Rows of tasks are counted without reading a column."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    dealt = deal_small(df)
    if dealt is not df:
        return dealt
    rows = [r["count"] for r in df.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()]
    return df.repartition(max(2 * cores, _bytes(df) // DEALT_BYTES)) if cores * max(rows, default=0) > 2 * sum(rows) else df


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    rows = spark.read.option("sep", sep).option("header", True).option("escape", '"').option("maxColumns", 20480).csv(path)
    return rows.columns


def _size(spark: SparkSession, path: str) -> int:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def fingerprint(spark: SparkSession, path: str) -> list[list]:
    """Name, length and time of change of each file at path, in order. FileNotFoundError if there is nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(require_path(spark, path))
    files, found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True), []
    while files.hasNext():
        f = files.next()
        found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(found)


def read_csv(spark: SparkSession, path: str, na: str = "keep", columns: list[str] | None = None, split: bool | None = None, row_no: str | None = None) -> DataFrame:
    """All columns as strings. na="keep": nothing is missing, blanks are empty strings; na="null": NA_VALUES are NULL.

    Bytes that are not UTF-8 become U+FFFD. Quoted line breaks stay in their cell. split: many tasks read a file (see split_csv), one
    reads a file as a whole otherwise, with equal rows; None: if there are more than SMALL_BYTES. row_no: a column of that name
    numbers the rows from 0 on, by the names of files and the order in each.
    """
    names = columns or _header(spark, require_path(spark, path), ",")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    options = {"header": "true", "multiLine": "true", "escape": '"'}
    if split or split is None and _size(spark, path) > SMALL_BYTES:
        cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(names))), {"multiLine": "true", "escape": '"', "maxColumns": "20480"})
        df = split_csv.records(spark, path).select("block", "row", cells.alias("cells"))
        df = df.select(F.struct(*[F.col(f"cells.c{i}").alias(n.strip()) for i, n in enumerate(names)]).alias("cells"), "block", "row")
    else:
        df = spark.read.schema(schema).options(**options).csv(path)
        df = df.select(F.struct(*[F.col(f"`{n}`").alias(n.strip()) for n in names]).alias("cells"), order.place().alias("_place"))
        df = df.select("cells", F.col("_place.file").alias("block"), F.col("_place.row").alias("row"))  # one block a file
    if row_no:
        df = order.number_rows(df, row_no, "block", "row")
    cell = (lambda c: F.coalesce(c, F.lit(""))) if na == "keep" else (lambda c: F.when(~c.isin(NA_VALUES), c))
    return df.select([cell(F.col("cells").getField(n.strip())).alias(n.strip()) for n in names] + ([F.col(row_no)] if row_no else []))


def read_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of schema (as in "id int, name string") with their types; NA_VALUES and cells that are not of their type are NULL. Columns that the file lacks are an error."""
    wanted = T._parse_datatype_string(schema)
    df = require_columns(read_csv(spark, path, na="null"), wanted.names)
    return df.select([F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def read_tsv(spark: SparkSession, path: str, names: list[str], na: str = "null") -> DataFrame:
    """A file without a header, addressed by position; fields beyond names are dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(require_path(spark, path))
    return df.select([F.when(~F.col(c).isin(NA_VALUES), F.col(c)).alias(c) for c in names]) if na == "null" else df


def read_tsv_any(spark: SparkSession, path: str, least: int) -> DataFrame:
    """A headerless file of unknown width, at least `least` columns, named _c0 and on."""
    return require_arity(spark.read.option("sep", "\t").option("header", False).option("quote", "").csv(require_path(spark, path)), least)


def first_and_last(df: DataFrame, k: int, names: tuple[str, str]) -> DataFrame:
    """Column k and the last one."""
    return df.select(F.col(df.columns[k]).alias(names[0]), F.col(df.columns[-1]).alias(names[1]))


def read_class_xml(spark: SparkSession, path: str, row_tag: str = "drug") -> DataFrame:
    """generic_name, drug_class of each record with a name; names once, with the class of their first record, by the names of files and the order in each."""
    schema = "name STRING, classification STRUCT<`direct-parent`: STRING>"
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(require_path(spark, path))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    df = df.select("name", "classification", order.place().alias("_row")).filter("name IS NOT NULL")
    df = df.select(strip(F.lower("name")).alias("generic_name"), F.coalesce(strip(F.col("classification.direct-parent")), F.lit("")).alias("drug_class"), "_row")
    return df.groupBy("generic_name").agg(F.min_by("drug_class", "_row").alias("drug_class"))
