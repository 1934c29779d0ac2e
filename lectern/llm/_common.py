"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks remember results for words up to this long only, so that a bound on entries bounds memory.
LONGEST_REMEMBERED = 128

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A table of documents is dealt over all cores only up to this many bytes, so what that shuffles does not grow with the input.
SMALL_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files are split; a small file of documents (SMALL_BYTES), which may be one row group, is dealt over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name != "documents" or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts, the common case, take the vectorised path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_or_empty(docs: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a local master may do with a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; it goes when the driver's JVM ends.

    Unlike cached blocks, it outlives executors, and a later stage reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def power_of_two(n: int, least: int, most: int) -> int:
    return max(least, min(most, 1 << max(0, int(n) - 1).bit_length()))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of whole texts in parts of at most `rows` rows, so that what a worker makes of one at a time stays small. Nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def boxed(docs: DataFrame) -> Column:
    """All columns of docs as one struct column, so that none clashes with an operator's own."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_box")


def unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("_box").getField(c).alias(c) for c in docs.columns])
