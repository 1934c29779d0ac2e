"""Writers. Every one overwrites what it wrote before."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode("overwrite").options(header="true", escape='"', emptyValue="", **blanks).csv(path)


def write_offenders(offenders: DataFrame, path: str) -> None:
    """A folder for each column and check. offenders: column_name, check_name and the row."""
    offenders.write.mode("overwrite").partitionBy("column_name", "check_name").option("header", True).option("escape", '"').csv(path)


def write_json_report(report: dict, path: str) -> None:
    """Counts stay numbers. path may lie in any file system that Spark knows."""
    told = json.dumps(report, indent=2, ensure_ascii=False, default=str)
    context = SparkSession.active().sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(context._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(told.encode("utf-8"))
    finally:
        out.close()


def coverage_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and, for each column, how many are not blank: one pass."""
    return df.agg(F.count("*").alias("row_count"), *[F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias(f"{c}_filled") for c in columns])


def write_measured(df: DataFrame, path: str, columns: list[str]) -> dict:
    """Writes df as a Parquet table and returns what coverage_metrics() says of it, measured by the writing job itself: no further pass."""
    seen = Observation()
    filled = [F.count_if(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != "").alias(f"{c}_filled") for c in columns]
    df.observe(seen, F.count(F.lit(1)).alias("row_count"), *filled).write.mode("overwrite").parquet(path)
    return seen.get


# tables that are replaced as a whole ------------------------------------------------------------

MANIFEST = "_manifest.json"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the folder at path names as its present version, and what was noted with it."""
    hadoop, fs = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(hadoop):
        return None
    stream = fs.open(hadoop)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def new_version(path: str) -> str:
    """The name of a folder beside the present version, for tables that commit() will name."""
    return f"v-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, version: str, **noted) -> None:
    """Makes version the present one, by one rename: a reader finds the old version or the new one, each whole."""
    jvm = spark.sparkContext._jvm
    told = f"{path}/_manifest-{version}.json"
    write_json_report({"version": version, **noted}, told)
    source, target = (_fs(spark, p)[0] for p in (told, f"{path}/{MANIFEST}"))
    source, target = (_fs(spark, p)[1].makeQualified(x) for p, x in ((told, source), (path, target)))
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, options)


def replace(df: DataFrame, path: str, **noted) -> DataFrame:
    """df in place of the table at path, which it may be made from. A failure leaves the old table as it was."""
    spark, version = df.sparkSession, new_version(path)
    df.write.parquet(f"{path}/{version}")
    commit(spark, path, version, **noted)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The present version of a table that replace() wrote. A DataFrame keeps to the version that it began with."""
    told = manifest(spark, path)
    if told is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{told['version']}")


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes all versions but the present one, and returns their names. For times without readers of older ones and without writers."""
    told = manifest(spark, path)
    hadoop, fs = _fs(spark, path)
    old = [s.getPath() for s in fs.listStatus(hadoop) if s.getPath().getName().startswith(("v-", "_manifest-")) and told and s.getPath().getName() != told["version"]]
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old if p.getName().startswith("v-"))


# scratch ----------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a local master may do with a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its rows are fixed from here on, and outlive executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
