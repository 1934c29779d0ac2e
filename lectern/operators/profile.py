"""Data-quality profiles. Each is one aggregate pass over the table, whatever the number of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import exprs as E
from ..sources import readers, sinks


def _long(row: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """One aggregated row with a struct per column -> a row per column."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}`.{n}").alias(n) for n in names]) for c in columns])).alias("_x")).select("_x.*")


def missing_profile(df: DataFrame) -> DataFrame:
    stats = df.agg(*[F.struct(F.count_if(F.col(f"`{c}`").isNull()).alias("missing"), F.round(E.percent(F.count_if(F.col(f"`{c}`").isNull()), F.count("*")), 4).alias("missing_pct")).alias(c) for c in df.columns])
    return _long(stats, df.columns, ["missing", "missing_pct"])


def duplicate_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))  # NULLs are equal here
    out = n.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"))
    return out.withColumn("duplicate_pct", F.round(E.percent(F.col("duplicates"), F.col("row_count")), 4))


def type_profile(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def completeness_profile(df: DataFrame, least: float = 80.0) -> DataFrame:
    full = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in df.columns), F.lit(0))
    share = df.select((full / len(df.columns) * 100).alias("share"))
    return share.agg(*[F.round(f("share"), 4).alias(n) for n, f in (("mean_pct", F.avg), ("min_pct", F.min), ("max_pct", F.max))], F.count_if(F.col("share") < least).alias("rows_below"))


def critical_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    filled = lambda c: F.count_if(~E.is_blank(F.col(f"`{c}`").cast("string")))
    stats = df.agg(*[F.struct(filled(c).alias("populated"), (F.count("*") - filled(c)).alias("empty"), F.round(E.percent(filled(c), F.count("*")), 4).alias("populated_pct")).alias(c) for c in columns])
    return _long(stats, columns, ["populated", "empty", "populated_pct"])


def checks(c: str) -> dict:
    return {"bad_encoding": E.bad_encoding(c), "repeated": E.repeated_window(c), "too_long": E.too_long(c), "label_repeats": E.label_repeats(c)}


def quality_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    found = df.select([F.struct((~E.is_blank(c)).alias("non_empty"), *[v.alias(k) for k, v in checks(c).items()]).alias(c) for c in columns])
    names = ["non_empty", *checks(columns[0])]
    stats = found.agg(*[F.struct(F.count("*").alias("total"), *[F.count_if(F.col(f"`{c}`.{n}")).alias(n) for n in names]).alias(c) for c in columns])
    return _long(stats, columns, ["total", *names])


def offenders(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """column_name, check_name, id and text of every cell that fails a check."""
    cells = df.select(F.col(id_col).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("cell"), F.array(*[F.when(v, k) for k, v in checks(c).items()]).alias("failed")) for c in columns])).alias("_x"))
    return cells.select("row_id", "_x.column_name", F.explode(F.array_compact("_x.failed")).alias("check_name"), F.col("_x.cell").alias("cell"))


def report(df: DataFrame, keys: list[str], critical: list[str]) -> dict:
    """The validation report as plain values; every part is an aggregate."""
    rows = lambda d: [r.asDict() for r in d.collect()]  # noqa: E731  a row per column at most
    return {"columns": df.columns, "missing": rows(missing_profile(df)), "duplicates": rows(duplicate_profile(df, keys))[0], "types": type_profile(df), "completeness": rows(completeness_profile(df))[0], "critical_fields": rows(critical_fields(df, critical)), "row_count": df.count(), "column_count": len(df.columns)}


def report_file(spark: SparkSession, path: str, keys: list[str], critical: list[str], out: str | None = None) -> dict:
    """The report of the CSV file at path, where NA values are missing; written to out as JSON if that is given."""
    told = report(readers.read_csv(spark, path, na="null"), keys, critical)
    if out:
        sinks.write_json_report(told, out)
    return told
