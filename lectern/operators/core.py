"""The core table: filtered, cleaned entities with surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import exprs as E
from ..sources import sinks
from ..sources.readers import add_missing

CORE_COLUMNS = ["drug_id", "generic_name", "generic_name_clean", "brand_names", "drug_class", "route", "indications", "dosage_and_administration", "warnings", "contraindications", "side_effects_all", "side_effects_label_confirmed", "sources", "last_updated"]


def surrogate_keys(df: DataFrame, order: list[str], column: str = "drug_id", pattern: str = "DRUG_%06d", ties: list[str] | None = None) -> DataFrame:
    """Keys 1, 2, ... in the given order, without bringing the rows to one task; rows equal in it follow the order of `ties`.

    Rows are range-partitioned, sorted and written once, each with the number of its partition and its place there; counts
    and keys are both read from that table, so they cannot disagree. The rank of a row is its place after the counts of
    the partitions before. Rows equal in `order` are spread by `ties`, so that a common key fills no single partition.
    """
    keys = [*order, *(ties or [])]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.monotonically_increasing_id().alias("_id"))
    ranged = sinks.materialize(ranged.select("_row", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = ranged.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    key = F.format_string(pattern, F.col("_before") + F.col("_at") + 1).alias(column)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c != column], key)


def core_rule(strict: bool = True) -> Column:
    """A class or a label-confirmed side effect is known. Not strict: a NULL class counts as known."""
    known = ~E.is_blank("drug_class") | ~E.is_blank("side_effects_label_confirmed")
    return known if strict else known | F.col("drug_class").isNull()


def core_table(raw: DataFrame, run_date: str, strict: bool = True) -> DataFrame:
    df = add_missing(raw, ["brand_names", "drug_class", "route", "sources", *C.TEXT_LIMITS, *C.LIST_LIMITS])
    listed = lambda c: F.lower(E.text(c))
    df = df.withColumns({"generic_name_clean": E.clean_generic("generic_name"), "generic_name": E.clean_generic("generic_name")} | {c: E.limit_text(E.fix_mojibake(c), n) for c, n in C.TEXT_LIMITS.items()} | {c: E.limit_csv_list(E.fix_mojibake(c), n) for c, n in C.LIST_LIMITS.items()})
    banned = [E.contains_any(listed(c), words) for words in (C.BLACKLIST, C.NICOTINE) for c in ("generic_name", "brand_names", "indications")]
    keep = ~E.looks_bad_generic("generic_name_clean") & F.coalesce(E.route_ok("route"), F.lit(False)) & E.is_single_name("generic_name_clean") & core_rule(strict)
    for b in banned:
        keep = keep & ~b
    order = ["generic_name_clean", "brand_names", "route", "drug_class"]
    ties = [c for c in CORE_COLUMNS if c not in ("drug_id", "last_updated", *order)]  # rows equal in all of them are the same row
    out = surrogate_keys(df.filter(keep), order, ties=ties)
    return out.withColumn("last_updated", F.lit(run_date)).select(*CORE_COLUMNS)
