"""Exact deduplication by two-pass Bloom filtering; native expressions only.

Pass one notes which filter bits two or more texts set. Pass two lets every row pass straight through that
has a bit nobody else set: it cannot have an equal. Only the others meet in a shuffle, as 32-byte digests.

Defined cases: a null text counts as empty; a null doc_id is smaller than any other; of rows that share the
largest doc_id too, exactly one stays; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from ._common import ascii_lower, boxed, materialize, text_or_empty, unboxed


def _flagged(docs: DataFrame, text_col: str, expected_rows: int | None, max_bits: int) -> DataFrame:
    """docs with _sha (binary) and _maybe (a repeat is possible)."""
    bits = bloom.bits_for(docs.count() if expected_rows is None else expected_rows, max_bits)
    norm = ascii_lower(text_or_empty(docs, text_col))
    h = F.xxhash64(norm)
    bitmaps = bloom.repeated_filter(docs.select(h.alias("_h")), F.col("_h"), bits)
    hashed = docs.withColumns({"_h": h, "_sha": F.unhex(F.sha2(norm, 256))})
    return bloom.probe(hashed, F.col("_h"), bitmaps, bits, "_maybe").drop("_h")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", expected_rows: int | None = None, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = ascii_lower(text_or_empty(docs, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows, "digests")  # texts are read once; fixes _row, which breaks ties between repeated rows
    h = F.xxhash64("_sha")
    bits = bloom.bits_for(rows.count() if expected_rows is None else expected_rows, max_bits)
    rows = bloom.probe(rows, h, bloom.repeated_filter(rows.select(h.alias("_h")), F.col("_h"), bits), bits, "_maybe")
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    alone = rows.filter("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    some = rows.filter("_maybe")
    groups = some.groupBy("_sha").agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count("*").alias("group_size"))
    groups = materialize(groups.filter("group_size > 1"), "groups")  # a table of its own, so that a hot group's rows can be split in the join
    met = some.join(groups, "_sha", "left").withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    several = F.col("_keep").isNotNull()
    keep_id = F.when(several, F.col("_keep.doc_id")).otherwise(F.col("doc_id"))
    met = met.select("doc_id", keep_id.alias("keep_id"), "group_size", (~several | (F.col("_row") == F.col("_keep._row"))).alias("kept"), sha)
    return alone.unionByName(met)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", expected_rows: int | None = None, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Texts that cannot have an equal never shuffle."""
    own = docs.select(boxed(docs), docs[id_col].alias("_id"), docs[text_col].alias("text"))
    rows = _flagged(own, "text", expected_rows, max_bits).select("_box", "_id", "_sha", "_maybe")
    some = rows.filter("_maybe")
    keepers = some.groupBy("_sha").agg(F.max("_id").alias("_keep")).withColumnRenamed("_sha", "_k")
    stay = some.join(keepers, (F.col("_sha") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_keep")), "left_semi")
    stay = stay.dropDuplicates(["_sha"])  # repeated rows that share the largest doc_id
    return unboxed(rows.filter("not _maybe").unionByName(stay), docs)
