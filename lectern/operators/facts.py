"""The side-effect mart: from raw facts to ranked summaries for each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import exprs as E
from ..sources import sinks
from . import relational as R


def last_wins(names: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value for each key: that of the last row."""
    return names.groupBy(key).agg(F.max_by(value, order).alias(value))


def resolve_names(facts: DataFrame, names: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """facts with column value: the name of `first`, else of `second`; facts without either go. names: one row per key."""
    one = names.select(F.col(key).alias("_k1"), F.col(value).alias("_n1"))
    two = names.select(F.col(key).alias("_k2"), F.col(value).alias("_n2"))
    out = facts.join(one, facts[first] == F.col("_k1"), "left").join(two, facts[second] == F.col("_k2"), "left")
    found = F.coalesce(F.nullif("_n1", F.lit("")), F.nullif("_n2", F.lit("")))
    return out.withColumn(value, found).drop("_k1", "_n1", "_k2", "_n2").filter(F.col(value).isNotNull())


def side_effect_facts(all_effects: DataFrame, label_effects: DataFrame, core_names: DataFrame) -> DataFrame:
    """generic_name_clean, side_effect, term_type, source, distinct, for names of the core table only."""
    columns = ["generic_name_clean", "side_effect", "term_type"]
    core = R.unique_set(core_names, E.clean_generic("generic_name_clean"), "generic_name_clean")
    both = {"all": all_effects.select(*columns), "label_confirmed": label_effects.select(*columns)}
    return R.tagged_distinct({source: R.semi_join(df, core, "generic_name_clean") for source, df in both.items()}, "source")


def mart(all_effects: DataFrame, label_effects: DataFrame, names: DataFrame, core_names: DataFrame) -> DataFrame:
    """The facts of the core table from raw ones: all_effects and label_effects have flat, stereo (ids), side_effect, term_type; names has
    id, name and place, of which the last counts.

    The names are a table before they are joined, a row for each id: a few ids carry most facts, and adaptive execution splits
    theirs, which it cannot do where the other side is an aggregate of the same stage.
    """
    one = sinks.materialize(last_wins(names, "id", "name", "place"), "fact-names")

    def named(df: DataFrame) -> DataFrame:
        out = resolve_names(df, one, "flat", "stereo", "id", "name").withColumn("generic_name_clean", E.clean_generic("name"))
        return out.filter("generic_name_clean <> ''").select("generic_name_clean", "side_effect", "term_type")

    return side_effect_facts(named(all_effects), named(label_effects), core_names)


def label_terms(facts: DataFrame, strict: bool = True) -> DataFrame:
    """Preferred terms confirmed by a label. strict: codes are trimmed and blank terms go; else they are taken as they are."""
    if not strict:
        return facts.filter((F.col("term_type") == "PT") & (F.col("source") == "label_confirmed"))
    return facts.filter((F.upper(F.trim("term_type")) == "PT") & (F.trim("source") == "label_confirmed") & ~E.is_blank("side_effect") & ~E.is_blank("generic_name_clean"))


def best_frequency(records: DataFrame, term: str, freq: str, rank: Column) -> DataFrame:
    """The frequency of lowest rank for each term; the alphabetically first of equals."""
    return records.groupBy(term).agg(F.min(F.struct(rank.alias("rank"), F.col(freq).alias("freq"))).alias("_b")).select(term, F.col("_b.freq").alias(freq), F.col("_b.rank").alias("rank"))


def ordered_concat(facts: DataFrame, key: str, rank: str, term: str) -> DataFrame:
    """All terms of a key, by rank and name, in one string, and their number."""
    listed = F.sort_array(F.collect_list(F.struct(rank, term)))
    return facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x[term]), ", ").alias("terms"), F.count(term).alias("n_terms"))


def bucket_top_k(facts: DataFrame, key: str, bucket: str, term: str, sizes: dict[str, int] = C.BUCKET_SIZES) -> DataFrame:
    """For each key a column per bucket: the first k of its distinct terms, alphabetically. Keys without a term in any bucket stay. No
    set is gathered whole, and there is no pivot."""
    known = F.col(bucket).isin(*sizes)
    told = facts.select(F.col(key).alias("_key"), F.when(known, F.col(bucket)).alias("_bucket"), F.when(known, F.col(term)).alias("_term"))
    some = R.first_k(told, ["_key", "_bucket"], "_term", max(sizes.values()))
    pick = lambda b: F.array_sort(F.collect_list(F.when(F.col("_bucket") == b, F.col("_term"))))
    out = some.groupBy("_key").agg(*[F.array_join(F.slice(pick(b), 1, k), ", ").alias(f"{b}_terms") for b, k in sizes.items()])  # at most max(sizes) each
    return out.withColumnRenamed("_key", key)


def left_join_filled(core: DataFrame, side: DataFrame, key: str, texts: list[str], counts: list[str] = ()) -> DataFrame:
    """core with columns of side (one row per key); blank or 0 where there is none. A NULL key is the empty string. Keeps every core row."""
    core = core.withColumn(key, E.strip(E.text(key)))
    side = side.withColumn(key, E.strip(E.text(key)))
    out = core.join(side, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {c: E.lenient_int(c) for c in counts})


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
