"""Name lookup: exact, then alias, then fuzzy, for many queries at a time, against a store of keys.

The store is made once: rows ready for display, keys with their rows, and what the keys are found by. Queries that neither
an exact key nor an alias answers search the keys for the best scores (nearest()), in bands:

1. Scores of 80 or more, by posting lists. Names that reach 80 share rare grams (see grams_of()), which a join finds. Grams that
   very many keys hold take no part in it: names that share nothing rarer meet in blocks, salted by gram. Keys that share a
   word with a query, but are half as long again or more, tie: of those, each word's list gives only the first in order.
2. A query that has as many matches by then as are asked for leaves. The others, if a lower score is asked for, meet the keys in blocks.

In a block, what each key can reach at most comes from common subsequences with all keys at once, and only keys that may be among the
best are scored. No key travels in a closure and nothing is collected but counts.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import exprs as E
from ..functions import similarity
from ..sources import readers, sinks
from . import relational as R

#: Keys and queries that meet in one task of a scan.
BLOCK_KEYS, BLOCK_QUERIES = 20_000, 1_000
#: Of the pairs of characters that a match must share, so many are asked for.
SHARED = 3
#: The least score from which posting lists lose no match.
JOINED_FROM = 80.0
#: Up to so many keys are one block from the start, for which posting lists are not made.
SMALL_POOL = 2_000
#: Keys that hold a gram, beyond which names that share nothing rarer meet in blocks.
HEAVY = 500
MATCHES = "array<struct<match: string, score: double, row_no: bigint>>"
SHOWN = ["drug_id", "generic_name", "generic_name_clean", "brand_names", "drug_class", "route", *C.TEXT_LIMITS, "sources", "last_updated"]


# store ------------------------------------------------------------------------------------------


class Store(NamedTuple):
    """rows: row_no and the columns of an answer. keys: key, row_no, is_primary, name. pool: what suggestions are made of, match, rank
    and name. lists: tables of the posting lists of keys and pool, see postings(); a small store that goes with the application has
    none, and makes them if they are asked for. large: whether posting lists are used."""

    rows: DataFrame
    keys: DataFrame
    pool: DataFrame
    lists: tuple[DataFrame, DataFrame] | None
    large: bool

    @property
    def grams(self) -> DataFrame:
        return self.lists[0] if self.lists else postings(_by_key(self.keys))

    @property
    def pool_grams(self) -> DataFrame:
        return self.lists[1] if self.lists else postings(_by_rank(self.pool))


def _by_key(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.col("key").alias("rank"))


def _by_rank(pool: DataFrame) -> DataFrame:
    return pool.select(F.col("match").alias("key"), "rank")


def row_names() -> Column:
    """What a row is found by, in order: clean name, generic name, short brand; none of them if it has neither name."""
    names = F.array(E.normalize_text("generic_name_clean"), E.normalize_text("generic_name"), E.short_brand_key("brand_names"))
    return E._let(names, lambda a: F.when((a[0] != "") | (a[1] != ""), a).otherwise(F.array().cast("array<string>")))


def _first_rows(named: DataFrame) -> DataFrame:
    """key, row_no, is_primary of row_no and row_names()."""
    out = named.select("row_no", F.posexplode("_names").alias("pos", "key")).filter("key <> ''")
    return out.groupBy("key").agg(F.min("row_no").alias("row_no"), F.max(F.col("pos") < 2).alias("is_primary"))


def build_keys(drugs: DataFrame) -> DataFrame:
    """key, row_no, is_primary: first row wins; within a row clean name, generic name, short brand. drugs: row_no, generic_name_clean, generic_name, brand_names."""
    return _first_rows(drugs.select("row_no", row_names().alias("_names")))


#: Of a store's tables; to be raised with every change of what they hold, so that no older ones are carried over.
FORMAT = 2


def _digested(drugs: DataFrame) -> DataFrame:
    """row_no and _digest, of all other cells."""
    cells = F.struct(*[F.col(f"`{c}`") for c in sorted(drugs.columns) if c != "row_no"])
    return drugs.withColumn("_digest", F.sha2(F.to_json(cells, {"ignoreNullFields": "false"}), 256))


def _shown_rows(drugs: DataFrame, since: str, old: Store | None) -> DataFrame:
    """drugs with what answers show of them, _names, by which they are found, and _since: for which version of the store that was made.
    Of rows with the same cells as one of old's, wherever they stand, it is taken from there."""

    def made(some: DataFrame) -> DataFrame:
        return match_rows(some.withColumn("_raw", E.text("generic_name")).withColumn("_names", row_names())).withColumnRenamed("_raw", "generic_name_raw").withColumn("_since", F.lit(since))

    drugs = _digested(drugs)
    if old is None:
        return made(drugs)
    known = sinks.materialize(old.rows.groupBy("_digest").agg(F.min("row_no").alias("_old")), "lookup-known")  # one row for each: narrow
    same = drugs.select("row_no", "_digest").join(known, "_digest").select(F.col("row_no").alias("_new"), "_old")
    taken = old.rows.join(same, F.col("row_no") == F.col("_old")).drop("row_no", "_old").withColumnRenamed("_new", "row_no")
    return made(drugs.join(known.select("_digest"), "_digest", "left_anti")).unionByName(taken)


def build_store(drugs: DataFrame, folder: str | None = None, old: Store | None = None) -> Store:
    """The store of a table of drugs (row_no, generic_name_clean, generic_name, brand_names, and what else an answer shows). folder: where
    its tables go, to stay; otherwise they go with the application, and small ones have no posting lists. old: a store of a table with
    the same columns, from which the work on equal rows, and on keys that are still there, is taken over."""
    spark = drugs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return sinks.materialize(df, f"lookup-{name}")
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    drugs = readers.add_missing(drugs, [c for c in SHOWN if c != "route"] + ["route"])
    rows = kept(_shown_rows(drugs, (folder or "").rpartition("/")[2], old), "rows")
    named = rows.select(F.col("row_no").alias("_r"), F.coalesce(F.nullif("generic_name_clean", F.lit("")), F.nullif("generic_name_raw", F.lit(""))).alias("name"))
    keys = _first_rows(rows.select("row_no", "_names"))
    keys = kept(keys.join(named, F.col("row_no") == F.col("_r")).select("key", "row_no", "is_primary", F.coalesce("name", "key").alias("name")), "keys")
    pool = kept(suggestion_pool(keys), "pool")
    large, lists = keys.count() > SMALL_POOL, None
    if large or folder:
        before = old.lists if old and old.lists else (None, None)
        lists = tuple(kept(_renewed(names, b), name) for names, b, name in ((_by_key(keys), before[0], "grams"), (_by_rank(pool), before[1], "pool_grams")))
    return Store(rows, keys, pool, lists, large)


def open_store(spark: SparkSession, path: str, folder: str) -> Store:
    """The store of the catalogue at path, kept in folder for all applications. It is made if there is none, or if the files at path are
    others than those it was made from, by their names, lengths and times; then only rows that no file held before are cleaned, and only
    keys that are new get posting lists. A new version is written beside the old one and takes its place by one rename, so whoever has
    the old one open keeps it, and a failure leaves it in place."""
    files = readers.fingerprint(spark, path)
    told = sinks.manifest(spark, folder)
    told = told if told and told.get("format") == FORMAT else None
    present = _opened(spark, folder, told) if told else None
    if told and told["files"] == files:
        return present
    drugs = readers.read_csv(spark, path, row_no="row_no")
    readers.require_columns(drugs, ["drug_id", "generic_name", "generic_name_clean"])
    drugs = sinks.materialize(readers.add_missing(drugs, ["brand_names"]), "catalogue")
    version, columns = sinks.new_version(folder), sorted(drugs.columns)
    store = build_store(drugs, f"{folder}/{version}", present if told and told["columns"] == columns else None)
    sinks.commit(spark, folder, version, files=files, large=store.large, columns=columns, format=FORMAT)
    return store


def _opened(spark: SparkSession, folder: str, told: dict) -> Store:
    rows, keys, pool, *lists = [spark.read.parquet(f"{folder}/{told['version']}/{name}") for name in ("rows", "keys", "pool", "grams", "pool_grams")]
    return Store(rows, keys, pool, tuple(lists), told["large"])


_STORES: dict[str, Store] = {}


def init_store(spark: SparkSession, path: str | None = None) -> Store:
    """The store of the catalogue at path (DRUG_DATASET_PATH if none is given), made at the first call; later calls return
    it, whatever path they name. Raises FileNotFoundError, or ValueError where a required column is missing."""
    known = _STORES.get(spark.sparkContext.applicationId)
    if known is None:
        drugs = readers.read_csv(spark, path or readers.resolve_path("DRUG_DATASET_PATH", "data/processed/drug_knowledge_bot_ready_clean.csv"), row_no="row_no")
        readers.require_columns(drugs, ["drug_id", "generic_name", "generic_name_clean"])
        drugs = sinks.materialize(readers.add_missing(drugs, ["brand_names"]), "catalogue")
        known = _STORES[spark.sparkContext.applicationId] = build_store(drugs)
    return known


def match_rows(drugs: DataFrame) -> DataFrame:
    """drugs with the columns of an answer, cleaned for display. Built-in expressions only."""
    texts = {c: E.display_text(c) for c in C.TEXT_LIMITS if c in drugs.columns}
    buckets = {b.replace("_frequency", ""): F.col(f"{b}_side_effects") for b in C.SIDE_EFFECT_BUCKETS if f"{b}_side_effects" in drugs.columns}
    more = {"side_effects_buckets": E.side_effect_map(buckets) if buckets else F.lit(None).cast("map<string,string>")}
    plain = {c: E.text(c) for c in ("drug_id", "generic_name", "generic_name_clean", "drug_class", "sources", "last_updated") if c in drugs.columns}
    return drugs.withColumns(plain | {"brand_names": E.trim_brand_names("brand_names"), "route": E.normalize_route_service("route")} | texts | more)


# candidates -------------------------------------------------------------------------------------


def grams_of(c: Column) -> Column:
    """What two names of a weighted ratio of 80 or more share, as strings: numbered pairs of neighbouring characters of
    the name between blanks, its characters, its words.

    Names with a word in common share that word. Of others, let the shorter one have n characters, its words counted
    once. By the plain ratio, or that of sorted words, which have the same pairs (the blanks are part of them), at most
    0.2 of all characters are inserted or deleted; a deletion breaks two of the n + 1 pairs of the shorter name and an
    insertion one, so 0.4 n + 1 of them are left in the other name. By a stretch of the longer name, of which 80 needs a
    ratio of 80 / 0.9, 0.6 n - 1 of the n - 1 pairs inside are left. So at least t, the lesser of these, are left, and of
    the n + 1 - t + m rarest pairs of the shorter name its match holds m or more (_prefix; m is SHARED, or t if that is
    less). One character alone has no pair inside, and is found by itself. A name that says a word twice is compared without the second, of which
    all this need not hold: it is looked for, and found, by every gram.
    """
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))
    numbered = E._let(pairs, lambda a: F.transform(a, lambda x, i: F.concat(x, (i - F.array_position(a, x) + 1).cast("string"))))
    chars = F.transform(F.array_distinct(F.split(c, "")), lambda x: F.concat(F.lit("c:"), x))
    words = F.transform(F.array_distinct(F.split(c, " ")), lambda x: F.concat(F.lit("w:"), x))
    return F.concat(numbered, chars, words)


def _left(name: str) -> Column:
    """How many pairs of a name a longer match holds at least."""
    n = F.length(F.array_join(F.array_distinct(F.split(F.col(name), " ")), " "))
    return F.greatest(F.lit(1), F.ceil(F.least(0.4 * n + 1, 0.6 * n - 1))).cast("int")


def _need(name: str) -> Column:
    return F.least(_left(name), F.lit(SHARED))


def _told_twice(name: str) -> Column:
    words = F.split(F.col(name), " ")
    return F.size(F.array_distinct(words)) < F.size(words)


def _ranked(names: DataFrame, common: DataFrame) -> DataFrame:
    """names: key and other columns; common: gram, n, how many keys hold it. A row for each gram of each name, with n and
    length; rare: the name looks for longer ones by it; need: how many of those it must share; word; twice: it says a word twice."""
    own = [c for c in names.columns if c != "key"]
    each = names.select("key", *own, F.explode(grams_of(F.col("key"))).alias("gram")).join(common, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    each = each.groupBy("key", *own).agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("_g"))  # a name's own grams
    length = F.length("key")
    by = lambda x: F.when(length == 1, x["gram"].startswith("c:")).otherwise(~x["gram"].startswith("c:") & ~x["gram"].startswith("w:"))
    each = each.withColumns({"length": length, "need": _need("key"), "twice": _told_twice("key"), "_by": F.filter("_g", by), "_others": F.filter("_g", lambda x: ~by(x))})
    looks = F.when(length == 1, 1).otherwise(length + 1 - _left("key") + F.col("need"))
    placed = F.concat(F.transform("_by", lambda x, i: F.struct(x["gram"].alias("gram"), x["n"].alias("n"), (i < looks).alias("rare"))), F.transform("_others", lambda x: F.struct(x["gram"].alias("gram"), x["n"].alias("n"), F.lit(False).alias("rare"))))
    return each.select("key", *own, "length", "need", "twice", F.explode(placed).alias("_x")).select("key", *own, "length", "need", "twice", "_x.*", F.col("_x.gram").startswith("w:").alias("word"))


def postings(names: DataFrame) -> DataFrame:
    """The posting lists of names: key and rank, by which equal scores are ordered."""
    common = names.select(F.explode(grams_of(F.col("key"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return _ranked(names, common)


def _renewed(names: DataFrame, old: DataFrame | None) -> DataFrame:
    """The posting lists of names (a table), those of old taken over for names that are there.

    n, by which a name's grams are in order of rarity, need only be the same for all holders of a gram, not exact: so a gram
    that old knows keeps its n. Once a gram that counts as light is held by over twice HEAVY names, all lists are made anew.
    """
    if old is None:
        return postings(names)
    there = sinks.materialize(old.join(names, ["key", "rank"], "left_semi"), "lookup-there")
    new = sinks.materialize(names.join(there.select("key", "rank").distinct(), ["key", "rank"], "left_anti"), "lookup-new")
    known = there.groupBy("gram").agg(F.min("n").alias("_n"), F.count("*").alias("_there"))
    added = new.select(F.explode(grams_of(F.col("key"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("_new"))
    common = added.join(known, "gram", "left").select("gram", F.coalesce("_n", "_new").alias("n"), (F.coalesce("_there", F.lit(0)) + F.col("_new")).alias("_held"))
    common = sinks.materialize(common, "lookup-common")
    if not common.filter((F.col("n") <= HEAVY) & (F.col("_held") > 2 * HEAVY)).isEmpty():
        return postings(names)
    return there.unionByName(_ranked(new, common.select("gram", "n")))


def _asked(queries: DataFrame, grams: DataFrame) -> DataFrame:
    common = grams.select("gram", "n").distinct()
    asked = _ranked(queries.select(F.col("q").alias("key")), common).withColumnRenamed("key", "q")
    return sinks.materialize(asked.select([F.col(c).alias(c if c == "q" else f"_{c}") for c in asked.columns]), "lookup-asked")


def _score(cutoff: float):
    @F.pandas_udf("double")
    def run(queries: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([similarity.weighted_ratio(q, k, cutoff) for q, k in zip(queries, keys)], dtype=float)

    return run


def _best(pairs: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """q, _top: the best of (q, match, score, ...) for each q, in order."""
    fields = [c for c in pairs.columns if c != "q"]
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), *order))).filter(F.col("place") <= limit)
    top = F.transform(F.array_sort(F.collect_list(F.struct("place", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return ranked.groupBy("q").agg(top.alias("_top"))  # at most `limit` rows each


def _same() -> Column:
    return F.col("_gram") == F.col("gram")


def _shared(asked: DataFrame, grams: DataFrame, bounded: bool) -> DataFrame:
    """q, match: pairs of names, neither of which says a word twice, with as many rare grams of the shorter one in common as a
    score of JOINED_FROM needs. bounded: without heavy grams, so that only pairs that share no heavy one are sure to be found."""
    plain, known = asked.filter("not _twice"), grams.filter("not twice")
    shorter = F.col("_length") <= F.col("length")
    light = lambda df, n: df.filter(F.col(n) <= HEAVY) if bounded else df
    # each case is a join of its own, so that grams nobody is looked for by, such as common letters, meet nothing
    ahead = light(plain.filter("_rare"), "_n").join(known, _same() & shorter).select("q", "key", F.col("_need").alias("least"))
    back = light(plain, "_n").join(light(known.filter("rare"), "n"), _same() & ~shorter).select("q", "key", F.col("need").alias("least"))
    met = ahead.unionByName(back).groupBy("q", F.col("key").alias("match")).agg(F.count("*").alias("_k"), F.max("least").alias("_least"))
    return met.filter("_k >= _least").select("q", "match")


def candidates(queries: DataFrame, grams: DataFrame) -> DataFrame:
    """queries: q, once each. q, match: pairs among which are all with a score of JOINED_FROM or more; so many that share a
    common word. For the best few of each query, see nearest()."""
    asked = _asked(queries, grams)
    words = asked.filter("_word and not _twice").join(grams.filter("word and not twice"), _same()).select("q", F.col("key").alias("match"))
    twice = asked.filter("_twice").join(grams, _same()).unionByName(asked.filter("not _twice").join(grams.filter("twice"), _same())).select("q", F.col("key").alias("match"))
    return _shared(asked, grams, False).unionByName(words).unionByName(twice).distinct()


def _tied(asked: DataFrame, grams: DataFrame, limit: int) -> DataFrame:
    """q, match: of the keys that share a word with q and are 1.5 to 8 times as long, or short, the first `limit` by rank of each word. By
    the word alone they all have the same score; one that has a higher one shares rare grams too. Lists of a word are cut to `limit`
    keys of each length before they meet a length of queries, and to `limit` before they meet queries."""
    first = lambda df, *by: df.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).filter(F.col("_p") <= limit).drop("_p")
    lists = first(grams.filter("word").select("gram", "length", "key", "rank"), "gram", "length")
    words = asked.filter("_word").select("_gram", "_length").distinct()
    long, short = F.greatest("length", "_length"), F.least("length", "_length")
    met = first(words.join(lists, _same() & (long >= 1.5 * short) & (long <= 8 * short)), "_gram", "_length")
    met = met.select(F.col("_gram").alias("_g"), F.col("_length").alias("_l"), F.col("key").alias("match"))
    return asked.filter("_word").join(met, (F.col("_gram") == F.col("_g")) & (F.col("_length") == F.col("_l"))).select("q", "match")


def _meet(asked: DataFrame, known: DataFrame, cutoff: float, limit: int) -> DataFrame:
    """asked: part, q; known: part, match, rank. The best keys of each part for each of its queries, ties by rank. A part is dealt
    over blocks of keys and chunks of queries; a task has one of each, a bounded number, and hands on its best of the block."""
    sizes = asked.groupBy("part").agg(F.count("*").alias("_q")).join(known.groupBy("part").agg(F.count("*").alias("_k")), "part")
    sizes = sizes.select("part", F.ceil(F.col("_q") / BLOCK_QUERIES).cast("int").alias("chunks"), F.ceil(F.col("_k") / BLOCK_KEYS).cast("int").alias("blocks"))
    sizes = sinks.materialize(sizes, "lookup-blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(sizes, "part").select("part", "q", F.pmod(F.xxhash64("q"), "chunks").cast("int").alias("chunk"), every("blocks").alias("block"))
    known = known.join(sizes, "part").select("part", "match", "rank", F.pmod(F.xxhash64("match"), "blocks").cast("int").alias("block"), every("chunks").alias("chunk"))

    def meet(some: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        keys = keys.sort_values("rank", kind="stable")
        names, ranks = keys["match"].tolist(), keys["rank"].tolist()
        found = [(q, names[i], ranks[i], s) for q, best in similarity.best_of_all(some["q"].tolist(), names, cutoff, limit) for i, s in best]
        return pd.DataFrame(found, columns=["q", "match", "rank", "score"])

    at = ["part", "block", "chunk"]
    return asked.groupBy(*at).cogroup(known.groupBy(*at)).applyInPandas(meet, "q string, match string, rank string, score double")


def scan(queries: DataFrame, pool: DataFrame, cutoff: float, limit: int) -> DataFrame:
    """queries: q, once each; pool: match, rank. q, match, rank, score: the best of the pool for each query, ties by rank; every query meets every block of keys."""
    return _meet(queries.select(F.lit("").alias("part"), "q"), pool.select(F.lit("").alias("part"), "match", "rank"), cutoff, limit)


def _by_postings(queries: DataFrame, pool: DataFrame, grams: DataFrame, cutoff: float, limit: int) -> DataFrame:
    """As scan(), for a cutoff of JOINED_FROM or more. Names that say a word twice, in which grams tell nothing, meet all others in blocks."""
    asked = _asked(queries, grams)
    pairs = _shared(asked, grams, True).unionByName(_tied(asked, grams, limit)).distinct()
    scored = pairs.withColumn("score", _score(cutoff)("q", "match")).filter(F.col("score") >= cutoff)
    part = lambda name: F.concat(F.lit(name), F.col("gram")).alias("part")
    told = asked.select([F.col(c).alias(c.removeprefix("_")) for c in asked.columns])
    heavy, known = told.filter((F.col("n") > HEAVY) & ~F.col("twice")), grams.filter((F.col("n") > HEAVY) & ~F.col("twice"))
    all_q, all_k = F.lit("every query").alias("part"), F.lit("every key").alias("part")
    ask = [heavy.filter("rare").select(part("ahead "), "q"), heavy.select(part("back "), "q"), told.filter("twice").select(all_k, "q").distinct(), queries.select(all_q, "q")]
    have = [known.select(part("ahead "), F.col("key").alias("match"), "rank"), known.filter("rare").select(part("back "), F.col("key").alias("match"), "rank"), pool.select(all_k, "match", "rank"), grams.filter("twice").select(all_q, F.col("key").alias("match"), "rank").distinct()]
    met = _meet(reduce(DataFrame.unionByName, ask), reduce(DataFrame.unionByName, have), cutoff, limit)
    ranks = pool.select(F.col("match").alias("_m"), "rank")
    return scored.join(ranks, F.col("match") == F.col("_m")).select("q", "match", "rank", "score").unionByName(met).dropDuplicates(["q", "match"])


def nearest(queries: DataFrame, pool: DataFrame, grams: DataFrame | None, cutoff: float, limit: int, large: bool = True) -> DataFrame:
    """queries: q, once each; pool: match, rank; grams: its posting lists, if large. q, match, rank, score: among which are the best `limit` of each query, ties by rank."""
    if not large:
        return scan(queries, pool, cutoff, limit)
    if cutoff >= JOINED_FROM:
        return _by_postings(queries, pool, grams, cutoff, limit)
    found = sinks.materialize(_by_postings(queries, pool, grams, JOINED_FROM, limit), "lookup-near")
    enough = sinks.materialize(found.groupBy("q").agg(F.count("*").alias("_k")).filter(F.col("_k") >= limit).select("q"), "lookup-enough")
    rest = sinks.materialize(queries.join(enough, "q", "left_anti"), "lookup-far")
    return found.join(enough, "q", "left_semi").unionByName(scan(rest, pool, cutoff, limit))


def fuzzy_top(queries: DataFrame, column: str, store: Store, cutoff: float = C.MIN_SCORE, limit: int = 10) -> DataFrame:
    """column, _top: for each of queries the best keys (match, score), best first, ties by key."""
    asked = queries.select(F.col(column).alias("q")).distinct()
    found = nearest(asked, store.keys.select(F.col("key").alias("match"), F.col("key").alias("rank")), store.grams if store.large else None, cutoff, limit, store.large)
    return _best(found.drop("rank"), limit, [F.col("match")]).withColumnRenamed("q", column)


def suggestion_pool(keys: DataFrame) -> DataFrame:
    """match, rank, name: names of rows in order, then the aliases that are none. An alias is its own name."""
    aliases = keys.sparkSession.createDataFrame([(a, f"{i:03d}") for i, a in enumerate(C.ALIASES)], "match string, place string")
    primary = keys.filter("is_primary").select(F.col("key").alias("match"), F.col("key").alias("place"))
    pool = R.ordered_union([primary, aliases], "match", "place").select("match", F.concat(F.col("part").cast("string"), "place").alias("rank"))
    named = keys.select(F.col("key").alias("_k"), F.col("name").alias("_name"))
    own = F.broadcast(aliases.select(F.col("match").alias("_a")))  # fixed, a few
    pool = pool.join(named, F.col("match") == F.col("_k"), "left").join(own, F.col("match") == F.col("_a"), "left")
    return pool.select("match", "rank", F.when(F.col("_a").isNull(), F.col("_name")).otherwise(F.col("match")).alias("name"))


def suggest(queries: DataFrame, column: str, store: Store, cutoff: float, top_k: int = C.TOP_K) -> DataFrame:
    """column, suggestions: names of the rows whose keys come nearest, normalised, each once, at most top_k."""
    asked = queries.select(F.col(column).alias("q")).distinct()
    found = nearest(asked, store.pool.select("match", "rank"), store.pool_grams if store.large else None, cutoff, max(top_k, 15), store.large)
    named = found.join(store.pool.select(F.col("match").alias("_m"), "name"), F.col("match") == F.col("_m")).select("q", "match", "score", "rank", "name")
    best = _best(named, max(top_k, 15), [F.col("rank")])
    names = E.distinct_keep_first(F.transform("_top", lambda x: E.normalize_text(x["name"])), lambda k: k)
    return best.select(F.col("q").alias(column), F.slice(names, 1, top_k).alias("suggestions"))


# cascade ----------------------------------------------------------------------------------------


def _typo() -> Column:
    @F.pandas_udf("double")
    def near(queries: pd.Series) -> pd.Series:
        return queries.map(lambda q: similarity.weighted_ratio(q, "paracetamol"))

    q = F.col("normalized_query")
    return (q.contains("para") | q.startswith("par")) & (F.when(q.contains("para") | q.startswith("par"), near(q)).otherwise(0.0) >= C.TYPO_THRESHOLD)


def alias_target(c: Column) -> Column:
    """What an alias stands for, else NULL."""
    return F.create_map(*[F.lit(x) for kv in C.ALIASES.items() for x in kv])[c]


def exact_hits(queries: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of queries whose column is a key, with key and row_no."""
    hit = keys.select("key", "row_no")
    return queries.join(hit, F.col(column) == F.col("key"))


def resolve(queries: DataFrame, store: Store, top_k: int = C.TOP_K, min_score: float = C.MIN_SCORE) -> DataFrame:
    """query, normalized_query, match_type (exact, alias, fuzzy, none), target, matches (match, score, row_no), suggestions; once for each different query."""
    keys = store.keys
    q = queries.select("query", E.normalize_text("query").alias("normalized_query")).distinct()
    columns = ["query", "normalized_query", "match_type", "target", "matches", "suggestions"]
    nothing = F.array().cast("array<string>")
    one = lambda score: F.array(F.struct(F.col("key").alias("match"), F.lit(score).alias("score"), "row_no"))
    exact = exact_hits(q, keys, "normalized_query").withColumns({"match_type": F.lit("exact"), "target": F.col("normalized_query"), "matches": one(100.0), "suggestions": nothing})
    rest = q.join(keys.select("key"), F.col("normalized_query") == F.col("key"), "left_anti")
    blank = rest.filter("normalized_query = ''").withColumns({"match_type": F.lit("none"), "target": F.lit(""), "matches": F.array().cast(MATCHES), "suggestions": nothing})
    rest = rest.filter("normalized_query <> ''").withColumn("_target", F.coalesce(alias_target(F.col("normalized_query")), F.when(_typo(), "acetaminophen")))
    family = F.array(F.col("_target"), *[F.when(F.col("_target") == t, F.lit(a)) for a, t in C.ALIASES.items()])
    aliased = exact_hits(rest, keys, "_target").withColumns({"match_type": F.lit("alias"), "target": F.col("_target"), "matches": one(C.ALIAS_SCORE), "suggestions": F.slice(F.array_compact(family), 1, top_k)})
    rest = sinks.materialize(rest.join(keys.select("key"), F.col("_target") == F.col("key"), "left_anti").select("query", "normalized_query"), "lookup-rest")
    parts = [p.select(*columns[:4], F.col("matches").cast(MATCHES).alias("matches"), "suggestions") for p in (exact, blank, aliased, _fuzzy(rest, store, top_k, min_score))]
    return reduce(DataFrame.unionByName, parts)


def _fuzzy(rest: DataFrame, store: Store, top_k: int, min_score: float) -> DataFrame:
    """The best keys, a drug once: of equal, not blank drug_ids the first counts. Without a match only suggestions are left."""
    top = fuzzy_top(rest, "normalized_query", store, min_score, max(top_k, 10)).select(F.col("normalized_query").alias("_q"), F.posexplode("_top").alias("_place", "_m"))
    top = top.join(store.keys.select("key", "row_no"), F.col("_m.match") == F.col("key")).join(store.rows.select(F.col("row_no").alias("_r"), "drug_id", "generic_name_clean"), F.col("row_no") == F.col("_r"))
    top = R.ranked_dedupe(top, "_q", "drug_id", [F.col("_place")], max(top_k, 10), top_k)
    listed = F.array_sort(F.collect_list(F.struct("place", F.col("_m.match").alias("match"), F.col("_m.score").alias("score"), "row_no", "drug_id", "generic_name_clean")))  # at most top_k
    top = top.groupBy("_q").agg(listed.alias("_l"))
    near = suggest(rest, "normalized_query", store, max(0.0, min_score - 35), top_k).withColumnRenamed("normalized_query", "_s")
    out = rest.join(top, F.col("normalized_query") == F.col("_q"), "left").join(near, F.col("normalized_query") == F.col("_s"), "left")
    first = F.get("_l", F.lit(0))
    matches = F.coalesce(F.transform("_l", lambda x: F.struct(x["match"], x["score"], x["row_no"])), F.array().cast(MATCHES))
    kind = F.when(first.isNull(), "none").when(first["score"] >= 99.9, "exact").otherwise("fuzzy")
    target = F.coalesce(F.nullif(first["generic_name_clean"], F.lit("")), F.col("normalized_query"))
    return out.select("query", "normalized_query", kind.alias("match_type"), target.alias("target"), matches.alias("matches"), F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))


def responses(resolved: DataFrame) -> DataFrame:
    """resolved with normalized, confidence, best_score, best_match, status, resolution_path and message."""
    best = F.get("matches", F.lit(0))
    out = resolved.withColumns({"best_score": F.round(F.coalesce(best["score"], F.lit(0.0)), 2), "confidence": E.score_to_confidence(best["score"]), "best_match": best["match"]})
    path = F.array_compact(F.array("query", "normalized_query", F.when(F.col("match_type") == "alias", F.col("target"))))
    message = F.when(F.col("normalized_query") == "", "Empty query").when(F.col("best_match").isNull(), "No confident match found").otherwise("OK")
    return out.withColumns({"status": E.classify_status(F.col("confidence"), F.col("best_match").isNotNull()), "normalized": F.col("target"), "resolution_path": E.dedupe_path(path), "message": message}).drop("target")


def with_rows(answers: DataFrame, store: Store) -> DataFrame:
    """answers with every match as its whole row: match, score, row_no, what the row shows, and its side effects."""
    shown = [*SHOWN, "side_effects_buckets"]
    each = answers.select("query", F.posexplode("matches").alias("_place", "_m")).join(store.rows.select(F.col("row_no").alias("_r"), *shown), F.col("_m.row_no") == F.col("_r"))
    full = F.struct("_place", F.struct(F.col("_m.match").alias("match"), F.col("_m.score").alias("score"), F.col("_m.row_no").alias("row_no"), *shown).alias("row"))
    each = each.groupBy(F.col("query").alias("_query")).agg(F.collect_list(full).alias("_rows"))  # at most top_k
    ordered = F.transform(F.array_sort("_rows", lambda a, b: a["_place"] - b["_place"]), lambda x: x["row"])
    out = answers.join(each, F.col("query").eqNullSafe(F.col("_query")), "left")
    empty = F.array().cast(each.select(ordered.alias("x")).schema["x"].dataType)
    return out.withColumn("matches", F.coalesce(ordered, empty)).drop("_query", "_rows")


def lookup_batch(queries: DataFrame, drugs: DataFrame | Store, top_k: int = C.TOP_K, min_score: float = C.MIN_SCORE) -> DataFrame:
    """An answer for each row of queries (a column query). drugs: a store, or a table as build_store() takes it."""
    store = drugs if isinstance(drugs, Store) else build_store(drugs)
    answers = with_rows(responses(resolve(queries, store, top_k, min_score)), store).withColumnRenamed("query", "_query")
    return queries.select("query").join(answers, F.col("query").eqNullSafe(F.col("_query"))).drop("_query")


def lookup_one(spark: SparkSession, query: str, drugs: DataFrame | Store | None = None, **options) -> dict:
    """The answer to one query, from the store of init_store() unless drugs are given."""
    return lookup_batch(spark.createDataFrame([(query,)], "query string"), init_store(spark) if drugs is None else drugs, **options).first().asDict(recursive=True)


def lookup_json(spark: SparkSession, query: str, drugs: DataFrame | Store | None = None, **options) -> str:
    """The answer to one query of at least one character as JSON; missing side effects have no field. ValueError for an empty query."""
    if not query:
        raise ValueError("a query of at least one character is needed")
    asked = spark.createDataFrame([(query,)], "query string")
    return lookup_batch(asked, init_store(spark) if drugs is None else drugs, **options).select(F.to_json(F.struct("*"))).first()[0]
