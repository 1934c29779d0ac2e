"""Benchmark decontamination by winnowing; native expressions only.

Of each window of `window` consecutive words, the smallest hash of its `gram`-word grams is its fingerprint. Neighbouring
windows mostly share it, so a document gives one row for each run of windows with the same fingerprint, a third as many
as it has words. Equal windows have equal fingerprints, so joining the runs with the fingerprints of the benchmark finds
every shared window; the windows of a run that meets one are then compared as a whole, by the SHA-256 of their words.

Fingerprints and windows of a benchmark are broadcast up to BROADCAST_WINDOWS of them, at most 100 bytes each; beyond it
they are joined by shuffle, salted, so that a passage of very many documents fills no single task. The items of a
document are found by the set of its windows' item sets: documents with the same set share one list of items, and no
list is copied to hits.

Defined cases: null and wordless texts have no words and are clean; an item of fewer words than a window is
one window, compared in full at its own length; a null item_id is not listed; items with the same id are one; repeated
rows each get their row, as do rows with a null or repeated doc_id, which are told apart by their texts; words may be
of any length; an empty table gives an empty result and an empty benchmark leaves all clean; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from ._common import ascii_lower, boxed, materialize, text_or_empty, unboxed

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS, SALTS = 250_000, 16


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(c), SEPARATORS), "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: the optimiser would copy a column's expression into every lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _once(words: Column) -> Column:
    """A generator that yields words; as a generator, it is computed once per row."""
    return F.explode(F.array(words)).alias("_w")


def _runs(w: Column, window: int, gram: int, short: list[int]) -> Column:
    """Structs m, s, n, f: n windows of m words from place s on that have the fingerprint f; of short lengths each window by itself."""
    count = lambda size: F.greatest(F.size(w) - F.lit(size - 1), F.lit(0))
    over = lambda a, size, f: F.transform(F.slice(a, F.lit(1), count(size)), f)
    after = lambda a, i, n: [F.get(a, i + F.lit(k)) for k in range(1, n)]
    tag = lambda m, s, n, f: F.struct(F.lit(m).alias("m"), s.alias("s"), n.alias("n"), f.alias("f"))
    grams = lambda wh: over(wh, gram, lambda x, i: F.xxhash64(x, *after(wh, i, gram)))
    least = lambda g: over(g, window, lambda x, i: F.least(x, *after(g, i, window - gram + 1)))
    changes = lambda f: F.filter(F.transform(f, lambda x, i: F.struct(i.alias("s"), x.alias("f"))), lambda x, i: (i == 0) | (F.get(f, i - 1) != x["f"]))
    lengths = lambda c, end: F.transform(c, lambda x, j: tag(window, x["s"], F.coalesce(F.get(c, j + 1)["s"], end) - x["s"], x["f"]))
    long = lambda wh: _let(grams(wh), lambda g: _let(least(g), lambda f: _let(changes(f), lambda c: lengths(c, F.size(f)))))
    whole = lambda wh, m: over(wh, m, lambda x, i: tag(m, i, F.lit(1), F.xxhash64(x, *after(wh, i, m), F.lit(m))))
    return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda wh: F.concat(long(wh), *[whole(wh, m) for m in short]))


def _exploded(rows: DataFrame, keep: list[str], window: int, gram: int, short: list[int]) -> DataFrame:
    found = rows.select(*keep, F.explode(_runs(F.col("_w"), window, gram, short)).alias("_x"))
    return found.select(*keep, F.col("_x.m").alias("_m"), F.col("_x.s").alias("_s"), F.col("_x.n").alias("_n"), F.col("_x.f").alias("_f"))


def _windows(runs: DataFrame, keep: list[str]) -> DataFrame:
    """runs with _w -> each window: keep, _s, _m and _key, the SHA-256 of its words."""
    each = runs.select(*keep, "_w", "_m", F.explode(F.sequence("_s", F.col("_s") + F.col("_n") - 1)).alias("_s"))
    return each.select(*keep, "_s", "_m", F.unhex(F.sha2(F.array_join(F.slice("_w", F.col("_s") + 1, F.col("_m")), " "), 256)).alias("_key"))


def _salted(rows: DataFrame, side: DataFrame, on: list[tuple[str, str]], how: str) -> DataFrame:
    """rows joined with side, which has a row for each key; each key of side is SALTS rows, so that a hot key of rows is dealt over as many tasks."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_t", "_s"), F.lit(SALTS)).cast("int"))
    side = side.withColumn("_side", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("_salt") == F.col("_side")
    for a, b in on:
        same = same & (F.col(a) == F.col(b))
    return dealt.join(side, same, how).drop("_salt", "_side")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 6, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, window, gram, broadcast_windows)
    text = text_or_empty(docs, text_col)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_t"), F.size(F.array_remove(F.split(text, RAW_SEPARATORS), "")).cast("long").alias("n_words"))
    out = plain.join(found.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_dt"), "n_hit", "n_items", "items_sha256"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_dt")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, gram: int, broadcast_windows: int) -> tuple[DataFrame, DataFrame]:
    """The windows of docs that the benchmark has (doc_id, _t, _s, _m, _set), and the benchmark's windows (_key, _item, _set).

    _set stands for the items of a window: their number and two sums of their hashes.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("_item"), _once(words_of(text_or_empty(benchmark, item_text_col)))).filter(F.size("_w") > 0)
    short = sorted(r[0] for r in items.filter(F.size("_w") < window).select(F.size("_w")).distinct().collect())  # at most window - 1 numbers
    parts = _exploded(items, ["_item", "_w"], window, gram, short).filter(F.col("_m") == F.least(F.size("_w"), F.lit(window)))
    known = materialize(_windows(parts, ["_item", "_f"]).select("_item", "_f", "_m", "_key").distinct(), "windows")
    sums = [F.count("_item"), F.sum(F.xxhash64("_item").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("_item", F.lit(1)))]
    owned = known.select("_key", "_item").distinct().groupBy("_key").agg(*[c.alias(f"_{k}") for k, c in enumerate(sums)])
    sets = materialize(owned.select("_key", F.unhex(F.md5(F.concat_ws(":", "_0", F.coalesce("_1", F.lit(0)), "_2"))).alias("_set")), "window-sets")
    prints = known.select(F.col("_f").alias("_bf"), F.col("_m").alias("_bm")).distinct()
    keys = sets.select(F.col("_key").alias("_bk"), "_set")

    text = text_or_empty(docs, text_col)
    read = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_t"), text.alias("_text"))
    worded = lambda rows, *more: rows.select("doc_id", "_t", *more, _once(words_of(F.col("_text"))))
    if sets.limit(broadcast_windows + 1).count() <= broadcast_windows:
        met = _exploded(worded(read), ["doc_id", "_t", "_w"], window, gram, short).join(F.broadcast(prints), (F.col("_f") == F.col("_bf")) & (F.col("_m") == F.col("_bm")), "left_semi")
        hits = _windows(met, ["doc_id", "_t"]).join(F.broadcast(keys), F.col("_key") == F.col("_bk"))
    else:  # runs meet by keys alone; a document's own runs then come back to its text
        met = _salted(_exploded(worded(read), ["doc_id", "_t"], window, gram, short), prints, [("_f", "_bf"), ("_m", "_bm")], "left_semi")
        met = materialize(met.groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_dt")).agg(F.collect_set(F.struct("_m", "_s", "_n")).alias("_x")), "met")
        bits, h = bloom.bits_for(met.count()), F.xxhash64("doc_id", "_t")
        some = bloom.probe(read, h, bloom.member_filter(met.select(F.xxhash64("_d", "_dt").alias("_h")), F.col("_h"), bits), bits, "_met").filter("_met")
        some = worded(some.join(met, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_dt"))), "_x")
        runs = some.select("doc_id", "_t", "_w", F.explode("_x").alias("_x")).select("doc_id", "_t", "_w", "_x.*")
        hits = _salted(_windows(runs, ["doc_id", "_t"]), keys, [("_key", "_bk")], "inner")
    return hits.select("doc_id", "_t", "_s", "_m", "_set"), known.select("_key", "_item").join(sets, "_key")


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, gram: int, broadcast_windows: int) -> DataFrame:
    """doc_id, _t (hash of the text), n_hit, n_items, items_sha256 of the documents with a hit."""
    hits, known = _hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window, gram, broadcast_windows)
    own = hits.groupBy("doc_id", "_t").agg(F.sort_array(F.collect_set(F.struct("_s", "_m"))).alias("_x"), F.sort_array(F.collect_set("_set")).alias("_sets"))  # a document's own hits
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "_x", zero,
        lambda a, x: F.struct((a["n"] + F.greatest(x["_s"] + x["_m"] - F.greatest(a["end"], x["_s"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["_s"] + x["_m"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    own = materialize(own.select("doc_id", "_t", covered.alias("n_hit"), F.md5(F.array_join(F.transform("_sets", F.hex), ",")).alias("_all"), "_sets"), "hits")
    # items once for each set of sets: of a set one window stands for all
    lists = own.groupBy("_all").agg(F.first("_sets").alias("_sets")).select("_all", F.explode("_sets").alias("_set"))
    stand = known.groupBy("_set").agg(F.min("_key").alias("_key"))
    listed = known.join(stand.withColumnRenamed("_set", "_stand"), "_key").select(F.col("_stand").alias("_set"), "_item").filter("_item is not null").distinct()
    items = lists.join(listed, "_set").select("_all", "_item").distinct().groupBy("_all").agg(F.array_sort(F.collect_list("_item")).alias("_ids"))
    told = items.select(F.col("_all").alias("_list"), F.size("_ids").cast("long").alias("n_items"), F.sha2(F.array_join("_ids", ","), 256).alias("items_sha256"))
    return own.join(told, F.col("_all") == F.col("_list"), "left").select("doc_id", "_t", "n_hit", "n_items", "items_sha256")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 6, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs without a benchmark window, with all their columns. Rows are told apart by doc_id and text, so a clean row stays whatever its id."""
    hits, _ = _hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window, gram, broadcast_windows)
    bad = materialize(hits.select(F.col("doc_id").alias("_bad"), F.col("_t").alias("_bt")).distinct(), "contaminated")
    bits = bloom.bits_for(bad.count())
    own = docs.select(boxed(docs), docs[id_col].alias("_id"), F.xxhash64(text_or_empty(docs, text_col)).alias("_t"))
    own = bloom.probe(own, F.xxhash64("_id", "_t"), bloom.member_filter(bad.select(F.xxhash64("_bad", "_bt").alias("_h")), F.col("_h"), bits), bits, "_maybe")
    left = own.filter("_maybe").join(bad, F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_t") == F.col("_bt")), "left_anti")
    return unboxed(own.filter("not _maybe").unionByName(left), docs)
