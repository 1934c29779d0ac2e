"""More queries of the engine: column operations, values, lists, groups, ranks, sets, files and text cleaners."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import exprs as E
from ..functions import textclean as T
from ..operators import core, facts, lookup
from ..operators import relational as R
from ..sources import readers, sinks
from .queries import _BUCKETS, _LIST, _SHOWN, _answered, _asked, _docs, _drugs, _first_of_each, _shown, _sql, query


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(c: str, pairs: list[tuple[str, str]]) -> str:
    return reduce(lambda e, p: f"replace({e}, {_quoted(p[0])}, {_quoted(p[1])})", pairs, c)


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_TRUNCATED = _replaced(f"regexp_replace(regexp_replace(replace({{}}, '�', ''), '\\bcetaminophen\\b', 'acetaminophen', 'gi'), '\\bcetamino\\b', 'acetaminophen', 'gi')", C.TRUNCATIONS)
_TRUNCATED = _STRIP.format(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_TRUNCATED}, 'â.{{{{1,2}}}}', '...', 'g'), '[ \\t]+', ' ', 'g'), '\\s+\\n', chr(10), 'g'), '\\n\\s+', chr(10), 'g')")


# columns ----------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name AS name, 'all' AS source, '' AS note, '2024-01-31' AS last_updated FROM nation")
def p1_p6_column_ops(t):
    df = readers.strip_names(t("nation").withColumnRenamed("n_name", " name ").withColumns({"source": F.lit("all"), "priority": F.lit(9)}))
    return readers.add_missing(df, ["note", "name"]).withColumn("last_updated", F.lit("2024-01-31")).drop("priority").select("n_nationkey", "name", "source", "note", "last_updated")


@query("SELECT c_custkey, coalesce(o.last_status, '') AS last_status, coalesce(o.n, 0) AS n, coalesce(o.rank, 99) AS rank FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS last_status, count(*) AS n, min(left(o_orderpriority, 1)::INT) AS rank FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def p7_null_fill(t):
    side = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("last_status"), F.count("*").alias("n"), F.min(F.left("o_orderpriority", F.lit(1)).cast("int")).alias("rank"))
    return R.null_fill(t("customer").select("c_custkey").join(side, "c_custkey", "left"), {"last_status": "", "n": 0, "rank": 99, "absent": ""})


_RAW_FREQUENCY = "CASE o_orderkey % 6 WHEN 0 THEN 'Very common' WHEN 1 THEN 'frequent' WHEN 2 THEN 'infrequent' WHEN 3 THEN 'rare' WHEN 4 THEN 'Uncommon' END"


@query("SELECT o_orderkey, CASE lower(f) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.PRIORITY_BUCKETS.items()) + " ELSE 99 END AS bucket_rank, CASE f " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.PRIORITY_SUMMARY.items()) + f" ELSE 99 END AS summary_rank FROM (SELECT o_orderkey, {_RAW_FREQUENCY} AS f FROM orders)")
def p9_value_map(t):
    raw = F.expr(_RAW_FREQUENCY)
    return t("orders").select("o_orderkey", E.priority(F.lower(raw), C.PRIORITY_BUCKETS).alias("bucket_rank"), E.priority(raw, C.PRIORITY_SUMMARY).alias("summary_rank"))


_CORE = """SELECT p_name AS generic, p_brand AS brand, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS class, CASE p_partkey % 3 WHEN 0 THEN 'Oral' WHEN 1 THEN 'other, nasal' ELSE 'dental' END AS route, CASE WHEN p_partkey % 8 = 0 THEN 'nausea, Nausea,itch' END AS label,
    CASE WHEN p_partkey % 7 = 0 THEN 'Nicotine relief' ELSE ' For ' || p_name || ' ' END AS ind FROM part"""
_BANNED = " OR ".join(f"contains(lower(generic || '|' || brand || '|' || ind), '{w}')" for w in C.BLACKLIST + C.NICOTINE)


@query(f"""WITH r AS ({_CORE}), k AS (SELECT * FROM r WHERE route <> 'dental' AND (class IS NOT NULL OR label IS NOT NULL) AND length(generic) <= 32 AND NOT ({_BANNED}))
    SELECT printf('DRUG_%06d', row_number() OVER (ORDER BY generic, brand, route, coalesce(class, ''), trim(ind), coalesce(label, ''))) AS drug_id, generic AS generic_name_clean, brand AS brand_names, route, coalesce(class, '') AS drug_class, trim(ind) AS indications, CASE WHEN label IS NULL THEN '' ELSE 'nausea, itch' END AS side_effects FROM k""")
def p10_f7_core_table(t):
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = t("part").select(
        name.alias("generic_name"), F.col("p_brand").alias("brand_names"), F.when(k % 4 != 0, F.col("p_type")).alias("drug_class"), F.when(k % 3 == 0, "Oral").when(k % 3 == 1, "other, nasal").otherwise("dental").alias("route"),
        F.when(k % 8 == 0, "nausea, Nausea,itch").alias("side_effects_label_confirmed"), F.when(k % 7 == 0, "Nicotine relief").otherwise(F.concat(F.lit(" For "), name, F.lit(" "))).alias("indications"),
    )
    out = core.core_table(raw, "2024-01-31")
    return out.select("drug_id", "generic_name_clean", "brand_names", "route", F.coalesce("drug_class", F.lit("")).alias("drug_class"), "indications", F.coalesce("side_effects_label_confirmed", F.lit("")).alias("side_effects"))


# predicates -------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_STRIP.format('text')} = '' OR regexp_matches(lower(text), {_quoted(C.BAD_GENERIC)}) AS bad FROM documents")
def f2_bad_generic(t):
    return t("documents").select("doc_id", E.looks_bad_generic("text").alias("bad"))


@query("SELECT event_id FROM events WHERE event_id % 4 NOT IN (0, 1) AND trim(event_type) <> ''")
def f9_not_blank(t):
    cell = F.when(F.col("event_id") % 4 == 0, "  ").when(F.col("event_id") % 4 == 2, F.concat(F.lit(" "), "event_type")).when(F.col("event_id") % 4 == 3, F.col("event_type"))
    return t("events").filter(~E.is_blank(cell)).select("event_id")


# values and lists -------------------------------------------------------------------------------


@query(f"SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' 2.5 mg Oral x' || p_size, {_quoted(C.DOSAGE)}, ' ', 'gi'), '\\s+', ' ', 'g')) AS bare FROM part")
def n2_strip_dosage(t):
    return t("part").select("p_partkey", E.strip_dosage_and_form(F.concat("p_name", F.lit(" 2.5 mg Oral x"), "p_size")).alias("bare"))


@query(_docs(f"lower({_sql('strip')})", "term"))
def n5_simple_term(t):
    return t("documents").select("doc_id", E.simple_term("text").alias("term"))


@query(_docs(f"trim(regexp_replace({_replaced('text', C.MOJIBAKE)}, '\\s+', ' ', 'g'))", "fixed"))
def n7_fix_mojibake(t):
    return t("documents").select("doc_id", E.fix_mojibake("text").alias("fixed"))


@query(_docs(_TRUNCATED.format("text"), "fixed"))
def n8_fix_truncations(t):
    return t("documents").select("doc_id", E.fix_truncations("text").alias("fixed"))


@query(_docs("CASE WHEN length(text) > 1500 THEN regexp_replace(left(text, 1500), '\\s+$', '') || '…' ELSE text END", "capped"))
def n12_soft_cap(t):
    return t("documents").select("doc_id", E.soft_cap("text").alias("capped"))


@query(
    """WITH l AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(p_brand || '|' || p_type || ';' || p_name || ' (oral-x)/Iv', '[,|/;]+'), lambda x: trim(x)), lambda x: x <> '') AS a FROM part),
    s AS (SELECT p_partkey, list_transform(a, lambda x: CASE WHEN lower(x) IN ('iv', 'im', 'sc', 'sq', 'po') THEN upper(x) ELSE array_to_string(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(x[i - 1], '[A-Za-z]') THEN upper(x[i]) ELSE lower(x[i]) END), '') END) AS a FROM l)
    SELECT p_partkey, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), ', ') AS route FROM s"""
)
def n14_route_title(t):
    cell = F.concat("p_brand", F.lit("|"), "p_type", F.lit(";"), "p_name", F.lit(" (oral-x)/Iv"))
    return t("part").select("p_partkey", E.normalize_route_service(cell).alias("route"))


def _trimmed(base: str) -> str:
    return f"list_transform(string_split({base}, ','), lambda x: trim(x, ' .;'))"


_FLAT = "trim(regexp_replace(replace({}, '|', ','), '\\s+', ' ', 'g'))"


@query(_first_of_each(_trimmed(_FLAT.format(_TRUNCATED.format(_LIST))), 120) + " SELECT doc_id, coalesce(s, '') AS effects FROM documents LEFT JOIN g USING (doc_id)")
def n16_side_effects_text(t):
    return t("documents").select("doc_id", E.clean_side_effects_text(F.expr(_LIST)).alias("effects"))


@query(_first_of_each(_trimmed(_FLAT.format(_LIST)), 80) + f" SELECT doc_id, coalesce(s, {_FLAT.format(_LIST)}, '') AS effects FROM documents LEFT JOIN g USING (doc_id)")
def n17_clean_list(t):
    return t("documents").select("doc_id", E.clean_list(F.expr(_LIST)).alias("effects"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'common' END, CASE WHEN p_size % 3 = 0 THEN 'rare' END) END AS buckets, CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN concat_ws('|', CASE WHEN p_size % 2 = 0 THEN p_name END, CASE WHEN p_size % 3 = 0 THEN p_type || ', x' END) END AS lists FROM part")
def n18_side_effect_map(t):
    found = E.side_effect_map({"common": F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" ., "), F.upper("p_name"))), "rare": F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit("|x"))).otherwise("  "), "unknown": F.lit(None).cast("string")})
    return t("part").withColumn("m", found).select("p_partkey", F.array_join(F.map_keys("m"), ",").alias("buckets"), F.array_join(F.map_values("m"), "|").alias("lists"))


_PATH = "[upper(p_name) || ' 500mg', p_name, '', p_type, ' ' || lower(p_type), '10 mg']"


@query(f"SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: n[i] <> '' AND list_position(n, n[i]) = i), ' > ') AS path FROM (SELECT p_partkey, {_PATH} AS l, list_transform({_PATH}, lambda x: {_sql('normalize', 'x')}) AS n FROM part)")
def n22_dedupe_path(t):
    path = F.array(F.concat(F.upper("p_name"), F.lit(" 500mg")), "p_name", F.lit(""), "p_type", F.concat(F.lit(" "), F.lower("p_type")), F.lit("10 mg"))
    return t("part").select("p_partkey", F.array_join(E.dedupe_path(path), " > ").alias("path"))


_BREAKS = _STRIP.format("regexp_replace(text, '\\r\\n?', chr(10), 'g')")


@query(_docs(_STRIP.format(f"regexp_replace(regexp_replace(replace({_BREAKS}, '\\n', chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"), "broken"))
def n24_canonical_breaks(t):
    return t("documents").select("doc_id", E.canonical_breaks("text").alias("broken"))


@query("SELECT source, count(lang) AS known, round(count(lang) / count(*) * 100, 4) AS known_pct FROM documents GROUP BY source")
def n25_percent(t):
    return R.share_known(t("documents"), "source", "lang")


@query(_first_of_each("string_split(text, ' ')", 50) + " SELECT doc_id, coalesce(s, '') AS items FROM documents LEFT JOIN g USING (doc_id)")
def l1_array_kernel(t):
    return t("documents").select("doc_id", F.array_join(E.distinct_keep_first(F.split(E.text("text"), " "), cap=50), ", ").alias("items"))


# joins, groups, ranks, sets ---------------------------------------------------------------------


@query("SELECT c_custkey, " + ", ".join(f"coalesce({b}_terms, '') AS {b}_terms" for b, _ in _BUCKETS) + " FROM customer LEFT JOIN (SELECT user_id, " + ", ".join(f"coalesce(array_to_string(list_sort(list_distinct(list(event_type) FILTER (WHERE event_id % 5 = {i})))[1:{k}], ', '), '') AS {b}_terms" for i, (b, k) in enumerate(_BUCKETS)) + " FROM events GROUP BY user_id) ON c_custkey = user_id")
def j2_left_join_buckets(t):
    bucket = F.get(F.array(*[F.lit(b) for b, _ in _BUCKETS]), (F.col("event_id") % 5).cast("int"))
    lists = facts.bucket_top_k(t("events").select(F.col("user_id").cast("string").alias("key"), bucket.alias("bucket"), "event_type"), "key", "bucket", "event_type")
    base = t("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"))
    return facts.left_join_filled(base, lists, "key", [f"{b}_terms" for b, _ in _BUCKETS]).drop("key")


@query("SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id, event_type")
def a2_group_list(t):
    return R.group_list(t("events"), ["user_id", "event_type"], "event_id", "ids")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def a6_keep_first(t):
    return facts.first_by(t("events").select("user_id", "event_id", "event_type", "value"), ["user_id"], [F.desc("value"), F.col("event_id")]).drop("value")


@query("SELECT DISTINCT lower(p_brand) AS brand FROM part")
def a7_unique_set(t):
    return R.unique_set(t("part"), F.lower("p_brand"), "brand")


@query("SELECT count(*) AS row_count, count(lang) FILTER (WHERE trim(lang) <> '') AS lang_filled, count(source) FILTER (WHERE trim(source) <> '') AS source_filled, count(text) FILTER (WHERE trim(text) <> '') AS text_filled FROM documents")
def a10_k5_coverage(t):
    return sinks.coverage_metrics(t("documents"), ["lang", "source", "text"])


@query("SELECT lang, doc_id, length(text) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) = 1")
def a17_longest_by_key(t):
    return R.longest_by_key(t("documents"), "lang", "text", "doc_id")


@query("SELECT o_orderpriority, o_orderdate, o_orderkey FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 300")
def w1_w2_sorted_head(t):
    return R.sorted_head(t("orders").select("o_orderpriority", "o_orderdate", "o_orderkey"), ["o_orderpriority", "o_orderdate", "o_orderkey"], 300)


@query("""WITH r AS (SELECT event_type, user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 10),
    d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) = 1)
    SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INT AS place FROM d QUALIFY place <= 5""")
def w3_w4_ranked_dedupe(t):
    some = t("events").select("event_type", "user_id", "event_id", "value")
    return R.ranked_dedupe(some, "event_type", "user_id", [F.desc("value"), F.col("event_id")], 10, 5).drop("value")


@query("SELECT l_partkey, array_to_string(list_sort(list_distinct(list(l_shipdate::DATE::VARCHAR)))[1:8], ', ') AS days FROM lineitem GROUP BY l_partkey")
def w6_first_of_sorted_set(t):
    return R.first_of_sorted_set(t("lineitem"), "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd"), 8, "days")


@query("SELECT 'c' AS kind, c_name AS name FROM customer UNION ALL SELECT 's', s_name FROM supplier UNION ALL SELECT 'c', c_name FROM customer WHERE c_acctbal < 0")
def u1_union_all(t):
    own = t("customer").select(F.lit("c").alias("kind"), F.col("c_name").alias("name"), "c_acctbal")
    return R.union_all(own.drop("c_acctbal"), t("supplier").select(F.col("s_name").alias("name"), F.lit("s").alias("kind")), own.filter("c_acctbal < 0").drop("c_acctbal"))


@query("WITH u AS (SELECT lower(p_brand) AS key, 0 AS part, p_partkey AS place FROM part UNION ALL SELECT lower(p_type), 1, p_partkey FROM part UNION ALL SELECT lower(p_brand), 2, -p_partkey FROM part) SELECT key, part, place FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY part, place) = 1")
def u2_ordered_union(t):
    brands = t("part").select(F.lower("p_brand").alias("key"), F.col("p_partkey").alias("place"))
    types = t("part").select(F.lower("p_type").alias("key"), F.col("p_partkey").alias("place"))
    return R.ordered_union([brands, types, brands.withColumn("place", -F.col("place"))], "key", "place")


# files ------------------------------------------------------------------------------------------


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, '') AS lang, source FROM documents")
def s1_k1_csv(t):
    docs = t("documents").select("doc_id", "lang", "source")
    path = sinks.scratch(_spark(docs), "csv")
    sinks.write_csv(docs, path)
    return readers.read_csv(_spark(docs), path)


@query("SELECT p_partkey::VARCHAR AS part, nullif(CASE WHEN p_size % 5 = 0 THEN 'NA' ELSE p_name END, 'NA') AS name FROM part")
def s3_s5_tsv_missing(t):
    part = t("part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "NA").otherwise(F.col("p_name")).alias("name"), "p_type")
    path = sinks.scratch(_spark(part), "tsv")
    part.write.option("sep", "\t").csv(path)
    return readers.read_tsv(_spark(part), path, ["part", "name"])


@query("SELECT p_brand AS code, p_size::VARCHAR AS last FROM part")
def s7_s9_first_and_last(t):
    part = t("part").select("p_partkey", "p_brand", "p_type", "p_size")
    path = sinks.scratch(_spark(part), "wide-tsv")
    part.write.option("sep", "\t").csv(path)
    return readers.first_and_last(readers.read_tsv_any(_spark(part), path, 4), 1, ("code", "last"))


@query("SELECT lower(p_name) || ' ' || p_partkey AS generic_name, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS drug_class FROM part WHERE p_size % 7 <> 0")
def s8_xml_classes(t):
    record = F.struct(F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("direct-parent"))
    part = t("part").select(F.when(F.col("p_size") % 7 != 0, F.concat(F.initcap("p_name"), F.lit(" "), "p_partkey")).alias("name"), record.alias("classification"))
    path = sinks.scratch(_spark(part), "xml")
    part.write.format("xml").option("rowTag", "drug").option("rootTag", "drugs").save(path)
    return readers.read_class_xml(_spark(part), path)


@query("SELECT count(*) AS row_count, count(lang) FILTER (WHERE trim(lang) <> '') AS lang_filled, count(text) FILTER (WHERE trim(text) <> '') AS text_filled FROM documents")
def k5_a10_measured_write(t):
    docs = t("documents")
    told = sinks.write_measured(docs, sinks.scratch(_spark(docs), "measured"), ["lang", "text"])
    return _spark(docs).createDataFrame([tuple(told.values())], ", ".join(f"{k} long" for k in told))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE 'new ' || p_name END AS name FROM part WHERE p_size <> 7")
def k1_replaced_table(t):
    part = t("part").select("p_partkey", F.col("p_name").alias("name"), "p_size")
    path = sinks.scratch(_spark(part), "replaced")
    old = sinks.replace(part, path)
    changed = old.filter("p_size <> 7").withColumn("name", F.when(F.col("p_size") > 25, F.col("name")).otherwise(F.concat(F.lit("new "), "name")))
    return sinks.replace(changed.drop("p_size"), path)


def _unequal(part: DataFrame) -> DataFrame:
    """part in the order of its keys, dealt to six files of which each is about twice as large as the one before."""
    return part.repartitionByRange(6, F.floor(F.log2("p_partkey"))).sortWithinPartitions("p_partkey")


@query("SELECT lower(p_name) AS generic_name, arg_min(p_type, p_partkey) AS drug_class FROM part GROUP BY lower(p_name)")
def s8_a6_first_record_over_files(t):
    record = F.struct(F.col("p_type").alias("direct-parent"))
    part = _unequal(t("part")).select(F.initcap("p_name").alias("name"), record.alias("classification"))
    path = sinks.scratch(_spark(part), "xml-files")
    part.write.format("xml").option("rowTag", "drug").option("rootTag", "drugs").save(path)
    return readers.read_class_xml(_spark(part), path)


@query("SELECT p_partkey::VARCHAR AS part, p_name AS name, row_number() OVER (ORDER BY p_partkey) - 1 AS row_no FROM part")
def s1_w8_rows_over_files(t):
    part = _unequal(t("part").select("p_partkey", F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))).drop("p_partkey")
    path = sinks.scratch(_spark(part), "csv-files")
    sinks.write_csv(part, path)
    return readers.read_csv(_spark(part), path, split=True, row_no="row_no")


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents")
def s1_s2_split_csv(t):
    docs = t("documents").select("doc_id", "text", "lang")
    path = sinks.scratch(_spark(docs), "split-csv")
    sinks.write_csv(docs, path)
    return readers.read_csv(_spark(docs), path, split=True)


# lookup -----------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'acetaminophen' AS normalized, 'alias' AS match_type, 'ok' AS status, 0.95::DOUBLE AS confidence, 95.0::DOUBLE AS best_score, 'acetaminophen' AS best_match, 'OK' AS message, CASE p_partkey % 4 WHEN 0 THEN 'Panadol 500 mg' WHEN 1 THEN 'APAP' WHEN 2 THEN 'tylenol tablet' ELSE 'paracetamol' END || ' > acetaminophen' AS resolution_path, 'acetaminophen|paracetamol|panadol|tylenol|apap' AS suggestions, 1 AS n_matches, 'acetaminophen' AS match_match, 95.0::DOUBLE AS match_score, 1::BIGINT AS match_row_no, " + _SHOWN.format(g="'Acetaminophen'", c="'acetaminophen'", b="'Pain Free, Other'") + " FROM part")
def q5_alias_branch(t):
    word = F.get(F.array(*[F.lit(w) for w in ("Panadol 500 mg", "APAP", "tylenol tablet", "paracetamol")]), (F.col("p_partkey") % 4).cast("int"))
    return _answered(t("part").select("p_partkey", word.alias("query")), _drugs(t), "p_partkey")


@query()
def j9_suggestions(t):
    asked = _asked(t).select(E.normalize_text("query").alias("q")).filter("q <> ''")
    return lookup.suggest(asked, "q", lookup.build_store(_drugs(t)), C.MIN_SCORE - 35).select("q", F.array_join("suggestions", "|").alias("suggestions"))


@query()
def q8_match_rows(t):
    k, name = F.col("row_no"), F.col("generic_name_clean")
    long = {c: F.concat(F.lit("Warning: do not use "), name, F.lit("\n..\nshort\n"), F.lit("Ask a doctor before taking "), name) for c in C.TEXT_LIMITS}
    lists = {f"{b}_side_effects": F.when(k % 2 == 0, F.concat(name, F.lit(", x; , X"))) for b in ("common", "less_common", "rare", "postmarketing", "unknown_frequency")}
    full = _drugs(t).withColumns({"drug_id": F.concat(F.lit("DRUG_"), k), "drug_class": F.lit("class"), "route": F.lit("oral/iv"), "sources": F.lit("x")} | long | lists)
    rows = lookup.match_rows(full)
    return rows.select([F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() in ("struct", "map", "array") else F.col(c) for c in rows.columns])


_INDICATIONS = "'For pain of ' || c || ':' || chr(10) || '..' || chr(10) || 'too short' || chr(10) || '- Take one of ' || c || ' in the   morning' || repeat(' and one more', k % 150)"


@query(f"""WITH d AS (SELECT p_name AS c, min(p_partkey) + 10 AS k FROM part GROUP BY p_name UNION ALL SELECT 'acetaminophen', 1), a AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'acetaminophen' ELSE p_name END AS c FROM part)
    SELECT p_partkey, c AS match, k AS row_no, 'DRUG_' || k AS drug_id, 'class' AS drug_class, 'Oral, IV' AS route, {_shown(_INDICATIONS)} AS indications, c || ', itch' AS common, CASE WHEN k % 2 = 0 THEN 'rash of ' || c END AS rare FROM a JOIN d USING (c)""")
def q8_w4_answer_rows(t):
    k, name = F.col("row_no"), F.col("generic_name_clean")
    shown = {"drug_id": F.concat(F.lit("DRUG_"), k), "drug_class": F.lit("class"), "route": F.lit("oral/iv"), "indications": F.expr(_INDICATIONS.replace("k %", "int(row_no) %").replace(" c ", " generic_name_clean ").replace("chr(10)", "char(10)"))}
    drugs = _drugs(t).withColumns(shown | {"common_side_effects": F.concat(name, F.lit(" , itch, Itch")), "rare_side_effects": F.when(k % 2 == 0, F.concat(F.lit("rash of "), name))})
    asked = t("part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "Panadol 500 mg").otherwise(F.upper("p_name")).alias("query"))
    out = lookup.lookup_batch(asked.select("query").distinct(), drugs).select("query", F.get("matches", F.lit(0)).alias("m"))
    effects = F.col("m.side_effects_buckets")
    return asked.join(out, "query").select("p_partkey", "m.match", "m.row_no", "m.drug_id", "m.drug_class", "m.route", "m.indications", effects["common"].alias("common"), effects["rare"].alias("rare"))


# text cleaners -------------------------------------------------------

_SECTION = "CASE WHEN contains(b, ':' || chr(10)) THEN {0} ELSE {1} END"


@query(
    "WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(replace(text, '. ', ':' || chr(10)), '^\\s+|\\s+$', '', 'g'), '\\n{2,}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents), "
    "b AS (SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1)::INT AS place FROM s) SELECT doc_id, place, "
    + _SECTION.format(_STRIP.format("split_part(b, ':' || chr(10), 1)"), "''") + " AS title, " + _SECTION.format(_STRIP.format("substr(b, strpos(b, ':' || chr(10)) + 2)"), "b") + " AS body FROM b"
)
def t13_sections(t):
    told = F.posexplode(E.sections(F.replace("text", F.lit(". "), F.lit(":\n")))).alias("place", "s")
    return t("documents").select("doc_id", told).select("doc_id", (F.col("place") + 1).alias("place"), "s.title", "s.body")


@query()
def t19_clean_table(t):
    listed = F.concat(F.regexp_replace("text", " ", ", "), F.lit(";x"))
    return T.clean_table(t("documents").select("doc_id", *[F.col("text").alias(c) for c in T.CLEANERS], listed.alias("brand_names"), F.lit("oral, ORAL|nasal").alias("route"), listed.alias("rare_side_effects"), F.lit("  as it is ").alias("other")))


# without a form in SQL ---

CLEANERS = {
    "t3_cut_repeated_prefix": T.cut_repeated_prefix, "t5_cut_at_repeated_window": T.cut_at_repeated_window, "t6_drop_repeated_windows": T.drop_repeated_windows, "t7_dedupe_headlines": T.dedupe_headlines,
    "t8_dedupe_units": T.dedupe_units, "t9_dedupe_sentences": T.dedupe_sentences, "t10_heading_blocks": partial(T.dedupe_heading_blocks, headings=C.LONG_TEXT_HEADINGS, ignore_case=True), "t12_cap_sections": T.cap_sections,
    "t14_merge_sections": T.merge_sections, "t15_openfda_blocks": T.clean_openfda_blocks,
}


def _cleaned(f):
    return lambda t: t("documents").select("doc_id", T.cleaner(f)("text").alias("clean"))


for _name, _f in CLEANERS.items():
    _run = _cleaned(_f)
    _run.__name__ = _name
    query()(_run)
