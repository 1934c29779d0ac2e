"""The queries of the engine over the driver's tables, each with the SQL that it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import exprs as E
from ..functions import textclean as T
from ..operators import core, facts, lookup, profile
from ..operators import relational as R
from ..sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def read(name: str) -> DataFrame:
                df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                return readers.deal(df) if name == "documents" else df  # long texts in few row groups

            return f(read)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _sql(name: str, c: str = "text") -> str:
    """DuckDB forms of the text functions."""
    space = lambda e: f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
    strip = lambda e: f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"
    plain = space(f"regexp_replace(replace({strip(f'lower({c})')}, '_', ' '), '[^a-z0-9\\s\\-]+', ' ', 'g')")
    generic = f"regexp_replace(regexp_replace(regexp_replace({strip(f'lower({c})')}, '^\\(.*?\\)\\s*', ''), '^\\d+(\\.\\d+)?%\\s*', ''), '\\bto deliver\\b', '', 'g')"
    generic = f"regexp_replace({space(f'''regexp_replace({generic}, '[^a-z0-9\\s\\-/+.]', ' ', 'g')''')}, '^0xygen', 'oxygen')"
    return {
        "space": space(c),
        "strip": strip(c),
        "normalize": space(f"regexp_replace({plain}, '{C.DOSAGE}', ' ', 'gi')"),
        "generic": generic,
        "dupe": f"regexp_replace({space(f'lower({c})')}, '[^a-z0-9 ]', '', 'g')",
    }[name]


def _docs(expr: str, name: str) -> str:
    return f"SELECT doc_id, {expr} AS {name} FROM documents"


_LIST = "replace(text, ' ', ',')"  # a comma-joined list made of a text


def _first_of_each(parts: str, cap: int) -> str:
    """The array kernel in SQL: first of each lower-cased item, in order, at most cap, comma-joined."""
    return f"""WITH p AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {parts} AS l FROM documents)),
        f AS (SELECT doc_id, arg_min(p, i) AS p, min(i) AS i FROM p WHERE p <> '' GROUP BY doc_id, lower(p)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM f),
        g AS (SELECT doc_id, string_agg(p, ', ' ORDER BY i) FILTER (WHERE k <= {cap}) AS s, max(n) AS n FROM r GROUP BY doc_id)"""


_ITEMS = f"list_transform(string_split({_LIST}, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"


# scalar functions -------------------------------------------------------------------------------


@query(_docs(_sql("normalize"), "norm"))
def n1_normalize_text(t):
    return t("documents").select("doc_id", E.normalize_text("text").alias("norm"))


@query(_docs(_sql("generic"), "generic"))
def n3_clean_generic(t):
    return t("documents").select("doc_id", E.clean_generic("text").alias("generic"))


@query(_docs(f"lower({_sql('space')})", "term"))
def n4_norm_term(t):
    return t("documents").select("doc_id", E.norm_term("text").alias("term"))


_FREQ = ["Very Common", "0.5%", "0.05%", "1% to 5%", " rare ", "postmarketing", None, "Infrequent", "2%"]


@query(
    "WITH f AS (SELECT l_orderkey, CASE l_orderkey % 9 " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(_FREQ)) + """ END AS raw FROM lineitem),
    g AS (SELECT coalesce(lower(trim(raw)), '') AS f FROM f), h AS (SELECT f, CASE WHEN f LIKE '%\\%' ESCAPE '\\' THEN try_cast(rtrim(f, '%') AS DOUBLE) END AS x FROM g)
    SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN f IN ('very common', 'common', 'frequent') THEN 'common' WHEN f IN ('uncommon', 'infrequent') THEN 'less_common' WHEN f IN ('rare', 'very rare') THEN 'rare'
      WHEN f = 'postmarketing' THEN f WHEN x >= 1 THEN 'common' WHEN x >= 0.1 THEN 'less_common' WHEN x IS NOT NULL THEN 'rare' ELSE 'unknown' END AS bucket FROM h) GROUP BY bucket"""
)
def n6_bucket_case(t):
    raw = F.get(F.array(*[F.lit(v) for v in _FREQ]), (F.col("l_orderkey") % 9).cast("int"))
    return t("lineitem").select(E.frequency_bucket(raw).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(_docs(f"left({_sql('strip')}, 2500)", "limited"))
def n9_limit_text(t):
    return t("documents").select("doc_id", E.limit_text("text", 2500).alias("limited"))


@query(_first_of_each(_ITEMS, 250) + " SELECT doc_id, coalesce(s, '') AS items FROM documents LEFT JOIN g USING (doc_id)")
def n10_limit_csv_list(t):
    return t("documents").select("doc_id", E.limit_csv_list(F.expr(_LIST), 250).alias("items"))


@query(_docs(f"CASE WHEN length({_sql('strip')}) <= 1200 THEN {_sql('strip')} ELSE regexp_replace(left({_sql('strip')}, 1199), '\\s+$', '') || '…' END", "capped"))
def n11_hard_cap(t):
    return t("documents").select("doc_id", E.hard_cap("text", 1200).alias("capped"))


@query(
    """WITH l AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(p_brand || '|' || p_type || ';' || p_name || '/iv', '[,|/;]+'), lambda x: trim(x)), lambda x: x <> '') AS a FROM part),
    c AS (SELECT p_partkey, list_transform(a, lambda x: CASE WHEN lower(x) IN ('iv', 'im', 'sc', 'sq', 'po') THEN upper(x) ELSE array_to_string(list_transform(string_split_regex(x, '\\s+'), lambda w: upper(w[1]) || lower(w[2:])), ' ') END) AS a FROM l)
    SELECT p_partkey, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), ', ') AS route FROM c"""
)
def n13_route_initcap(t):
    cell = F.concat_ws("|", "p_brand", F.concat_ws(";", "p_type", F.concat("p_name", F.lit("/iv"))))
    return t("part").select("p_partkey", E.normalize_route(cell).alias("route"))


@query(_first_of_each(_ITEMS.replace("lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')", "lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))").replace(_LIST, f"regexp_replace(replace({_LIST}, '|', ','), '\\s*;\\s*', ',', 'g')"), 20) + " SELECT doc_id, coalesce(CASE WHEN n > 20 THEN s || ', ... (+' || (n - 20) || ' more)' ELSE s END, '') AS brands FROM documents LEFT JOIN g USING (doc_id)")
def n15_trim_brands(t):
    return t("documents").select("doc_id", E.trim_brand_names(F.expr(_LIST)).alias("brands"))


@query(_docs(_sql("dupe"), "dupe_key"))
def n19_dupe_key(t):
    return t("documents").select("doc_id", E.dupe_key("text").alias("dupe_key"))


@query("""WITH s AS (SELECT o_orderkey, round(greatest(0.0, least(100.0, (o_orderkey % 1201) / 10.0 - 5))::DOUBLE / 100, 4) AS confidence FROM orders)
    SELECT o_orderkey, confidence, CASE WHEN confidence >= 0.85 THEN 'ok' WHEN confidence >= 0.6 THEN 'low_confidence' ELSE 'no_match' END AS status FROM s""")
def n20_confidence_status(t):
    scored = t("orders").select("o_orderkey", E.score_to_confidence((F.col("o_orderkey") % 1201) / 10.0 - 5).alias("confidence"))
    return scored.withColumn("status", E.classify_status(F.col("confidence"), F.lit(True)))


@query(_docs(f"array_to_string(string_split({_sql('normalize')}, ' ')[1:3], ' ')", "brand_key"))
def n23_short_brand_key(t):
    return t("documents").select("doc_id", E.short_brand_key("text").alias("brand_key"))


# predicates -------------------------------------------------------------------------------------


@query("SELECT p_partkey, list_has_any(list_transform(string_split(upper(r), ','), lambda x: trim(x)), [" + ", ".join(f"'{r}'" for r in C.ROUTES) + "]) AS ok FROM (SELECT p_partkey, p_type || CASE p_partkey % 3 WHEN 0 THEN ', Oral' WHEN 1 THEN ',nasal ' ELSE ', dental' END AS r FROM part)")
def f3_route_allowlist(t):
    n = F.col("p_partkey") % 3
    return t("part").select("p_partkey", E.route_ok(F.concat("p_type", F.when(n == 0, ", Oral").when(n == 1, ",nasal ").otherwise(", dental"))).alias("ok"))


_ONE = "lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"


@query(f"SELECT doc_id FROM documents WHERE {_ONE} <> '' AND length({_ONE}) <= 32 AND NOT regexp_matches({_ONE}, '{C.MIXTURE}') AND len(string_split(trim(regexp_replace({_ONE}, '\\s+', ' ', 'g')), ' ')) <= 3 AND len(regexp_extract_all({_ONE}, '\\d')) < 3 AND NOT starts_with({_ONE}, 'above ')")
def f4_single_name(t):
    return t("documents").filter(E.is_single_name("text")).select("doc_id")


@query("SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in C.BLACKLIST) + " AS banned FROM documents")
def f5_contains_any(t):
    return t("documents").select("doc_id", E.contains_any("text", C.BLACKLIST).alias("banned"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE upper(trim(l_returnflag)) = 'R' AND trim(l_linestatus) = 'F'")
def f8_pt_label_filter(t):
    renamed = t("lineitem").withColumns({"term_type": F.when(F.col("l_returnflag") == "R", "pt ").otherwise("LLT"), "source": F.when(F.col("l_linestatus") == "F", " label_confirmed").otherwise("all"), "side_effect": F.lit("x"), "generic_name_clean": F.lit("y")})
    return facts.label_terms(renamed).select("l_orderkey", "l_linenumber")


@query(f"SELECT doc_id, regexp_matches(text, '(?i){C.BAD_ENCODING}') AS bad, length(text) > 1200 AS too_long FROM documents")
def f10_f11_bad_encoding_too_long(t):
    return t("documents").select("doc_id", E.bad_encoding("text").alias("bad"), E.too_long("text").alias("too_long"))


_REPEATED = "len(w) >= 36 AND len(list_distinct(list_transform(range(0, len(w) - 18), lambda i: array_to_string(w[i+1:i+18], ' ')))) < len(w) - 18"


@query(f"SELECT doc_id, coalesce({_REPEATED}, false) AS repeated FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)")
def f12_repeated_window(t):
    return t("documents").select("doc_id", E.repeated_window("text").alias("repeated"))


_LABELS = " OR ".join(f"(length(lower(text)) - length(replace(lower(text), '{x.lower()}:', ''))) // {len(x) + 1} > 1" for x in C.LABELS)


@query(f"SELECT doc_id, {_LABELS} AS repeats FROM documents")
def f13_label_repeats(t):
    return t("documents").select("doc_id", E.label_repeats("text").alias("repeats"))


@query("SELECT p_partkey FROM part WHERE NOT (contains(lower(p_name), 'red') OR contains(lower(p_type), 'tin') OR p_brand = '') AND p_size > 10")
def f1_f6_conjunctive_mask(t):
    return t("part").filter(~(E.contains_any("p_name", ["red"]) | E.contains_any("p_type", ["tin"]) | E.is_blank("p_brand")) & (F.col("p_size") > 10)).select("p_partkey")


# joins ------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, coalesce(o.orders, 0)::BIGINT AS orders, coalesce(o.top_status, '') AS top_status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders, max(o_orderstatus) AS top_status FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def j1_left_join_fill(t):
    side = t("orders").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.count("*").alias("orders"), F.max("o_orderstatus").alias("top_status"))
    base = t("customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("key"))
    return facts.left_join_filled(base, side, "key", ["top_status"], ["orders"]).drop("key").select("c_custkey", "c_name", "orders", "top_status")


_RANK = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 99 END"


@query("""WITH b AS (SELECT o_custkey AS term, min(o_orderpriority) AS freq FROM orders GROUP BY o_custkey)
    SELECT o_orderkey, coalesce(freq, 'unknown') AS freq FROM orders LEFT JOIN b ON o_custkey = term""")
def j3_best_freq_join(t):
    orders = t("orders")
    best = facts.best_frequency(orders.select(F.col("o_custkey").alias("term"), "o_orderpriority"), "term", "o_orderpriority", F.substring("o_orderpriority", 1, 1).cast("int"))
    out = orders.select("o_orderkey", F.col("o_custkey").alias("term")).join(best, "term", "left")
    return out.select("o_orderkey", F.coalesce("o_orderpriority", F.lit("unknown")).alias("freq"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(nullif(p.p_name, ''), nullif(s.s_name, '')) AS name FROM lineitem
    LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0) p ON l_partkey = p_partkey LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0) s ON l_suppkey = s_suppkey
    WHERE coalesce(nullif(p.p_name, ''), nullif(s.s_name, '')) IS NOT NULL""")
def j4_coalesced_lookup(t):
    ids = t("part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"))
    ids = ids.unionByName(t("supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name")))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), "l_partkey").alias("flat"), F.concat(F.lit("s"), "l_suppkey").alias("stereo"))
    return facts.resolve_names(lines, ids, "flat", "stereo", "id", "name").select("l_orderkey", "l_linenumber", "name")


@query("SELECT count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j5_semi_core(t):
    core_ids = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return R.semi_join(t("events"), core_ids, "user_id").agg(F.count("*").alias("n"))


def _drugs(t) -> DataFrame:
    """Names of part as a dictionary; a few rows stand for the targets of aliases."""
    named = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("row_no"))
    named = named.select((F.col("row_no") + 10).alias("row_no"), F.col("p_name").alias("generic_name_clean"), F.upper("p_name").alias("generic_name"), F.concat("p_name", F.lit(" brand extra")).alias("brand_names"))
    return named.unionByName(named.sparkSession.createDataFrame([(1, "acetaminophen", "Acetaminophen", "Pain Free, Other")], "row_no long, generic_name_clean string, generic_name string, brand_names string"))


def _asked(t) -> DataFrame:
    """Queries: every part name as it is, with a dose and with a letter missing, and a few words."""
    name, k = F.col("p_name"), F.col("p_partkey") % 3
    made = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(name, F.lit(" 500mg tablet"))).otherwise(F.concat(F.left(name, F.lit(3)), F.substr(name, F.lit(5), F.lit(99))))
    words = t("part").sparkSession.createDataFrame([(w,) for w in ("paracetamol", "Panadol", "paracetamol 500mg", "paracetmol", "zzzzzz", "Oral")], "query string")
    return t("part").select(made.alias("query")).unionByName(words)


@query(f"""WITH k AS (SELECT DISTINCT {_sql('normalize', 'p_name')} AS key FROM part) SELECT p_partkey, key FROM (SELECT p_partkey, {_sql('normalize', "upper(p_name) || ' 500mg tablet'")} AS q FROM part) JOIN k ON q = key""")
def j6_exact_lookup(t):
    keys = lookup.build_keys(t("part").select(F.col("p_partkey").alias("row_no"), F.col("p_name").alias("generic_name_clean"), F.lit("").alias("generic_name"), F.lit("").alias("brand_names")))
    asked = t("part").select("p_partkey", E.normalize_text(F.concat(F.upper("p_name"), F.lit(" 500mg tablet"))).alias("q"))
    return lookup.exact_hits(asked, keys, "q").select("p_partkey", "key")


@query("""WITH a(alias, target) AS (VALUES ('paracetamol', 'acetaminophen'), ('panadol', 'acetaminophen'), ('tylenol', 'acetaminophen'), ('apap', 'acetaminophen'))
    SELECT event_id, target FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'panadol' WHEN 1 THEN 'apap' WHEN 2 THEN 'tylenol' WHEN 3 THEN 'aspirin' ELSE 'paracetamol' END AS q FROM events) JOIN a ON q = alias""")
def j7_alias_lookup(t):
    asked = F.get(F.array(*[F.lit(w) for w in ("Panadol 500 mg", "APAP", "tylenol", "aspirin", "paracetamol")]), (F.col("event_id") % 5).cast("int"))
    return t("events").select("event_id", lookup.alias_target(E.normalize_text(asked)).alias("target")).filter("target IS NOT NULL")


# aggregates -------------------------------------------------------------------------------------


@query(f"SELECT user_id, string_agg(event_type, ', ' ORDER BY {_RANK}, event_type) AS terms, count(event_type) AS n_terms FROM events GROUP BY user_id")
def a1_ordered_concat(t):
    ranked = t("events").withColumn("rank", E.priority("event_type", {"purchase": 1, "click": 2}))
    return facts.ordered_concat(ranked, "user_id", "rank", "event_type")


_BUCKETS = list(C.BUCKET_SIZES.items())


@query("SELECT user_id, " + ", ".join(f"coalesce(array_to_string(list_sort(list_distinct(list('t' || (event_id % 23)) FILTER (WHERE event_id % 5 = {i})))[1:{k}], ', '), '') AS {b}_terms" for i, (b, k) in enumerate(_BUCKETS)) + " FROM events GROUP BY user_id")
def a3_bucket_topk(t):
    bucket = F.get(F.array(*[F.lit(b) for b, _ in _BUCKETS]), (F.col("event_id") % 5).cast("int"))
    named = t("events").select("user_id", bucket.alias("bucket"), F.concat(F.lit("t"), F.col("event_id") % 23).alias("term"))
    return facts.bucket_top_k(named, "user_id", "bucket", "term")


@query("SELECT o_custkey, min(o_orderpriority) AS best, min(left(o_orderpriority, 1)::INT) AS rank FROM orders GROUP BY o_custkey")
def a4_best_priority(t):
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    return facts.best_frequency(t("orders"), "o_custkey", "o_orderpriority", rank).select("o_custkey", F.col("o_orderpriority").alias("best"), "rank")


@query("SELECT DISTINCT l_partkey AS id, l_returnflag AS kind, 'all' AS source FROM lineitem UNION ALL SELECT DISTINCT l_partkey, l_returnflag, 'label_confirmed' FROM lineitem WHERE l_linestatus = 'F'")
def a5_distinct_union(t):
    own = t("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("kind"), "l_linestatus")
    return R.tagged_distinct({"all": own.drop("l_linestatus"), "label_confirmed": own.filter("l_linestatus = 'F'").drop("l_linestatus")}, "source")


@query(f"""WITH n AS (SELECT 'p' || p_partkey % 97 AS id, arg_max(p_name, p_partkey) AS name FROM part WHERE p_partkey % 97 % 3 <> 0 GROUP BY 1 UNION ALL SELECT 's' || s_suppkey, arg_max(lower(s_name), s_suppkey) FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1),
    f AS (SELECT l.*, CASE WHEN l_orderkey % 3 = 0 THEN 'p1' ELSE 'p' || l_partkey % 97 END AS flat, 's' || l_suppkey AS stereo FROM lineitem l),
    r AS (SELECT {_sql('generic', "coalesce(nullif(a.name, ''), nullif(b.name, ''))")} AS g, 'effect ' || l_quantity::INT AS side_effect, l_returnflag AS term_type, l_linestatus FROM f LEFT JOIN n a ON flat = a.id LEFT JOIN n b ON stereo = b.id),
    c AS (SELECT {_sql('generic', 'p_name')} AS g FROM part WHERE p_size > 10 UNION SELECT {_sql('generic', 'lower(s_name)')} FROM supplier WHERE s_acctbal > 0)
    SELECT DISTINCT g AS generic_name_clean, side_effect, term_type, source FROM (SELECT g, side_effect, term_type, 'all' AS source FROM r UNION ALL SELECT g, side_effect, term_type, 'label_confirmed' FROM r WHERE l_linestatus = 'F') WHERE g <> '' AND g IN (SELECT g FROM c)""")
def j4_a5_j5_mart(t):
    part, supplier = t("part"), t("supplier")
    names = part.filter("p_partkey % 97 % 3 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey") % 97).alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("place"))
    names = R.union_all(names, supplier.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lower("s_name").alias("name"), F.col("s_suppkey").alias("place")))
    flat = F.when(F.col("l_orderkey") % 3 == 0, "p1").otherwise(F.concat(F.lit("p"), F.col("l_partkey") % 97))  # a third of all facts have one id
    raw = t("lineitem").select(flat.alias("flat"), F.concat(F.lit("s"), "l_suppkey").alias("stereo"), F.concat(F.lit("effect "), F.col("l_quantity").cast("int")).alias("side_effect"), F.col("l_returnflag").alias("term_type"), "l_linestatus")
    core = R.union_all(part.filter("p_size > 10").select(F.col("p_name").alias("generic_name_clean")), supplier.filter("s_acctbal > 0").select(F.lower("s_name").alias("generic_name_clean")))
    return facts.mart(raw.drop("l_linestatus"), raw.filter("l_linestatus = 'F'").drop("l_linestatus"), names, core)


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def a8_count_distinct(t):
    return R.count_distinct(t("lineitem"), {"l_partkey": "parts", "l_suppkey": "suppliers"})


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def a9_value_counts(t):
    return R.value_counts(t("documents"), ["source", "lang"])


def _labelled(t) -> DataFrame:
    return t("documents").join(t("labels"), "doc_id", "left")


_JOINED = "(SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"
_LABELLED = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 4) AS missing_pct FROM {_JOINED}" for c in _LABELLED))
def a11_missing_profile(t):
    return profile.missing_profile(_labelled(t))


@query("SELECT (sum(n - 1))::BIGINT AS duplicates, sum(n)::BIGINT AS row_count, round(sum(n - 1) / sum(n) * 100, 4) AS duplicate_pct FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)")
def a12_duplicate_profile(t):
    return profile.duplicate_profile(t("documents"), ["text", "lang"])


@query("SELECT round(avg(s), 4) AS mean_pct, round(min(s), 4) AS min_pct, round(max(s), 4) AS max_pct, count(*) FILTER (WHERE s < 80) AS rows_below FROM (SELECT (" + " + ".join(f"({c} IS NOT NULL)::INT" for c in _LABELLED) + f") / 7 * 100 AS s FROM {_JOINED})")
def a14_completeness(t):
    return profile.completeness_profile(_labelled(t))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE trim(coalesce({c}::VARCHAR, '')) <> '') AS populated, count(*) FILTER (WHERE trim(coalesce({c}::VARCHAR, '')) = '') AS empty, round(count(*) FILTER (WHERE trim(coalesce({c}::VARCHAR, '')) <> '') / count(*) * 100, 4) AS populated_pct FROM {_JOINED}" for c in ("lang", "quality", "toxic")))
def a15_critical_fields(t):
    return profile.critical_fields(_labelled(t), ["lang", "quality", "toxic"])


@query(f"""SELECT 'text' AS column_name, count(*) AS total, count(*) FILTER (WHERE trim(text) <> '') AS non_empty, count(*) FILTER (WHERE regexp_matches(text, '(?i){C.BAD_ENCODING}')) AS bad_encoding,
    count(*) FILTER (WHERE {_REPEATED}) AS repeated, count(*) FILTER (WHERE length(text) > 1200) AS too_long, count(*) FILTER (WHERE {_LABELS}) AS label_repeats
    FROM (SELECT text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)""")
def a16_quality_summary(t):
    return profile.quality_summary(t("documents"), ["text"])


# keys, casts, index -----------------------------------------------------------------------------


_CELLS = ["NaN", "1000000000000", "-2.9", "Infinity", "1e300", "x", None]
_WHOLE = "coalesce(try_cast(CASE WHEN isnan(try_cast({0} AS DOUBLE)) THEN 0 ELSE trunc(try_cast({0} AS DOUBLE)) END AS BIGINT), 0)"


@query(
    "SELECT event_id, " + _WHOLE.format("replace(replace(props, '{\"k\": ', ''), '}', '')") + " AS k, " + _WHOLE.format("event_type") + " AS none, " + _WHOLE.format("odd") + " AS odd FROM (SELECT *, CASE event_id % 7 "
    + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(_CELLS)) + " END AS odd FROM events)"
)
def p8_lenient_cast(t):
    odd = F.get(F.array(*[F.lit(v) for v in _CELLS]), (F.col("event_id") % 7).cast("int"))
    return t("events").select("event_id", E.lenient_int(F.expr("replace(replace(props, '{\"k\": ', ''), '}', '')")).alias("k"), E.lenient_int("event_type").alias("none"), E.lenient_int(odd).alias("odd"))


@query("SELECT p_partkey, printf('DRUG_%06d', row_number() OVER (ORDER BY p_name, p_partkey)) AS drug_id FROM part")
def p10_surrogate_key(t):
    return core.surrogate_keys(t("part").select("p_partkey", "p_name"), ["p_name", "p_partkey"]).select("p_partkey", "drug_id")


_KEYS = f"""SELECT p_partkey AS row_no, unnest([{_sql('normalize', 'p_name')}, {_sql('normalize', 'upper(p_brand)')}, array_to_string(string_split({_sql('normalize', "p_type || ' ' || p_name")}, ' ')[1:3], ' ')]) AS key FROM part"""


@query(f"SELECT key, min(row_no) AS row_no FROM ({_KEYS}) WHERE key <> '' GROUP BY key")
def w8_first_wins_index(t):
    drugs = t("part").select(F.col("p_partkey").alias("row_no"), F.col("p_name").alias("generic_name_clean"), F.upper("p_brand").alias("generic_name"), F.concat_ws(" ", "p_type", "p_name").alias("brand_names"))
    return lookup.build_keys(drugs).select("key", "row_no")


@query("SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM nation ORDER BY n_name LIMIT 10")
def w7_head_sample(t):
    return R.head_sample(t("nation").select("n_name"), "n_name", 10)


_FIELDS = ["normalized", "match_type", "status", "confidence", "best_score", "best_match", "message"]


def _answered(asked: DataFrame, drugs: DataFrame, key: str) -> DataFrame:
    """Every field of the answers, lists joined, and what the first match shows."""
    words, drugs = sinks.materialize(asked.select("query").distinct(), "asked"), sinks.materialize(drugs, "drugs")  # small, and read by many jobs: the large table is read once for each
    out = lookup.lookup_batch(words, drugs)
    m = F.get("matches", F.lit(0))
    shown = [m[c].alias(f"match_{c}") for c in ("match", "score", "row_no", "drug_id", "generic_name", "generic_name_clean", "brand_names", "drug_class", "route", "indications")]
    out = out.select("query", *_FIELDS, F.array_join("resolution_path", " > ").alias("resolution_path"), F.array_join("suggestions", "|").alias("suggestions"), F.size("matches").alias("n_matches"), *shown)
    return asked.join(out, "query").drop("query").select(key, *out.columns[1:])


_SHOWN = "'' AS match_drug_id, {g} AS match_generic_name, {c} AS match_generic_name_clean, {b} AS match_brand_names, '' AS match_drug_class, '' AS match_route, '' AS match_indications"


@query(f"""WITH q AS (SELECT p_partkey, p_name, {_sql('normalize', "upper(p_name) || ' 500mg tablet'")} AS n FROM part), d AS (SELECT p_name, min(p_partkey) + 10 AS row_no FROM part GROUP BY p_name)
    SELECT p_partkey, n AS normalized, 'exact' AS match_type, 'ok' AS status, 1.0::DOUBLE AS confidence, 100.0::DOUBLE AS best_score, n AS best_match, 'OK' AS message, upper(p_name) || ' 500mg tablet' AS resolution_path, '' AS suggestions,
    1 AS n_matches, n AS match_match, 100.0::DOUBLE AS match_score, row_no AS match_row_no, {_SHOWN.format(g="upper(p_name)", c="p_name", b="p_name || ' brand extra'")} FROM q JOIN d USING (p_name)""")
def q9_response_struct(t):
    return _answered(t("part").select("p_partkey", F.concat(F.upper("p_name"), F.lit(" 500mg tablet")).alias("query")), _drugs(t), "p_partkey")


# without a form in SQL --------------------------------------------------------------------------


@query()
def q3_lookup_cascade(t):
    out = lookup.lookup_batch(_asked(t), _drugs(t))
    return out.withColumn("matches", F.to_json("matches")).withColumns({c: F.array_join(c, "|") for c in ("suggestions", "resolution_path")})


@query()
def j8_fuzzy_topk(t):
    asked = _asked(t).select(E.normalize_text("query").alias("q")).filter("q <> ''")
    return lookup.fuzzy_top(asked, "q", lookup.build_store(_drugs(t)), C.MIN_SCORE, 10).select("q", F.posexplode("_top").alias("place", "m")).select("q", "place", "m.match", "m.score")


@query()
def t11_collapse_blocks(t):
    return t("documents").select("doc_id", T.cleaner(T.collapse_blocks)("text").alias("clean"))


@query()
def t16_clean_warnings(t):
    return t("documents").select("doc_id", T.cleaner(T.clean_warnings)("text").alias("clean"))


@query()
def t17_clean_long_text(t):
    return t("documents").select("doc_id", T.cleaner(T.clean_long_text)("text").alias("clean"))


def _shown(c: str) -> str:
    """Display text in SQL, of a column or value c; the steps are columns of one row."""
    strip = lambda e: f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"
    joined = lambda e: strip(f"regexp_replace(array_to_string({e}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")
    lines = lambda e: f"list_transform(string_split({e}, chr(10)), lambda x: {strip('x')})"
    text = strip(f"regexp_replace(coalesce({c}, ''), '\\r\\n?', chr(10), 'g')")
    text = strip(f"regexp_replace(regexp_replace(replace({text}, '\\n', chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
    bare = f"CASE WHEN x = '' THEN x ELSE {strip(f"regexp_replace(x, '{C.LEADING_PUNCTUATION}', '')")} END"
    text = joined(f"list_transform(list_filter({lines(text)}, lambda x: NOT regexp_matches(x, '{C.ONLY_PUNCTUATION}')), lambda x: {bare})")
    for again, end in (("\\b[: ]*", ":' || chr(10) || '"), (":\\s*$", ":")):
        for x in sorted(C.LABELS, key=len, reverse=True):
            text = f"regexp_replace({text}, '(?mi)^{x}:\\s*\\n\\s*{x}{again}', '{x}{end}', 'g')"
    text = joined(f"list_transform({lines(text)}, lambda x: {strip("regexp_replace(x, '[ \\t]+', ' ', 'g')")})")
    text = joined(f"list_filter({lines(text)}, lambda x: x = '' OR length(x) >= {C.SHOWN_LINE} OR ends_with(x, ':'))")
    return f"(SELECT CASE WHEN length(s) > {C.SHOWN_TEXT} THEN regexp_replace(left(s, {C.SHOWN_TEXT}), '\\s+$', '') || '…' ELSE s END FROM (SELECT {text} AS s))"


@query(f"SELECT doc_id, {_shown('text')} AS clean FROM documents")
def t18_display_text(t):
    return t("documents").select("doc_id", E.display_text("text").alias("clean"))


@query(
    " UNION ALL ".join(
        f"SELECT doc_id AS row_id, 'text' AS column_name, '{name}' AS check_name FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE {test}"
        for name, test in (("bad_encoding", f"regexp_matches(text, '(?i){C.BAD_ENCODING}')"), ("repeated", _REPEATED), ("too_long", f"length(text) > {C.LONG_TEXT}"), ("label_repeats", _LABELS))
    )
)
def k2_offenders(t):
    return profile.offenders(t("documents"), "doc_id", ["text"]).drop("cell")
