"""The queries of this subpackage: opN_<name> applies operator N, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, langid, license_scan, packing, periodic_runs, pii, prefix_trie, quality, resharding, simhash, suffix_dedup, url_filter
from ._common import table


#: Fixed by the contract of op7: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.reshard(table(spark, sf_dir, "documents"), new_shards=24, old_shards=16)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), classes=True)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.branched(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find(table(spark, sf_dir, "documents"), loop=periodic_runs.loop_tail)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands at the top of the repository

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, f in globals().items() if (name.startswith("op") or name == "pipeline") and callable(f)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(string_split_regex({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: The operators that SQL can express; tests hold the others against brute force.
ORACLE = {
    "op6_exact_dedup": f"""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOW} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op7_url_filter": f"""WITH r(verdict, h, p) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN f USING (page_id)""",
    "op9_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
        bw AS (SELECT item, m, array_to_string(w[s : s + m - 1], ' ') AS phrase FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT m FROM bw),
        dw AS (SELECT doc_id, s, m, array_to_string(w[s : s + m - 1], ' ') AS phrase FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes WHERE len(w) >= m)),
        h AS (SELECT doc_id, s, m, item FROM dw JOIN bw USING (phrase, m)),
        hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS p FROM h) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op11_prefix_trie": """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda acc, x: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, xor(acc, x)), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT k.conv_id, 0 AS part, p, role, text FROM k JOIN t ON t.conv_id = base AND p < h UNION ALL SELECT conv_id, 1, p, role, text FROM k JOIN t USING (conv_id) WHERE p >= h),
        s AS (SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY part, p) FILTER (WHERE p IS NOT NULL), []) AS seq FROM k LEFT JOIN r USING (conv_id) GROUP BY conv_id),
        pre AS (SELECT conv_id, d, seq[1:d] AS pre, len(seq) = d AS ends FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
        n AS (SELECT pre, d, min(conv_id) AS c, count(*) AS k, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS e FROM pre GROUP BY pre, d),
        ch AS (SELECT pre[1:d - 1] AS pre, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
        w AS (SELECT n.pre, n.d, c, k, e, coalesce(ch.n, 0) AS children, CASE WHEN n.d = 0 THEN 0 ELSE (k - 1) * length(n.pre[n.d].text) END AS saved FROM n LEFT JOIN ch USING (pre, d)),
        sub AS (SELECT pre[1:i] AS pre, i AS d, count(*) FILTER (WHERE children = 0) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM w) GROUP BY ALL)
        SELECT w.c AS conv_id, w.d AS depth, up.c AS parent_conv_id, w.k AS n_convs, w.children AS n_children, leaves AS n_leaves, sub.saved::BIGINT AS saved_tokens, w.e AS ends_sha256
        FROM w JOIN sub USING (pre, d) LEFT JOIN n AS up ON w.d > 0 AND up.pre = w.pre[1:w.d - 1] AND up.d = w.d - 1""",
}


def oracle_sql() -> dict:
    return ORACLE
