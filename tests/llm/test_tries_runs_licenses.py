"""Prefix tries, license scans and periodic runs against plain restatements."""

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from test_contracts import AWKWARD

from pyspark.sql import functions as F

from lectern.llm import bloom, components, langid, license_scan, periodic_runs, prefix_trie, queries, simhash, url_filter

SF = "/root/testdata/sf0.001"
NODE = ["parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
RUN = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def nodes(df):
    got = df.collect()
    out = {(r["conv_id"], r["depth"]): tuple(r[c] for c in NODE) for r in got}
    assert len(out) == len(got)
    return out


def branched(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return prefix_trie.trie(*prefix_trie.branched(prefix_trie.turns_of(df)), **options)


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op11_prefix_trie(spark, SF)) == brute.op11(brute.rebuilt(rows))


def test_trie_of_awkward_rows(spark):
    r = random.Random(4)
    rows = [(None, 1, "user", "nobody's"), (None, None, None, None), (5, None, None, None), (5, None, "user", "second of the nulls"), (5, 1, None, ""), (5, 1, None, ""), (-7, 2, "user", "negative"), (-107, 0, "é", "ß😀" * 9)]
    rows += [(c, t, r.choice(["user", "assistant"]), f"say {r.randint(0, 1)}" if t else "hello") for c in [*range(0, 12), *range(200, 206), 1301, 1302] for t in range(r.randint(1, 9))]
    rows += [(300 + k, t, "user", "x" * 300_000 if t == 3 and k < 4 else f"same {t}") for k in range(7) for t in range(11)]
    rows += [(400, 0, "user", "base of few turns")] + [(c, 0, "user", "gone, since the first turns are the base's") for c in range(401, 412)]
    rows += [(c, t, "user", f"twin {t}") for c in (500, 600) for t in range(40)] + [(700, t, "user", f"twin {t}") for t in range(23)]
    r.shuffle(rows)
    want = brute.op11(brute.rebuilt(rows))
    assert nodes(branched(spark, rows)) == want
    assert nodes(branched(spark, rows, first=2, most=8)) == want  # many rounds
    assert branched(spark, []).count() == 0
    assert branched(spark, [(None, 1, "user", "x")]).count() == 0
    assert nodes(branched(spark, [(9, 1, "user", "alone")])) == brute.op11(brute.rebuilt([(9, 1, "user", "alone")]))


def test_trie_reads_named_columns_among_clashing_ones(spark):
    rows = [(c, 9 - t, "u", f"{t}{c % 2 if t > 1 else ''}") for c in range(6) for t in range(4)]
    df = spark.createDataFrame([(*x, "c", 1, 2, "d", 3, 4) for x in rows], "thread long, at long, who string, body string, c string, a long, b long, d string, part int, length long")
    paths = prefix_trie.paths_of(prefix_trie.turns_of(df, "thread", "at", "who", "body"))
    plain = {c: [("u", t) for _, t in sorted((at, t) for c2, at, _, t in rows if c2 == c)] for c in range(6)}
    assert nodes(prefix_trie.trie(*paths)) == brute.op11(plain)


def test_a_conversation_over_many_partitions_is_numbered_whole(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = [(1, t, "user", f"{t}") for t in range(3000)] + [(c, 0, "user", "x") for c in (0, 2, 3)]
        turns = prefix_trie.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        got = turns.collect()
        assert sorted(r["at"] for r in got if r["c"] == 1) == list(range(3000))
        assert {r["at"]: r["a"] for r in got if r["c"] == 1} == {t: brute.digests("user", f"{t}")[0] for t in range(3000)}
        assert all(r["at"] == 0 for r in got if r["c"] != 1)
    finally:
        for key, value in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"), before):
            spark.conf.set(key, value)


def test_half_of_all_conversations_are_one(spark):
    """A hot class is counted before it is shuffled, and its ends are hashed in blocks."""
    rows = [(c, t, "user", f"copy {t}") for c in range(1000, 1600) for t in range(3)] + [(c, t, "user", f"own {c} {t}") for c in range(3000, 3600) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.turns_of(df)
    plain = {c: [(r, x) for c2, t, r, x in rows if c2 == c] for c in {x[0] for x in rows}}
    assert nodes(prefix_trie.trie(*prefix_trie.paths_of(turns))) == brute.op11(plain)
    ends = spark.createDataFrame([(1, 2, c) for c in range(9, 2000)] + [(1, 3, 5), (4, 2, 6)], "owner long, d long, c long")
    got = {(r["owner"], r["d"]): r["ends_sha256"] for r in prefix_trie._ends_digests(ends, block=7).collect()}
    assert got == {(1, 2): brute.sha(",".join(map(str, range(9, 2000)))), (1, 3): brute.sha("5"), (4, 2): brute.sha("6")}


# runs -------------------------------------------------------------------------------------------


def by_row(df, columns):
    return Counter(repr((r["doc_id"], *(r[c] for c in columns))) for r in df.collect())


def test_runs_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = [(d, t) for d, t in docs if len((t or "").split()) < 4000]  # the plain restatement takes every distance
    out = by_row(queries.op13_periodic_runs(spark, SF).filter(f"doc_id in ({','.join(str(d) for d, _ in short)})"), RUN)
    assert out == Counter(repr((d, *brute.op13(d, t))) for d, t in short)
    assert len(short) > 0.9 * len(docs)


def test_runs_of_awkward_rows(spark):
    fib = ["a", "b"]
    for _ in range(7):
        fib.append(fib[-1] + " " + fib[-2])
    data = [(i, t) for i, t in AWKWARD if i not in (11, 12)] + [(None, "a b " * 9), (None, None), (30, fib[-1]), (31, "x " * 11), (32, "x " * 12), (33, "a b c d e f g " * 2), (34, "a b c d e f g " * 2 + "a"), (35, "    " * 8), (36, "p q r s t u v w " * 3 + "p q r s t x " + "p q r s t u v w " * 3), (37, "é\u0085è " * 30)]
    data += [(9, data[4][1]), (9, data[4][1])] + [(k, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 6) for k in range(40, 80)]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in data], "doc_id long, text string, n_runs string, start long")
    assert by_row(periodic_runs.find(df, loop=periodic_runs.loop_tail), RUN) == Counter(repr((d, *brute.op13(d, t))) for d, t in data)
    assert by_row(periodic_runs.find(df), RUN) == Counter(repr((d, *brute.op13(d, t, looped=False))) for d, t in data)
    assert periodic_runs.find(df.limit(0)).count() == 0


def test_runs_of_random_words():
    r = random.Random(1)
    for case in range(1500):
        n, words = r.randint(0, 90), []
        if case % 3 == 0:
            words = [r.randint(0, r.choice([0, 1, 2, 3])) for _ in range(n)]
        while len(words) < n:
            words += [r.randint(0, 5) for _ in range(r.randint(1, 12))] * r.randint(1, 6) + [r.randint(0, 9)] * r.randint(0, 1)
        w = np.array(words[:n], np.int32)
        got = [(a + s, m, q) for a, b in periodic_runs.parts_of(w, np.zeros(len(w), np.int64), 12) for s, m, q in periodic_runs.runs_of_part(w[a:b])]
        assert got == brute.runs(words[:n])


def test_long_texts_are_cut_between_words_and_large_sets_stay_ordered(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE", 7)
    text = ("alpha  be\n" * 9 + "gammadeltaepsilon ").encode()
    known = periodic_runs.Numbers()
    assert [list(known)[i] for i in periodic_runs.numbered(text, known)] == text.split()
    r = random.Random(2)
    some = r.sample(range(100_000), 6000)
    places, plain = periodic_runs.Places(sorted(some[:600])), sorted(some[:600])
    for x in some[600:]:
        below, above = [y for y in (max((y for y in plain[-1:] if y < x), default=-1),)], None
        i = int(np.searchsorted(plain, x))
        below, above = plain[i - 1] if i else -1, plain[i] if i < len(plain) else 1 << 62
        assert places.insert(x) == (below, above)
        plain.insert(i, x)
    assert list(places) == plain and len(places) == len(plain)
    assert periodic_runs.runs_of_part(np.zeros(30_000, np.int32)) == [(0, 30_000, 1)]
    assert periodic_runs.runs_of_part(np.tile(np.arange(3000, dtype=np.int32), 5)[:14_000]) == [(0, 14_000, 3000)]


def test_collapsed_text_and_runs_come_along(spark):
    df = spark.createDataFrame([(1, "say it " + "again and " * 8 + "stop")], "doc_id long, text string")
    row = periodic_runs.find(df, with_runs=True).first()
    assert row["collapsed"] == "say it again and stop"
    assert [tuple(x) for x in row["runs"]] == [(2, 16, 2)]


# licenses ---------------------------------------------------------------------------------------

BASE = ["n_words", "n_base", "first_word", "last_word", "base_labels"]


def test_license_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    out = queries.op12_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: tuple(r[c] for c in BASE) for r in out} == {d: brute.op12_base(t, license_scan.PHRASES) for d, t in docs}
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "GNU General Public License": "gpl", "Apache License": "apache"}
    texts = dict(docs)
    for r in out:  # lines of licenses are found, and texts without one are left alone
        want = {label for line, label in lines.items() if line in (texts[r["doc_id"]] or "")} | set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == want
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) == (r["n_base"] > 0)


def test_license_scan_of_awkward_rows(spark):
    full = dict(license_scan.TEMPLATES[:12])
    some = full["mit"].split()
    near = " ".join("thing" if i % 40 == 20 else w for i, w in enumerate(some))
    data = AWKWARD + [(None, "MIT license"), (20, full["mit"]), (21, near), (22, " ".join(some[: len(some) // 2])), (23, "mit " * 5 + "license mit license, MIT  License cc-by"), (24, full["bsd-3-clause"] + " " + full["zlib"]), (25, full["bsd-2-clause"]),
                      (26, ("gnu general public license " * 3 + "apache license cc by ") * 40), (27, full["lgpl"]), (28, full["gpl"].replace("version 3", "version 2")), (29, full["agpl"]), (30, "x y z " * 500 + full["isc"]), (31, "the software is provided as is"), (31, "the software is provided as is")]
    df = spark.createDataFrame([(d, t, "l", 1.0) for d, t in data], "doc_id long, text string, labels string, score double")
    got = license_scan.scan(df).collect()
    assert Counter(repr((r["doc_id"], *(r[c] for c in BASE))) for r in got) == Counter(repr((d, *brute.op12_base(t, license_scan.PHRASES))) for d, t in data)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert {d: labels[d] for d in range(20, 32)} == {20: "mit", 21: "mit", 22: "", 23: "cc-by,mit", 24: "bsd-3-clause,zlib", 25: "bsd-2-clause", 26: "apache,cc-by,gpl", 27: "lgpl", 28: "gpl", 29: "agpl", 30: "isc", 31: ""}
    span = next(r for r in got if r["doc_id"] == 30)["spans"]
    assert [(s["start"], s["end"], s["label"], s["share"]) for s in span] == [(1500, 1500 + len(re.findall(brute.SPLIT12, brute.low(full["isc"]))), "isc", 1.0)]
    assert all(r["score"] == 0 and r["labels"] == "" for r in got if r["doc_id"] in (1, 2, 3))
    assert license_scan.scan(df.limit(0)).count() == 0
    assert all(r["labels"] == "" for r in license_scan.scan(df, templates=[], phrases=[]).collect())


@pytest.mark.parametrize("seed", range(4))
def test_matches_equal_a_plain_search(seed):
    r = random.Random(seed)
    word = lambda n: [f"w{r.randint(0, n)}" for _ in range(r.randint(1, 14))]
    templates = [(f"t{k}", " ".join(word(5))) for k in range(5)]
    phrases = [("w1 w2", "p"), ("w3", "q"), ("w0 w1 w2", "p")]
    known = license_scan.Templates(templates, phrases, match=2)
    plain = [(t.split(), True) for _, t in templates] + [(p.split(), False) for p, _ in phrases]
    for _ in range(60):
        words = [f"w{r.randint(0, 6)}" for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            words += r.choice(templates)[1].split()[r.randint(0, 3) :]
        numbers = [known.number.get(w.encode(), len(known.number)) for w in words]
        matches, places = [], []
        known.walk(numbers, 0, matches, places)
        assert {(m.template, m.start, m.end, m.at) for m in matches} == brute.op12_matches(words, plain, 2)
        assert Counter(places) == Counter((i, k) for k, (p, _) in enumerate(phrases) for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        for covered, k, a, b in known.chains(matches):
            assert 0 < covered <= known.sizes[k] and 0 <= a < b <= len(words)


def test_chains_join_parts_that_stand_in_order():
    known = license_scan.Templates([("a", "one two three four five six seven eight nine ten"), ("b", "alpha beta gamma delta")], [])
    spans = lambda text: known.spans(_matches(known, text.split()))[0]
    assert spans("x one two three four five y six seven eight nine ten") == [(1, 12, "a", 1.0)]
    assert spans("six seven eight nine ten one two three four five") == []  # in the wrong order
    assert spans("one two three four five " + "y " * 30 + "six seven eight nine ten") == []  # too far apart
    assert spans("one two three four five six seven eight") == [(0, 8, "a", 0.8)]
    assert spans("alpha beta gamma delta alpha beta gamma delta") == [(0, 4, "b", 1.0), (4, 8, "b", 1.0)]


def _matches(known, words):
    matches, places = [], []
    known.walk([known.number.get(w.encode(), len(known.number)) for w in words], 0, matches, places)
    return matches


# hot keys of earlier operators ------------------------------------------------------------------


def test_cells_of_the_last_level_are_bounded():
    assert 2 ** simhash.uncovered(simhash.RADIUS, simhash.LEVELS) <= 512
    assert 2 ** simhash.uncovered(simhash.RADIUS, simhash.LEVELS - 1) <= simhash.CELL


def _largest_tasks(spark, df):
    """Rows of the largest and of all tasks behind the last shuffle."""
    counts = df.select(F.spark_partition_id().alias("p"), F.xxhash64("*").alias("all")).groupBy("p").agg(F.count("*").alias("count"), F.bit_xor("all")).collect()
    return max(r["count"] for r in counts), sum(r["count"] for r in counts)


@pytest.fixture
def splitting(spark):
    options = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hub_with_half_of_all_edges_is_split(spark, splitting, monkeypatch):
    """A star of 60,000 edges beside as many pairs: the joins of a round deal the hub's edges over several tasks."""
    some = lambda: spark.range(0, 60_000, 1, 16)
    edges = some().selectExpr("id + 1 as u", "0L as v").union(some().selectExpr("1000000 + 2 * id as u", "1000001 + 2 * id as v"))
    seen = []
    plain = components.materialize

    def watched(df, name):
        if name in ("large-star", "edges"):
            joined = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
            seen.append((name, bool(joined)))
        return plain(df, name)

    monkeypatch.setattr(components, "materialize", watched)
    out = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert all(out[k] == 0 for k in range(1, 60_001)) and all(out[1000001 + 2 * k] == 1000000 + 2 * k for k in range(60_000))
    assert ("large-star", True) in seen
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = plain(both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), "test-least")
    most, total = _largest_tasks(spark, both.join(low, F.col("u") == F.col("n")))
    assert total == 240_000 and most < 30_000


def test_components_of_awkward_edges(spark):
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    edges = spark.createDataFrame([(1, None), (None, 2), (None, None), (5, 4), (4, 5), (5, 4), (7, 7), (9, 5), (20, 21)], "u long, v long")
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == {5: 4, 9: 4, 21: 20}


def test_filters_of_awkward_hashes(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 6), (5, None)], "id long, h long")
    bits = bloom.bits_for(rows.count())
    told = bloom.probe(rows, F.col("h"), bloom.repeated_filter(rows, F.col("h"), bits), bits, "_maybe")
    assert {r["id"]: r["_maybe"] for r in told.collect()} == {1: False, 2: True, 3: True, 4: False, 5: False}
    nobody = bloom.member_filter(rows.limit(0), F.col("h"), bits)
    assert not any(r["_maybe"] for r in bloom.probe(rows, F.col("h"), nobody, bits, "_maybe").collect())


def test_hosts_of_very_many_labels_cost_no_more(spark):
    import time

    host = "a." * 150_000 + "example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, "http://" + "a." * 150_000 + "org/"), (3, "http://com./x"), (4, "http://example.com./en/")], "page_id long, url string")
    url_filter.judge(pages.filter("page_id = 3"), queries.URL_RULES).collect()
    began = time.process_time()
    out = {r["page_id"]: r["rule"] for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert out == {1: "example.com/en/", 2: None, 3: None, 4: None} and time.process_time() - began < 5
    name, lengths = url_filter.build(spark, queries.URL_RULES)
    digests = url_filter.Digests(url_filter.SparkFiles.get(name))
    began = time.process_time()
    assert digests.match([host], ["/en/x"], lengths) == [("example.com/en/", "block")]
    assert time.process_time() - began < 0.5


# long texts of languages ------------------------------------------------------------------------


def _model(n, r):
    table = np.zeros((langid._SCRIPT_AT + len(langid.SCRIPTS), n), np.float32)
    table[: langid._SCRIPT_AT] = r.poisson(0.3, (langid._SCRIPT_AT, n))
    table[langid._SCRIPT_AT :] = 100
    return {"langs": [f"l{i:03d}" for i in range(n)], "table": table}


def test_long_texts_are_decoded_in_parts_with_equal_paths():
    r = np.random.RandomState(6)
    scores = langid._Scores(_model(5, r))
    words = ["".join(map(chr, r.randint(97, 103, r.randint(1, 5)))) for _ in range(300)]
    for penalty in (0.3, 2.0, 4.0):
        text = " ".join(words[i] for i in r.randint(0, 300, 4000)) + " é² x"
        own = langid.found_words(text)
        scores.prepare([own])
        want = langid.viterbi([scores.of(own)], scores.rows, penalty)[0]
        for size in (37, 500, 10**6):
            assert langid.long_path(text, scores, penalty, size).tolist() == want.tolist()
    assert len(langid.long_path(" 12 ... ", scores, 4.0, 3)) == 0
    assert "".join("ab cd²ef 9"[a:b] for a, b in langid.parts_of("ab cd²ef 9", 1)) == "ab cd²ef 9"


def test_memory_of_a_long_text_with_many_languages_is_bounded():
    """400,000 words, all different, in 100 languages: words times languages would be 160 MB of scores alone, and a table of jumps."""
    import tracemalloc

    scores = langid._Scores(_model(100, np.random.RandomState(1)))
    text = " ".join("".join(chr(97 + int(c)) for c in str(i)) for i in range(400_000))
    tracemalloc.start()
    path = langid.long_path(text, scores, 4.0, langid.TOGETHER // 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(path) == 400_000 and peak < 200e6


@pytest.mark.parametrize("long", [10**9, 50])
def test_labels_of_awkward_rows_equal_the_restatement(spark, monkeypatch, long):
    """Values, ties and null ids included; with texts in parts of 50 characters too."""
    texts = [(i, t, "xx" if i % 3 else "yy") for i, t in AWKWARD if i not in (11, 12)] + [(100 + i, f"der die das und nicht {i} mit" if i % 2 else f"the and of with {i} not", "de" if i % 2 else "en") for i in range(40)]
    texts += [(200, "der the", "de"), (201, "the der", None), (202, "qqq", None)]
    monkeypatch.setattr(langid, "TOGETHER", 4 * long if long < 10**9 else langid.TOGETHER)
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    want = brute.op5([(d, t) for d, t, _ in texts], {d: lang for d, _, lang in texts})
    for r in langid.identify(df).collect():
        assert (r["lang_pred"], pytest.approx(r["score"], abs=1e-6)) == want[r["doc_id"]], r["doc_id"]
        assert r["held_out"] == (brute.crc_remainder(r["doc_id"], 5) == 0)
