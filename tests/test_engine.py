"""The engine's queries against DuckDB, and its parts against values worked out by hand."""

import json
import random
import re
import subprocess
import sys
from difflib import SequenceMatcher

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__
from lectern.functions import constants as C
from lectern.functions import exprs as E
from lectern.functions import similarity as S
from lectern.functions import textclean as T
from lectern.operators import core, facts, lookup, profile
from lectern.plans import queries as plans
from lectern.sources import readers, sinks
from lectern.streaming import lookup_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_other_queries_run(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_python_travels_by_value():
    """Workers of a cluster have no copy of the package: nothing pickled may refer to it by name."""
    for f in (T.clean_warnings, T.clean_long_text, T.collapse_blocks, T.UNITS, S.best_of_all):
        code = "import pickle, sys; pickle.loads(sys.stdin.buffer.read())"
        subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(f), cwd="/", env={"PATH": ""}, check=True)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr("x")).first()[0]


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        (E.normalize_text, "amoxicillin 2.5 ml oral susp", "amoxicillin"), (E.normalize_text, "5-fluorouracil", "-fluorouracil"), (E.normalize_text, "vitamin b-12", "vitamin b-"),
        (E.normalize_text, "vitamin b12", "vitamin b12"), (E.normalize_text, "TYLENOL, Panadol Extra", "tylenol panadol extra"), (E.normalize_text, "Oral", ""), (E.normalize_text, None, ""),
        (E.normalize_route, "respiratory (inhalation)", "Respiratory (inhalation)"), (E.normalize_route_service, "respiratory (inhalation)", "Respiratory (Inhalation)"), (E.normalize_route, "oral|ORAL; iv", "Oral, IV"),
        (E.trim_brand_names, ",".join(f"b{i}" for i in range(25)), ", ".join(f"b{i}" for i in range(20)) + ", ... (+5 more)"), (E.trim_brand_names, None, ""),
        (E.frequency_bucket, "Very  common", "common"), (E.frequency_bucket, "0.5%", "less_common"), (E.frequency_bucket, "0.05%", "rare"), (E.frequency_bucket, "1% to 5%", "unknown"), (E.frequency_bucket, None, "unknown"),
        (E.clean_generic, " (x) 5% 0xygen ", "oxygen"), (E.clean_generic, "10% Dextrose; water", "dextrose water"), (E.short_brand_key, "TYLENOL, Panadol Extra Forte", "tylenol panadol extra"),
        (E.fix_truncations, "cetaminophen Â â€¦ it’s", "acetaminophen ... it’s"), (E.clean_side_effects_text, "Rash.| rash ,Fever;", "Rash, Fever"), (E.dupe_key, " A-b  C.", "ab c"), (E.dupe_key, None, ""),
    ],
)
def test_scalars(spark, f, x, want):
    assert one(spark, f, x) == want


def test_repeated_windows(spark):
    block = " ".join(f"w{i}" for i in range(18))
    for text, want in ((f"{block} {block}", False), (f"{block} {block} x", True), ("short", False), (None, False)):
        assert one(spark, E.repeated_window, text) is want
        assert T.has_repeated_window(text) is want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "A", " b", "", "c c", "C C"]), max_size=8))
def test_array_kernel(spark, items):
    want, seen = [], set()
    for p in (i.strip() for i in items):
        if p and p.lower() not in seen:
            seen.add(p.lower())
            want.append(p)
    assert one(spark, lambda c: E.limit_csv_list(c, 3), ",".join(items)) == ", ".join(want[:3])


def test_cleaners():
    sentence = "Take one tablet by mouth every day with a full glass of water. "
    assert T.clean_long_text(sentence * 8) == sentence.strip()
    assert T.clean_warnings("Do not use with any other medicine here. Do not use with any other medicine here.") == "Do not use:\nwith any other medicine here"
    assert T.alike("Same text here", "same  text, here") and not T.alike("", "")
    assert T.coverage("x" * 30, "x" * 90) == 0.0
    assert T.alike("abcd", "abce", 0.75) and not T.alike("abcd", "abce", 0.76)  # three of four characters on both sides
    words = " ".join(f"{c}{c}{c}{c}{c}" for c in "abcdefghijkl")  # 71 characters
    assert T.coverage(words, f"{words} and more") == 1.0 and T.coverage(words, words.replace("a", "z")) == pytest.approx(66 / 71)
    assert T.merge_sections("A:\nthis body is told twice in the text\n\nB:\nthis body is told twice in the text!!") == "B:\nthis body is told twice in the text!!"
    long = "Warnings:\n" + "word " * 300
    assert len(T.cap_sections(long)) <= 1200 and T.cap_sections(long).endswith("…")
    for f in (T.clean_long_text, T.clean_warnings, T.clean_openfda_blocks, T.collapse_blocks):
        assert f("") == "" and f(None) == ""
    blocks = "INDICATIONS: short. WARNINGS: be careful with this. INDICATIONS: the longer text wins."
    assert T.dedupe_heading_blocks(blocks, ["INDICATIONS", "WARNINGS"]) == "WARNINGS: be careful with this.\n\nINDICATIONS: the longer text wins."


P = "Acetaminophen tablets relieve minor aches and pains and lower fever when they are taken as told on the label"  # 107 characters
BODY = "This medicine may cause drowsiness and should be kept away from small children at all times of the day"
W18 = " ".join(f"w{i}" for i in range(18))


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        # The beginning, found again without punctuation, from 350 characters on and before three quarters of the text
        (T.cut_repeated_prefix, f"{P} {P} " + "y" * 200 + " z" * 100, f"{P} {P} " + "y" * 200 + " z" * 100),
        (T.cut_repeated_prefix, " ".join([f"{P} and so on"] * 4), f"{P} and so on {P} and so on"),  # looked for from 120 on: the second copy begins before
        (T.cut_repeated_prefix, f"{P} {P}", f"{P} {P}"),
        # T5: cut where the first window comes for the second time, if 180 characters are left
        (T.cut_at_repeated_window, f"{BODY} {P} {W18}. {BODY} {W18} end of it", f"{BODY} {P} {W18}"),
        (T.cut_at_repeated_window, f"{BODY} {W18}. {BODY} {W18} end of it", f"{BODY} {W18}. {BODY} {W18} end of it"),
        (T.cut_at_repeated_window, f"{W18} {W18} x", f"{W18} {W18} x"),
        # Later windows go, punctuation stays with its word, leading punctuation is lost
        (T.drop_repeated_windows, f"(start {W18}, mid ; {W18} end .", f"start {W18}, mid; end."),
        (T.drop_repeated_windows, "a b c", "a b c"),
        # A headline that a kept headline says too; other units stay, even if told twice
        (T.dedupe_headlines, "WARNING: keep away from fire Warning: keep away from fire! Boxed warning other words", "WARNING: keep away from fire\nBoxed warning other words"),
        (T.dedupe_headlines, "told twice\ntold twice", "told twice\ntold twice"),
        # Starter phrases need no word boundary before them; equal units go
        (T.dedupe_units, "Take one. For external use only. Take one. For external use only.", "Take one.\nFor external use only. Take one.\nFor external use only."),
        (T.dedupe_units, "Forewarning of it\n• Forewarning of it", "Fore\nwarning of it"),
        (T.dedupe_units, "• only one", "• only one"),
        # Breaks at Directions and numbers; short pieces go; equal and covered sentences go
        (T.dedupe_sentences, "Take it with water every day. Ok. Take it with water, every day! Directions take it with water now", "Take it with water every day. take it with water now"),
        (T.dedupe_sentences, f"{BODY}. Note that {BODY.lower()} or so.", f"{BODY}."),
        # List order shadows the longer heading; text before the first goes; the longest block stays
        (lambda t: T.dedupe_heading_blocks(t, ["INDICATIONS", "INDICATIONS AND USAGE"]), "intro. INDICATIONS AND USAGE for pain", "INDICATIONS AND USAGE for pain"),
        (lambda t: T.dedupe_heading_blocks(t, ["DOSE", "USE"], True), "Use one. 1.2 dose two. USE the longer one", "1.2 dose two.\n\nUSE the longer one"),
        # Blocks told twice, halves that say the same
        (T.collapse_blocks, "one block here\n\nanother block\n\nOne block, here", "one block here\nanother block"),
        (T.collapse_blocks, f"{BODY} {P} {BODY} {P}", f"{BODY} {P}"),
        # Caps by title, whole lines of bullets
        (T.cap_sections, "Pregnancy:\n" + "x" * 300, "Pregnancy:\n" + "x" * 219 + "…"),
        (T.cap_sections, "Lactation:\n" + "\n".join("• " + c * 97 for c in "abc"), "Lactation:\n" + "\n".join("• " + c * 97 for c in "ab")),
        # The longer body takes the slot with its own title; a third section stays
        (T.merge_sections, f"A:\n{BODY}\n\nB:\nsomething else\n\nC:\n{BODY} indeed", f"C:\n{BODY} indeed\n\nB:\nsomething else"),
        (T.merge_sections, f"Warnings:\n{BODY[:70]}\n\nOverdosage:\n{BODY[:40]} call a doctor or a poison control center", f"Overdosage:\n{BODY[:40]} call a doctor or a poison control center"),
        # Fixed order of headings, the longest of each, without the heading
        (T.clean_openfda_blocks, "WARNINGS: first words here. CONTRAINDICATIONS: none are known. WARNINGS: these are the longer words here.", "Warnings:\nthese are the longer words here.\nContraindications:\nnone are known."),  # units are joined by single breaks
        (T.clean_openfda_blocks, "no heading  at all", "no heading at all"),
        # Sections in fixed order, hyphens go, bullets for the last one; without a section as T15
        (T.clean_warnings, "Stop use and ask a doctor if pain gets worse after a week. Do not use if the seal is broken or missing", "Do not use:\nif the seal is broken or missing\nStop use and ask a doctor if:\npain gets worse after a week"),
        (T.clean_warnings, "WARNINGS: over-the-counter drug", "Warnings:\nover the counter drug"),
        # Remarks go, sentences told twice go
        (T.clean_long_text, "Use as told ( 1.1 ) here ( 1.2 ) and there ( 1.3 ).  Click here to enter text", "Use as told here and there ."),
        (T.clean_long_text, "Use ( 1.1 ) here", "Use ( 1.1 ) here"),
    ],
)
def test_cleaners_by_hand(f, x, want):
    assert f(x) == want


def test_blocks_reach_as_difflib_says():
    """Decided without SequenceMatcher, with equal results: short and long keys, frequent characters, edges of blocks."""
    r = random.Random(1)
    words = ["".join(r.choice("eettaaoinshrdlucmfwypvbgkjqxz") for _ in range(r.randint(1, 8))) for _ in range(30)]
    for k in (1, 5, 15, 40, 60, 200) * 6:
        a = " ".join(r.choice(words) for _ in range(k))
        b = list(r.choice((a, " ".join(r.choice(words) for _ in range(2 * k)))))
        for _ in range(r.choice((0, 3, 20))):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 9)] = r.choice(words)
        b = "".join(b)
        found = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        for least in (1, found // 2, found, found + 1):
            assert S.blocks_reach(a, b, least, S.seeds_of(b)) is (found >= least)
        for ratio, cover in ((0.88, 0.55), (0.92, None), (None, 0.7)):
            by_cover = cover is not None and min(len(a), len(b)) >= C.COVERED_LEAST and T.coverage(a, b) >= cover
            assert T.same_keys(a, b, ratio, cover) is (ratio is not None and SequenceMatcher(None, a, b).ratio() >= ratio or by_cover)


def test_twins_of_long_texts_take_no_matcher(monkeypatch):
    """Neighbours that say different things are told apart by counts and subsequences: no matching blocks are looked for."""
    asked = []
    monkeypatch.setattr(T, "blocks_reach", lambda *a: asked.append(a) or S.blocks_reach(*a))
    said = [" ".join(f"{c}{d}{c}{e}" for e in "aeiou" for d in "xyz") + "." for c in "bcdfghjklmnp"]
    assert T.dedupe_sentences(" ".join(said * 2)) == " ".join(said) and not asked


def test_passes_drop_what_pairs_say(monkeypatch):
    """Units dropped by counts and subsequences with all kept keys at once are those that each pair drops, and few pairs are looked at alone."""
    r, alone = random.Random(3), []
    monkeypatch.setattr(T, "lcs", lambda *a: alone.append(1) or S.lcs(*a))
    words = ["".join(r.choice("eettaaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(200)]
    for step in (T.SENTENCES, T.UNITS, T.HEADLINES, T.LINES):
        units = []
        for k in range(120):
            unit = " ".join(r.choice(words) for _ in range(r.choice((2, 5, 15, 30)) if k % 40 else 400))
            if units and r.random() < 0.3:
                unit = r.choice(units[-12:])
                cut = r.randrange(len(unit))
                unit = unit[:cut] + r.choice(("", "é ", " of it ", unit[:30])) + unit[cut + r.choice((0, 3, 20)) :]
            units.append(r.choice(("", "", "Warning: ", "warnings ")) + unit + r.choice(("", ".", " " * 3)))
        units += ["", " . ", "é"]
        alone.clear()
        got, asked = step.left(units), len(alone)
        kept, keys = [], set()
        for u in units:
            key = T.key_of(u)
            if step.once and (not key or key in keys or step.tiny and T._is_tiny(u)):
                continue
            near = [(t, k) for t in step.twins if t.begins(u) for k in kept[-t.look :] if not t.among or t.begins(k)]
            if not any(T.same_keys(key, T.key_of(k), t.ratio, t.cover) for t, k in near):
                keys.add(key)
                kept.append(u)
        assert got == kept and len(got) < len(units)
        assert asked < 4 * len(units)
    told = [" ".join(r.choice(words) for _ in range(20)) for _ in range(60)]
    alone.clear()
    assert T.SENTENCES.left(told) == told and len(alone) < 6  # 596 pairs when each is looked at by itself


def test_bounds_of_many_keys_lose_nothing():
    """Subsequences beside each other are those of each; grams and counts are never under what blocks reach."""
    r = random.Random(4)
    line = lambda n: "".join(r.choice("etaoin shrdlu0") for _ in range(n))
    beside, told = S.Beside(), []
    for k in range(60):
        told.append(line(r.choice((0, 1, 30, 63, 64, 65, 300))))
        beside.add(told[-1])
        if k % 3 == 2:
            beside.leave(1 + k % 2)
            told = told[1 + k % 2 :]
        b = r.choice((line(80), told[-1][3:] + "z"))
        assert beside.lcs(b) == [S.lcs(a, b) for a in told]
    for _ in range(150):
        a = line(r.randint(200, 900))
        b = list(a)
        for _ in range(r.choice((0, 2, 9, 40))):
            b[(at := r.randrange(len(b))) : at + r.randint(0, 6)] = line(r.randint(0, 6))
        b = "".join(b)
        found = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert S.grams_reach(a, b, found)
        (x, over), (y, beyond) = T._marks(a), T._marks(b)
        assert (x & y).bit_count() + min(over, beyond) >= found
    assert not S.grams_reach(line(600), line(600), 560)


def test_counts_of_a_dropped_unit_are_forgotten():
    """The unit kept after a dropped one is not compared by the counts of that one."""
    near = T.Near(T.Twin(10, 0.88, 0.70))
    near.keep("", a := "x" * 40 + "y" * 40)
    assert near.drops("", a[:-1]) and not near.drops("", b := "short of it")
    near.keep("", b)
    assert near.drops("", b + "s") and T.SENTENCES(f"{BODY}. {BODY} it. qqqq 777 zzzz jjjj 9. qqqq 777 zzzz jjjj 98.") == f"{BODY}. qqqq 777 zzzz jjjj 9."


def test_words_of_any_text():
    assert T.dedupe_headlines("a Warnİng: one") == "a\nWarnİng: one"  # which re takes for an i
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice("aZ09 \n.-éİıſK\x1c\xa0\u3000漢😀_") for _ in range(60))
        assert T._low_words(text) == re.findall(r"[a-z0-9]+", text.lower())


def test_equal_columns_are_cleaned_once(spark):
    """One column function for each cleaner: Spark runs it once for the columns that share a text."""
    out = T.clean_table(spark.createDataFrame([("Use it.", "Use it.")], "t string, other string").selectExpr("t AS indications", "t AS contraindications", "t AS dosage_and_administration"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("run(t#") == 1 and tuple(out.first()) == ("Use it.",) * 3


def test_cleaner_in_parts(spark, monkeypatch):
    """A batch is worked on in parts, and only short texts are remembered."""
    texts = [f"{i} " + "word " * (i % 7) for i in range(2 * C.PART_ROWS + 3)] + [None, "x " * C.KEPT_CHARS]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", T.cleaner(T.flat)("t").alias("c")).collect()
    assert [r.c for r in sorted(got)] == [T.flat(t or "") for t in texts]
    T._KEYS.clear()
    for t in texts:
        T.key_of(t)
    assert len(T._KEYS) <= C.KEPT_TEXTS and max(map(len, T._KEYS)) <= C.KEPT_CHARS


def test_lists_hash_keys_once(spark):
    """Capped lists and paths sort nothing and normalise each item once."""
    cell = ",".join(f"w{i % 300}" for i in range(20000))
    for f, want in ((lambda c: E.clean_list(c), 80), (lambda c: E.clean_side_effects_text(c), 120), (lambda c: E.limit_csv_list(c, 250), 250)):
        assert one(spark, f, cell) == ", ".join(f"w{i}" for i in range(want))
        assert "array_sort" not in str(f("x"))
    path = E.dedupe_path(F.split("x", ">"))
    assert one(spark, lambda _: F.array_join(path, ">"), "Aspirin 500mg>aspirin>>10 mg>Zinc> ZINC") == "Aspirin 500mg>Zinc"
    assert str(path).count("btrim") <= str(E.normalize_text("x")).count("btrim")
    assert one(spark, lambda c: E.clean_list(c), " ;| .") == ";, ." and one(spark, E.trim_brand_names, "a ;A|b  c,\x1c") == "a, b c"


@pytest.mark.parametrize(
    ("x", "want"),
    [
        ("Liver Warning:\nLiver Warning This product contains acetaminophen\n:\nshort", "Liver Warning:\nThis product contains acetaminophen"), ("For pain.", ""), (None, ""), ("...\n- – •", ""),
        ("- a line that is long enough\r\n\r\n\r\n\r\nand\\nanother line of some length\ttoo", "a line that is long enough\n\nanother line of some length too"), ("Do not use:\nDO NOT USE:\nwith any other medicine here", "Do not use:\n\nwith any other medicine here"),
        ("x" * 1600, "x" * 1500 + "…"),
    ],
)
def test_display_text(spark, x, want):
    assert one(spark, E.display_text, x) == want


def test_sections(spark):
    for f in (lambda x: one(spark, lambda c: F.to_json(E.sections(c)), x), lambda x: json.dumps([dict(zip(("title", "body"), s)) for s in T.sections(x)])):
        assert json.loads(f(" A :\n one\ntwo \n\n\nplain\n\nB:\n")) == [{"title": "A", "body": "one\ntwo"}, {"title": "", "body": "plain"}, {"title": "", "body": "B:"}]
    assert one(spark, lambda c: E.join_sections(E.sections(c)), " A:\none\n\n\nplain ") == "A:\none\n\nplain" == T.joined(T.sections(" A:\none\n\n\nplain "))


def test_clean_table_skips_missing_columns(spark):
    df = spark.createDataFrame([(1, "Take it ( 1 ) a ( 2 ) b ( 3 )", "a|A; b", "oral, ORAL", "Rash.| rash", " x ")], "id int, indications string, brand_names string, route string, rare_side_effects string, other string")
    out = T.clean_table(df)
    assert out.columns == df.columns
    assert tuple(out.first()) == (1, "Take it a b", "a, b", "Oral", "Rash", " x ")


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("paracetmol", "paracetamol", 2000 / 21), ("abc", "abc", 100.0), ("", "abc", 0.0), ("ab", "axb", 80.0), ("a", "aspirin", 90.0), ("zz", "aspirin", 0.0),
        ("b a", "a b", 95.0), ("a a b", "b a", 85.5), ("a b b", "b a c", 95.0), ("calpol", "calpol six plus", 90.0), ("plus extra", "calpol six plus", 85.5), ("ab", "ab" + "x" * 18, 60.0), ("vitamin c", "vitamin d", 800 / 9),
    ],
)
def test_weighted_ratio_by_hand(a, b, want):
    assert S.weighted_ratio(a, b) == pytest.approx(want)


NAMES = st.lists(st.sampled_from(["a", "b", "ab", "aab", "para", "cetamol", "paracetamol", "ibuprofen", "xyz", "calpol", "six", "plus", "zinc", "z"]), min_size=1, max_size=4).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(NAMES | st.text("abcp ", min_size=1, max_size=9).map(lambda s: " ".join(s.split()) or "q"), min_size=1, max_size=3), st.lists(NAMES, min_size=1, max_size=12, unique=True), st.sampled_from([0.0, 45.0, 80.0]), st.integers(1, 5))
def test_best_of_all_scores_as_all_pairs(queries, keys, cutoff, limit):
    for q, best in S.best_of_all(queries, keys, cutoff, limit):
        every = sorted(((S.weighted_ratio(q, k), -i) for i, k in enumerate(keys)), reverse=True)
        assert best == [(-i, s) for s, i in every if s >= cutoff][:limit]


def test_candidates_hold_every_match(spark):
    """Against all pairs, for names of one letter up, with words in common, turned around, told twice, and with letters changed."""
    r = random.Random(4)
    parts = ["a", "b", "ab", "xy", "para", "cetamol", "ibuprofen", "profen", "calpol", "six", "plus", "zinc", "acid", "extra", "vitamin", "c", "sodium", "chloride"]
    keys = sorted({" ".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(220)} | set(parts))

    def bent(k):
        k = list(k)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(k))
            k[at : at + r.randint(0, 1)] = r.choice(["", "q", "e", ""])
            k = k or ["q"]
        return " ".join("".join(k).split()) or "q"

    queries = sorted({bent(r.choice(keys)) for _ in range(140)} | {"a", "c", "z", "q", "ab", "a a a a b", "plus plus plus", "c vitamin"})
    rows = spark.createDataFrame([(i, k, "", "") for i, k in enumerate(keys)], "row_no long, generic_name_clean string, generic_name string, brand_names string")
    store = lookup.build_store(rows)
    known = sorted(x["key"] for x in store.keys.collect())
    asked = spark.createDataFrame([(q,) for q in queries], "q string")
    want = {(q, k) for q in queries for k in known if S.weighted_ratio(q, k) >= 80}
    pairs = {tuple(x) for x in lookup.candidates(asked, store.grams).collect()}
    assert want <= pairs
    for cutoff, limit in ((80.0, 10), (45.0, 15)):
        got = {x["q"]: [(m["match"], round(m["score"], 6)) for m in x["_top"]] for x in lookup.fuzzy_top(asked, "q", store, cutoff, limit).collect()}
        for q in queries:
            best = sorted(((-S.weighted_ratio(q, k), k) for k in known if S.weighted_ratio(q, k) >= cutoff))[:limit]
            assert got.get(q, []) == [(k, round(-s, 6)) for s, k in best]


def test_candidates_are_few_among_varied_names(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choices("aeioubcdfghlmnprstvxz", k=r.randint(5, 12)))
    keys = sorted({f"{word()} {word()}" if r.random() < 0.5 else word() for _ in range(3000)})
    queries = [k[:2] + k[3:] for k in r.sample(keys, 60)]
    rows = spark.createDataFrame([(i, k, "", "") for i, k in enumerate(keys)], "row_no long, generic_name_clean string, generic_name string, brand_names string")
    pairs = [tuple(x) for x in lookup.candidates(spark.createDataFrame([(q,) for q in queries], "q string"), lookup.build_store(rows).grams).collect()]
    want = {(q, k) for q in queries for k in keys if S.weighted_ratio(q, k) >= 80}
    assert want <= set(pairs) and len(pairs) < 0.15 * len(queries) * len(keys)


@settings(max_examples=60, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_similarity(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert S.lcs(a, b) == table[-1][-1]
    assert 0 <= S.weighted_ratio(a, b) <= 100
    short, long = sorted((a, b), key=len)
    if short:
        m = len(short)
        parts = [long[max(0, e - m) : e] for e in range(1, len(long) + m)]
        assert S.partial_ratio(short, long) == pytest.approx(max(S.ratio(short, p) for p in parts))


def test_lookup_cascade(spark):
    drugs = spark.createDataFrame([(1, "acetaminophen", "Acetaminophen", "Calpol, Other"), (2, "ibuprofen", "Ibuprofen", "Nurofen"), (3, "ibuprofen lysine", "Ibuprofen", "ibuprofen")], "row_no long, generic_name_clean string, generic_name string, brand_names string")
    asked = ["paracetamol", "Panadol", "paracetamol 500mg", "zzzzzz", "Oral", "IBUPROFEN 200 mg tablet", "ibuprofin", None]
    out = {r["query"]: r for r in lookup.lookup_batch(spark.createDataFrame([(a,) for a in asked], "query string"), drugs).collect()}
    assert len(out) == len(asked)
    for q in ("paracetamol", "Panadol", "paracetamol 500mg"):
        assert (out[q]["status"], out[q]["match_type"], out[q]["normalized"], out[q]["confidence"]) == ("ok", "alias", "acetaminophen", 0.95)
    assert (out["zzzzzz"]["status"], out["zzzzzz"]["matches"], out["zzzzzz"]["best_match"]) == ("no_match", [], None)
    assert out["Oral"]["message"] == "Empty query" and out[None]["match_type"] == "none"
    assert out["IBUPROFEN 200 mg tablet"]["match_type"] == "exact" and out["IBUPROFEN 200 mg tablet"]["matches"][0]["row_no"] == 2
    assert out["ibuprofin"]["match_type"] == "fuzzy" and [m["row_no"] for m in out["ibuprofin"]["matches"]][0] == 2
    assert all(0 <= r["confidence"] <= 1 and r["status"] in ("ok", "low_confidence", "no_match") for r in out.values())
    keys = {r["key"]: r["row_no"] for r in lookup.build_keys(drugs).collect()}
    assert keys["ibuprofen"] == 2 and keys["nurofen"] == 2
    assert lookup.lookup_one(spark, "nurofen", drugs)["match_type"] == "exact"


CATALOGUE = [
    ("D1", "Acetaminophen", "acetaminophen", "Calpol, Calpol; Other", "analgesic", "oral/iv", "For pain relief of many kinds in adults.", "common: nausea"),
    ("D2", "Ibuprofen", "ibuprofen", "Nurofen Extra Strong Tablets", "nsaid", "ORAL", "short", ""), ("D2", "Ibuprofen", "ibuprofen lysine", "Nurofen Plus", "", "", "", ""),
    ("", "Ibuprofen A", "ibuprofen a", "", "", "", "", ""), ("", "Ibuprofen B", "ibuprofen b", "", "", "", "", ""), ("D7", "Zincum", "", "", "", "", "", ""), ("D8", "", "", "Lost Brand", "", "", "", ""),
]


def restated(query, rows, top_k=5, least=80.0):
    """The cascade for one query, row by row, from its description. rows: dictionaries in order."""
    norm = lambda s: re.sub(r"\s+", " ", re.sub(f"(?i){C.DOSAGE}", " ", re.sub(r"[^a-z0-9\s\-]+", " ", (s or "").lower().strip().replace("_", " ")))).strip()
    index, primary = {}, set()
    for r in rows:
        names = [k for k in (norm(r["generic_name_clean"]), norm(r["generic_name"])) if k]
        if names:
            primary |= set(names)
            for k in [*names, " ".join(norm(r["brand_names"]).split()[:3])]:
                if k:
                    index.setdefault(k, r)
    q = norm(query)
    path = [p for p in (query, q) if p is not None]
    done = lambda normalized, kind, hits, near, path, message: {
        "normalized": normalized, "match_type": kind, "matches": [(k, round(s, 6), index[k]["drug_id"], index[k]["generic_name"]) for k, s in hits], "suggestions": near, "message": message,
        "resolution_path": [p for i, p in enumerate(path) if norm(p) and norm(p) not in [norm(x) for x in path[:i]]], "best_match": hits[0][0] if hits else None, "best_score": round(hits[0][1], 2) if hits else 0.0,
        "confidence": round(hits[0][1] / 100, 4) if hits else 0.0, "status": "no_match" if not hits or hits[0][1] < 60 else "ok" if hits[0][1] >= 85 else "low_confidence",
    }
    if not q:
        return done("", "none", [], [], path, "Empty query")
    if q in index:
        return done(q, "exact", [(q, 100.0)], [], path, "OK")
    typo = ("para" in q or q.startswith("par")) and S.weighted_ratio(q, "paracetamol") >= 85
    target = C.ALIASES.get(q, "acetaminophen" if typo else None)
    if target in index:
        return done(target, "alias", [(target, 95.0)], [target, *[a for a, t in C.ALIASES.items() if t == target]][:top_k], [query, q, target], "OK")
    ranked = lambda pool, cutoff, n: sorted(((-S.weighted_ratio(q, k), i, k) for i, k in enumerate(pool) if S.weighted_ratio(q, k) >= cutoff))[:n]
    near = []
    for _, _, k in ranked([*sorted(primary), *[a for a in C.ALIASES if a not in primary]], least - 35, 15):
        name = norm(k if k in C.ALIASES else index[k]["generic_name_clean"] or index[k]["generic_name"] or k)
        near += [name] if name and name not in near else []
    hits, ids = [], set()
    for s, _, k in ranked(sorted(index), least, 10):
        if index[k]["drug_id"] not in ids or not index[k]["drug_id"]:
            ids.add(index[k]["drug_id"])
            hits.append((k, -s))
    if not hits:
        return done(q, "none", [], near[:top_k], path, "No confident match found")
    return done(index[hits[0][0]]["generic_name_clean"] or q, "exact" if hits[0][1] >= 99.9 else "fuzzy", hits[:top_k], near[:top_k], path, "OK")


FIELDS = ["normalized", "match_type", "suggestions", "message", "resolution_path", "best_match", "best_score", "confidence", "status"]


def test_lookup_equals_the_cascade_row_by_row(spark):
    names = ["drug_id", "generic_name", "generic_name_clean", "brand_names", "drug_class", "route", "indications", "common_side_effects"]
    rows = [dict(zip(names, r)) for r in CATALOGUE]
    drugs = spark.createDataFrame([(i, *r) for i, r in enumerate(CATALOGUE)], "row_no long, " + ", ".join(f"{n} string" for n in names))
    asked = ["nurofenol extra strng", "ibuprofen c", "ibuprofin", "zincu", "zincum", "calpol other", "lost brand", "paracetamol", "Panadol", "paracetmol", "zzzzzz", "Oral", "", None, "a", "b", "x ibuprofen", "acetaminofen 500 mg", "tylenols", "nurofen"]
    store = lookup.build_store(drugs)
    out = {r["query"]: r for r in lookup.lookup_batch(spark.createDataFrame([(a,) for a in asked], "query string"), store).collect()}
    for a in asked:
        want, got = restated(a, rows), out[a]
        assert {f: got[f] for f in FIELDS} == {f: want[f] for f in FIELDS}, a
        assert [(m["match"], round(m["score"], 6), m["drug_id"], m["generic_name"]) for m in got["matches"]] == want["matches"], a
    assert out["nurofenol extra strng"]["normalized"] == "ibuprofen" and out["nurofenol extra strng"]["best_match"] == "nurofen extra strong"
    assert [m["drug_id"] for m in out["ibuprofen c"]["matches"]].count("") == 2  # blank ids are never one drug
    shown = out["Panadol"]["matches"][0].asDict()
    assert (shown["brand_names"], shown["route"], shown["indications"], shown["drug_class"], shown["side_effects_buckets"]) == ("Calpol, Other", "Oral, IV", "For pain relief of many kinds in adults.", "analgesic", {"common": "common: nausea"})
    told = json.loads(lookup.lookup_json(spark, "zzzzzz", store))
    assert (told["status"], told["matches"], told.get("best_match")) == ("no_match", [], None)
    with pytest.raises(ValueError):
        lookup.lookup_json(spark, "", store)
    exact = lookup.lookup_one(spark, "Ibuprofen", store)["matches"][0]
    assert (exact["indications"], exact["side_effects_buckets"]) == ("", None)


def test_lookup_query_equals_the_cascade(spark):
    t = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    rows = [{"drug_id": "", **r.asDict()} for r in plans._drugs(t).orderBy("row_no").collect()]
    for r in lookup.lookup_batch(plans._asked(t).distinct(), plans._drugs(t)).collect():
        want = restated(r["query"], rows)
        assert {f: r[f] for f in FIELDS} == {f: want[f] for f in FIELDS}, r["query"]


def test_store_is_made_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "_STORES", {})
    with pytest.raises(FileNotFoundError):
        lookup.init_store(spark, str(tmp_path / "none.csv"))
    (tmp_path / "bad.csv").write_text("drug_id,generic_name\n1,x\n")
    with pytest.raises(ValueError, match="generic_name_clean"):
        lookup.init_store(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "a.csv").write_text("drug_id, generic_name ,generic_name_clean\nD1,Alpha,alpha\nD2,Alpha,alpha\n")
    monkeypatch.setenv("DRUG_DATASET_PATH", str(tmp_path / "a.csv"))
    store = lookup.init_store(spark)
    (tmp_path / "a.csv").unlink()
    assert lookup.init_store(spark, str(tmp_path / "none.csv")) is store
    assert lookup.lookup_one(spark, "ALPHA 5 mg")["matches"][0]["drug_id"] == "D1"


def test_core_table_keys_every_tied_row_in_one_order(spark):
    raw = [("alpha", "ORAL", "C", f"use {k:02d}") for k in range(30)] + [("beta", "ORAL", "C", "x")]
    want = [(f"DRUG_{k + 1:06d}", *raw[k][::3]) for k in range(31)]
    for rows in (raw, raw[::-1], raw[7:] + raw[:7]):
        out = core.core_table(spark.createDataFrame(rows, "generic_name string, route string, drug_class string, indications string"), "2026-01-01")
        assert sorted((r["drug_id"], r["generic_name_clean"], r["indications"]) for r in out.collect()) == want


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_surrogate_keys_lose_and_repeat_nothing(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 200_000
        rows = spark.range(n).select((F.col("id") % 977).alias("a"), F.col("id"), F.repeat(F.lit("wide "), 40).alias("payload"), F.lit(None).cast("string").alias("_part"))
        hot = rows.withColumn("a", F.when(F.col("a") % 3 == 0, 0).otherwise(F.col("a")))
        for df in (rows, hot):
            out = core.surrogate_keys(df, ["a"], pattern="%d", ties=["id"])
            assert out.columns == [*df.columns, "drug_id"]
            key = F.col("drug_id").cast("long")
            assert tuple(out.agg(F.count("*"), F.count_distinct("drug_id"), F.min(key), F.max(key), F.count_distinct("id")).first()) == (n, n, 1, n, n)
            place = out.select("a", "id", key.alias("k")).orderBy("k").toPandas()
            assert place[["a", "id"]].equals(place.sort_values(["a", "id"])[["a", "id"]])
        nulls = spark.createDataFrame([(None, 1), ("b", 2), (None, 3), ("a", 4)], "a string, id int")
        assert {r["id"]: r["drug_id"] for r in core.surrogate_keys(nulls, ["a"], pattern="%d", ties=["id"]).collect()} == {1: "1", 3: "2", 4: "3", 2: "4"}
        assert core.surrogate_keys(nulls.limit(0), ["a"]).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_lenient_int_is_total(spark):
    cells = {"NaN": 0, "1000000000000": 10**12, "-2.9": -2, "Infinity": 0, "1e300": 0, "": 0, "x": 0, None: 0, " 7 ": 7}
    out = spark.createDataFrame([(c,) for c in cells], "x string").select("x", E.lenient_int("x").alias("n")).collect()
    assert {r["x"]: r["n"] for r in out} == cells


def test_core_table_and_mart(spark):
    raw = spark.createDataFrame([("Zeta", "ORAL", "C", "fine"), ("alpha", "oral, x", "C", "ok"), ("herbal tea", "ORAL", "C", "x"), ("beta", "dental", "C", "x"), ("gamma", "NASAL", None, "x")], "generic_name string, route string, drug_class string, indications string")
    out = core.core_table(raw, "2026-01-01").orderBy("drug_id").collect()
    assert [(r["drug_id"], r["generic_name_clean"]) for r in out] == [("DRUG_000001", "alpha"), ("DRUG_000002", "zeta")]
    assert core.core_table(raw, "2026-01-01", strict=False).count() == 3
    names = spark.createDataFrame([("1", "old", 1), ("1", "new", 2), ("2", "", 3)], "id string, name string, line long")
    assert {r["id"]: r["name"] for r in facts.last_wins(names, "id", "name", "line").collect()}["1"] == "new"
    effects = spark.createDataFrame([("Alpha", "Rash", "PT"), ("alpha", "rash", "LLT"), ("omega", "x", "PT")], "generic_name_clean string, side_effect string, term_type string")
    effects = effects.withColumn("generic_name_clean", E.clean_generic("generic_name_clean"))
    se = facts.side_effect_facts(effects, effects, spark.createDataFrame([("ALPHA",)], "generic_name_clean string"))
    assert se.count() == 4 and facts.label_terms(se).count() == 1


def test_profiles(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (1, "a", "x"), (2, None, "Do not use: a do not use: b")], "k int, s string, t string")
    report = profile.report(df, ["k", "s"], ["s", "t"])
    assert report["duplicates"]["duplicates"] == 1 and report["row_count"] == 3 and report["types"]["k"] == "int"
    sinks.write_json_report(report, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["column_count"] == 3
    bad = profile.offenders(df, "k", ["s", "t"])
    assert [(r["column_name"], r["check_name"]) for r in bad.collect()] == [("t", "label_repeats")]
    sinks.write_offenders(bad, str(tmp_path / "bad"))
    assert (tmp_path / "bad/column_name=t/check_name=label_repeats").is_dir()
    assert sinks.coverage_metrics(df, ["s", "t"]).first()["s_filled"] == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id, name ,note\n1,"x\ny",NA\n2,,"q""q"\n3,\xff,ok\n')
    keep = readers.read_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert keep[0]["name"] == "x\ny" and keep[0]["note"] == "NA" and keep[1]["name"] == "" and keep[1]["note"] == 'q"q' and keep[2]["name"] == "�"
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), na="null").orderBy("id").first()["note"] is None
    (tmp_path / "b.tsv").write_text("1\ta\tb\tc\tcommon\tz\n")
    assert readers.read_tsv(spark, str(tmp_path / "b.tsv"), ["id", "n"]).first()["n"] == "a"
    assert tuple(readers.first_and_last(readers.read_tsv_any(spark, str(tmp_path / "b.tsv"), 6), 4, ("freq", "term")).first()) == ("common", "z")
    with pytest.raises(ValueError, match="columns expected"):
        readers.read_tsv_any(spark, str(tmp_path / "b.tsv"), 7)
    (tmp_path / "c.xml").write_text('<drugbank xmlns="http://www.drugbank.ca"><drug><name> Abc </name><classification><direct-parent> P </direct-parent></classification><products><drug><name>in</name></drug></products></drug><drug><name>abc</name></drug><drug><x/></drug></drugbank>')
    assert [tuple(r) for r in readers.read_class_xml(spark, str(tmp_path / "c.xml")).collect()] == [("abc", "P")]
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "t.csv").write_text("a,b,c,d\n1,1.5,x,9\nNA,bad,,9\n")
    typed = readers.read_typed(spark, str(tmp_path / "t.csv"), "b double, a int, c string")
    assert typed.dtypes == [("b", "double"), ("a", "int"), ("c", "string")] and [tuple(r) for r in typed.collect()] == [(1.5, 1, "x"), (None, None, None)]
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.read_typed(spark, str(tmp_path / "t.csv"), "z int")
    report = profile.report_file(spark, str(tmp_path / "t.csv"), ["d"], ["c"], str(tmp_path / "report.json"))
    assert report["duplicates"]["duplicates"] == 1 and json.loads((tmp_path / "report.json").read_text()) == report
    freq = "\t".join("abcdefghij")
    (tmp_path / "f.tsv").write_text(freq + "\n")
    assert tuple(readers.read_tsv(spark, str(tmp_path / "f.tsv"), [f"c{i}" for i in range(10)]).first()) == tuple("abcdefghij")
    with pytest.raises(ValueError, match="missing columns: q"):
        readers.require_columns(spark.range(1), ["q"])
    assert readers.add_missing(spark.range(1), ["id", "z"]).columns == ["id", "z"]
    sinks.write_csv(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "out"))
    assert readers.read_csv(spark, str(tmp_path / "out")).first()["x"] == "a"


def test_streams(spark, tmp_path):
    spark.createDataFrame([("Panadol",), ("zzzz",)], "query string").write.parquet(str(tmp_path / "in"))
    drugs = spark.createDataFrame([(1, "acetaminophen", "Acetaminophen", "")], "row_no long, generic_name_clean string, generic_name string, brand_names string")
    asked = spark.readStream.schema("query string").parquet(str(tmp_path / "in"))
    lookup_stream.stream_lookup(asked, drugs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r["query"]: r["match_type"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"Panadol": "alias", "zzzz": "none"}
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = lookup_stream.windowed_counts(events, "ts", "event_type").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counted").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_plans_stay_native(spark):
    """Scalar queries compile without Python, and only the columns in use are read."""
    df = plans.QUERIES["n1_normalize_text"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "lang" not in plan.split("ReadSchema")[1]
    assert F.col("x") is not None
