"""Bounded sets, tables that are replaced as a whole, stores that stay, and figures from the write itself."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import facts, lookup, relational
from lectern.sources import readers, sinks


def test_first_k_hands_on_k_of_a_key_with_very_many_values(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.format_string("t%07d", F.col("id") % 200_000).alias("v"))
    out = relational.first_k(df, ["k"], "v", 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    hot = sorted({f"t{i % 200_000:07d}" for i in range(300_000) if i % 3})[:3]
    assert sorted(r["v"] for r in out.filter("k = -1").collect()) == hot
    assert out.count() == 100_000 + 3
    some = spark.createDataFrame([("a", "x"), ("a", None), ("a", "x"), ("b", None), ("b", None), (None, "y")], "k string, v string")
    assert sorted(map(tuple, relational.first_k(some, ["k"], "v", 1).collect()), key=repr) == sorted([("a", "x"), ("b", None), (None, "y")], key=repr)
    assert relational.first_k(some.limit(0), ["k"], "v", 1).count() == 0
    assert {tuple(r) for r in relational.first_of_sorted_set(some, "k", F.col("v"), 2, "s").collect()} == {("a", "x"), ("b", ""), (None, "y")}


def test_buckets_keep_keys_without_terms(spark):
    df = spark.createDataFrame([("a", "rare", "z"), ("a", "rare", "b"), ("a", "rare", "b"), ("a", "rare", None), ("b", "other", "q"), ("c", None, "q"), (None, "common", "n"), ("a", "common", "m")], "k string, b string, t string")
    out = {r["k"]: r for r in facts.bucket_top_k(df, "k", "b", "t", {"common": 2, "rare": 1}).collect()}
    assert {k: (r["common_terms"], r["rare_terms"]) for k, r in out.items()} == {"a": ("m", "b"), "b": ("", ""), "c": ("", ""), None: ("n", "")}


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read(spark, path)
    old = sinks.replace(spark.range(5).toDF("x"), path, note="first")
    bad = sinks.read(spark, path).select(F.when(F.col("x") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("x")).cast("long").alias("x"))
    with pytest.raises(Exception, match="stop"):
        sinks.replace(bad, path)
    assert sorted(r["x"] for r in sinks.read(spark, path).collect()) == [0, 1, 2, 3, 4]
    new = sinks.replace(sinks.read(spark, path).filter("x > 2"), path)  # from itself
    assert sorted(r["x"] for r in new.collect()) == [3, 4]
    assert sorted(r["x"] for r in old.collect()) == [0, 1, 2, 3, 4]  # a reader of the old version keeps it
    assert "note" not in sinks.manifest(spark, path)
    assert len(sinks.vacuum(spark, path)) == 2 and sinks.vacuum(spark, path) == []
    assert sorted(r["x"] for r in sinks.read(spark, path).collect()) == [3, 4]


def test_figures_come_from_the_write_itself(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "b")], "n long, `t x` string")
    got = sinks.write_measured(df, str(tmp_path / "t"), ["n", "t x"])
    assert got == {"row_count": 4, "n_filled": 4, "t x_filled": 2}
    again = spark.read.parquet(str(tmp_path / "t")).withColumnRenamed("t x", "tx")
    assert sinks.coverage_metrics(again, ["n", "tx"]).first().asDict() == {"row_count": 4, "n_filled": 4, "tx_filled": 2}


def test_csv_keeps_blanks_at_the_ends_of_cells(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(" a ", "b\t"), ("\n", "")], "x string, y string"), str(tmp_path / "c"))
    assert {tuple(r) for r in readers.read_csv(spark, str(tmp_path / "c")).collect()} == {(" a ", "b\t"), ("\n", "")}


def test_a_store_outlives_its_application_and_notices_new_files(spark, tmp_path, monkeypatch):
    catalogue, folder = tmp_path / "catalogue", str(tmp_path / "store")
    catalogue.mkdir()
    head = "drug_id,generic_name,generic_name_clean,brand_names\n"
    (catalogue / "a.csv").write_text(head + "A,Aspirin,aspirin,Bayer\nB,Zinc,zinc,\n")
    built = []
    plain = lookup.build_store
    monkeypatch.setattr(lookup, "build_store", lambda *a, **b: built.append(1) or plain(*a, **b))
    first = lookup.open_store(spark, str(catalogue), folder)
    again = lookup.open_store(spark, str(catalogue), folder)  # as another application would
    assert built == [1] and lookup.lookup_one(spark, "bayer", again)["matches"][0]["drug_id"] == "A"
    assert sorted(map(tuple, first.grams.collect())) == sorted(map(tuple, again.grams.select(first.grams.columns).collect()))
    (catalogue / "b.csv").write_text(head + "C,Calpol,calpol,\nD,Aspirin,aspirin,Late\n")
    new = lookup.open_store(spark, str(catalogue), folder)
    assert built == [1, 1]
    assert lookup.lookup_one(spark, "calpol", new)["matches"][0]["drug_id"] == "C" and lookup.lookup_one(spark, "aspirin", new)["matches"][0]["drug_id"] == "A"
    assert lookup.lookup_one(spark, "calpol", first)["matches"] == []  # the old version is still whole
    assert lookup.lookup_one(spark, "aspirn", new)["match_type"] == "fuzzy"
    monkeypatch.setattr(lookup, "build_store", lambda *a, **b: 1 / 0)
    (catalogue / "c.csv").write_text(head + "E,Iron,iron,\n")
    with pytest.raises(ZeroDivisionError):
        lookup.open_store(spark, str(catalogue), folder)
    assert sinks.manifest(spark, folder)["files"][-1][0].endswith("b.csv")
    with pytest.raises(FileNotFoundError):
        lookup.open_store(spark, str(tmp_path / "none"), folder)


def test_a_changed_catalogue_takes_over_what_is_still_there(spark, tmp_path, monkeypatch):
    """Rows that move, go, come and repeat; the store equals one made anew but for the order of grams, and only new rows and keys are worked on."""
    catalogue, folder = tmp_path / "catalogue", str(tmp_path / "store")
    catalogue.mkdir()
    head = "drug_id,generic_name,generic_name_clean,brand_names,warnings\n"
    two = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    line = lambda i: f"D{i},Name {two(i)}xol,name {two(i)}xol,Brand {two(i)}zin,May harm {i}\n"
    (catalogue / "b.csv").write_text(head + "".join(map(line, range(60))))
    lookup.open_store(spark, str(catalogue), folder)
    (catalogue / "a.csv").write_text(head + line(100) + line(7) + line(100))  # before all others: every row gets another number
    (catalogue / "b.csv").write_text(head + "".join(map(line, range(3, 61))))
    ranked, plain = [], lookup._ranked
    monkeypatch.setattr(lookup, "_ranked", lambda names, common: ranked.append(names.count()) or plain(names, common))
    got = lookup.open_store(spark, str(catalogue), folder)
    assert ranked == [4, 2]  # keys and names of suggestions that are new: of rows 60 and 100, and their brands
    version = sinks.manifest(spark, folder)["version"]
    assert sorted(r["drug_id"] for r in got.rows.filter(F.col("_since") == version).collect()) == ["D100", "D100", "D60"]
    new = lookup.build_store(readers.read_csv(spark, str(catalogue), row_no="row_no"))
    tell = lambda df, *drop: sorted(map(str, (sorted(r.asDict().items()) for r in df.drop(*drop).collect())))
    assert tell(got.rows, "_since") == tell(new.rows, "_since") and tell(got.keys) == tell(new.keys) and tell(got.pool) == tell(new.pool)
    assert tell(got.grams.select("key", "gram", "rank", "need")) == tell(new.grams.select("key", "gram", "rank", "need"))
    assert got.grams.select("gram", "n").distinct().count() == got.grams.select("gram").distinct().count()  # one order for all
    monkeypatch.setattr(lookup, "SMALL_POOL", 0)
    asked = spark.createDataFrame([("nam aexol",), ("name daxl",), ("brnd aczin",), ("name aaxol",), ("mane",)], "query string")
    large, small = (tell(lookup.lookup_batch(asked, s)) for s in (got._replace(large=True), new._replace(large=False)))
    assert large == small and len(large) == 5


def test_lists_are_made_anew_when_a_light_gram_has_grown_heavy(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY", 3)
    names = lambda n: lookup.sinks.materialize(spark.createDataFrame([(f"q{chr(98 + i)}", f"q{chr(98 + i)}") for i in range(n)], "key string, rank string"), "names")
    first = lookup.sinks.materialize(lookup.postings(names(3)), "first")
    held = lambda df: df.filter("gram = ' q0'").agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert tuple(held(lookup._renewed(names(6), first))) == (3, 3, 6)  # as it was noted
    assert tuple(held(lookup._renewed(names(7), first))) == (7, 7, 7)  # over twice HEAVY: counted again
    assert lookup._renewed(names(7).limit(0), first).count() == 0


def test_alias_query_reads_its_table_once_for_each_use(spark, monkeypatch):
    """What many jobs of a lookup read is a small table, not the large one again."""
    from lectern.plans import queries as plans

    class Stop(Exception):
        pass

    seen = []

    def lookup_batch(asked, drugs):
        seen.extend(asked.inputFiles() + drugs.inputFiles())
        raise Stop

    monkeypatch.setattr(plans.lookup, "lookup_batch", lookup_batch)
    with pytest.raises(Stop):
        plans.QUERIES["q5_alias_branch"](spark, "/root/testdata/sf0.001")
    assert seen and not any("part.parquet" in f for f in seen)
