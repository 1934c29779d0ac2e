"""Files: CSV read by many tasks, the order of rows over files, and what counts as a record."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import lookup
from lectern.sources import order, readers, split_csv


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def _cell(r):
    plain = "".join(r.choice("ab é\t;") for _ in range(r.randint(0, 6)))
    kind = r.random()
    if kind < 0.3:
        return '"' + plain + r.choice(["\n", ",", '""', "\n\n", '"",""\n', ""]) * r.randint(0, 3) + plain + '"'
    if kind < 0.33:
        return '"' + ("long " * 40 + "\n") * 4 + '"'
    if kind < 0.37:
        return plain + 'a" ' + plain  # a quote that opens nothing
    return plain.strip("\t")


def _table(r, rows, end="\n"):
    return end.join([",".join(["h1", "h2", "h3"])] + [",".join(_cell(r) for _ in range(3)) if r.random() < 0.95 else "" for _ in range(rows)]) + end * r.randint(0, 1)


@pytest.mark.parametrize("seed", range(6))
def test_split_csv_equals_one_task(spark, small_blocks, tmp_path, seed):
    r = random.Random(seed)
    folder = tmp_path / "t"
    folder.mkdir()
    for name in ("b one.csv", "a.csv", "c.csv")[: 1 + seed % 3]:
        (folder / name).write_bytes(_table(r, r.choice([0, 3, 60]), "\r\n" if seed == 4 else "\n").encode())
    whole = readers.read_csv(spark, str(folder), split=False, row_no="n").collect()
    parts = readers.read_csv(spark, str(folder), split=True, row_no="n")
    assert parts.columns == ["h1", "h2", "h3", "n"]
    key = lambda x: x["n"]
    assert [tuple(x) for x in sorted(parts.collect(), key=key)] == [tuple(x) for x in sorted(whole, key=key)]
    assert sorted(x["n"] for x in whole) == list(range(len(whole)))
    assert sorted(map(tuple, readers.read_csv(spark, str(folder), split=True, na="null").collect()), key=repr) == sorted(map(tuple, readers.read_csv(spark, str(folder), split=False, na="null").collect()), key=repr)


def test_split_csv_of_odd_files(spark, small_blocks, tmp_path):
    cases = {
        "open": 'a,b\n1,"never closed\n' + "x\n" * 400 + "x", "blank": "a,b\n\n\n1,2\n\n", "bytes": b'a,b\n\xff\xfe,"\x80\n"\n', "wide": "a,b\n1,2,3,4\n5\n", "spaces": 'a,b\n "x",y\n"z" q,"w"\n',
        "swap": 'a,b\n' + '1,"x\n",2\n' * 200, "middle": "a,b\n" + 'p,5" pipe\nq,6" pipe\n' * 60, "names": '"a x ",b\n1,2\n',
    }
    for name, text in cases.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        got = [readers.read_csv(spark, str(path), split=s, row_no="n").orderBy("n").collect() for s in (False, True)]
        assert got[0] == got[1] and got[0] and got[0][0].asDict().keys() == got[1][0].asDict().keys(), name
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert readers.read_csv(spark, str(tmp_path / "empty.csv"), split=True).count() == 0


def test_many_tasks_read_one_file(spark, tmp_path):
    """Half of all cells hold line breaks; a task reads 64 KB."""
    path = tmp_path / "large.csv"
    with open(path, "w") as f:
        f.write("k,text\n")
        for i in range(20_000):
            f.write(f'{i},"line one of {i}\nline ""two"", {i}"\n' if i % 2 else f"{i},plain {i}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        df = readers.read_csv(spark, str(path), split=True)
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 8
        got = {r["k"]: r["text"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {str(i): f'line one of {i}\nline "two", {i}' if i % 2 else f"plain {i}" for i in range(20_000)}


def test_effects_of_lines(spark):
    lines = ["plain,x", 'a,"open', 'b",c', '"a","b"', '"a""b",c', 'a" b,"c', '""', '"', '"a"b,"', 'x"y"z', '","', '"",""",', ""]
    effects = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in lines], "l string").select("l", split_csv._effect(F.col("l"), ",")).collect()}

    def walk(line, inside):
        state, i = ("in" if inside else "start"), 0
        while i < len(line):
            c = line[i]
            if state == "in":
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    state = "cell"
            elif c == ",":
                state = "start"
            elif state == "start":
                state = "in" if c == '"' else "cell"
            i += 1
        return state == "in"

    for line in lines:
        assert effects[line] == walk(line, False) + 2 * walk(line, True), line


def test_first_record_wins_over_files_of_any_size(spark, tmp_path):
    record = "<drug><name>{}</name><classification><direct-parent>{}</direct-parent></classification></drug>"
    (tmp_path / "a.xml").write_text("<drugs>" + record.format("Aspirin", "first") + "</drugs>")
    (tmp_path / "b.xml").write_text("<drugs>" + record.format("aspirin", "second") * 300 + record.format("other", "only") + "</drugs>")
    (tmp_path / "c.xml").write_text("<drugs>" + record.format("OTHER", "late") + record.format("aspirin", "third") + "</drugs>")
    assert {tuple(r) for r in readers.read_class_xml(spark, str(tmp_path)).collect()} == {("aspirin", "first"), ("other", "only")}


def test_store_numbers_rows_in_the_order_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "_STORES", {})
    head = "drug_id,generic_name,generic_name_clean,brand_names\n"
    (tmp_path / "1.csv").write_text(head + "A,Aspirin,aspirin,\n")
    (tmp_path / "2.csv").write_text(head + "".join(f"X{i},Filler {i},filler {i},\n" for i in range(300)) + "B,Aspirin,aspirin,Bayer\n")
    store = lookup.init_store(spark, str(tmp_path))
    assert store.keys.filter("key = 'aspirin'").first()["row_no"] == 0
    assert sorted(r["row_no"] for r in store.rows.select("row_no").collect()) == list(range(302))
    assert lookup.lookup_one(spark, "aspirin")["matches"][0]["drug_id"] == "A"


def test_numbers_are_dense_over_blocks(spark):
    df = spark.createDataFrame([("b", 7, "x"), ("a", 3, "y"), ("b", 8, "z"), ("c", -1, "w")], "block string, row long, v string")
    assert {r["v"]: r["n"] for r in order.number_rows(df, "n", "block", "row").collect()} == {"y": 0, "x": 1, "z": 2, "w": 3}
    assert order.number_rows(df.limit(0), "n", "block", "row").count() == 0


def test_few_row_groups_are_dealt(spark, tmp_path, monkeypatch):
    """A large file is split by bytes, but a row group has one reader: its rows are dealt, those of many files are not."""
    monkeypatch.setattr(readers, "SMALL_BYTES", 0)
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    spark.range(1000).coalesce(1).write.parquet(few)
    spark.range(1000).repartition(8).write.option("parquet.block.size", 1024).parquet(many)
    dealt = readers.deal(spark.read.parquet(few))
    assert dealt.rdd.getNumPartitions() >= 8 and sorted(r.id for r in dealt.collect()) == list(range(1000))
    whole = spark.read.parquet(many)
    assert readers.deal(whole) is whole
