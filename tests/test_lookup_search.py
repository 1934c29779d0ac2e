"""Search for the nearest names: by posting lists, in salted blocks and by bounds, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.operators import lookup

PARTS = ["a", "b", "ab", "xy", "para", "cetamol", "ibuprofen", "profen", "calpol", "six", "plus", "zinc", "acid", "extra", "vitamin", "c", "sodium", "chloride"]


def _bent(r, k):
    k = list(k)
    for _ in range(r.randint(0, 3)):
        at = r.randrange(len(k))
        k[at : at + r.randint(0, 1)] = r.choice(["", "q", "e", ""])
        k = k or ["q"]
    return " ".join("".join(k).split()) or "q"


def _names(seed):
    r = random.Random(seed)
    keys = sorted({" ".join(r.choices(PARTS, k=r.randint(1, 4))) for _ in range(160)} | set(PARTS) | {"sodium " + "".join(r.choices("abcdefgh", k=r.randint(2, 14))) for _ in range(80)})
    queries = sorted({_bent(r, r.choice(keys)) for _ in range(60)} | {"a", "q", "sodium", "plus plus plus", "c vitamin", "zzzz zzzz"})
    return keys, queries


@pytest.mark.parametrize("heavy", [3, 10**9])
def test_posting_lists_and_blocks_find_what_all_pairs_find(spark, monkeypatch, heavy):
    """heavy 3: nearly every gram is heavy, so names meet in blocks, of 40 keys by 15 queries."""
    for name, value in (("HEAVY", heavy), ("SMALL_POOL", 0), ("BLOCK_KEYS", 40), ("BLOCK_QUERIES", 15)):
        monkeypatch.setattr(lookup, name, value)
    keys, queries = _names(heavy % 7)
    rows = spark.createDataFrame([(i, k, "", "") for i, k in enumerate(keys)], "row_no long, generic_name_clean string, generic_name string, brand_names string")
    store = lookup.build_store(rows)
    assert store.large
    asked = spark.createDataFrame([(q,) for q in queries], "q string")
    for cutoff, limit in ((80.0, 5), (45.0, 4)):
        got = {x["q"]: [(m["match"], round(m["score"], 6)) for m in x["_top"]] for x in lookup.fuzzy_top(asked, "q", store, cutoff, limit).collect()}
        for q in queries:
            best = sorted(((-S.weighted_ratio(q, k), k) for k in keys if S.weighted_ratio(q, k) >= cutoff))[:limit]
            assert got.get(q, []) == [(k, round(-s, 6)) for s, k in best], (q, cutoff)
    small = lookup.nearest(asked, store.keys.select(F.col("key").alias("match"), F.col("key").alias("rank")).limit(0), store.grams.limit(0), 80.0, 5)
    assert small.count() == 0 and lookup.nearest(asked.limit(0), store.pool.select("match", "rank"), store.pool_grams, 45.0, 5).count() == 0


def _sodium(n):
    r = random.Random(3)
    word = lambda: "".join(r.choices("aeioubcdfghlmnprstvxz", k=r.randint(5, 12)))
    keys = sorted({"sodium " + word() for _ in range(n)})
    return keys, sorted({k[:9] + k[10:] for k in keys})


def test_names_that_share_a_word_do_not_meet_in_pairs(spark):
    """Of 2,500 keys and as many queries that all say sodium, under 5 % of the pairs are handed on by posting lists, and of blocks, scored."""
    keys, queries = _sodium(2500)
    pool = spark.createDataFrame([(k, k) for k in keys], "key string, rank string")
    grams = lookup.sinks.materialize(lookup.postings(pool), "test-grams")
    asked = lookup._asked(spark.createDataFrame([(q,) for q in queries], "q string"), grams)
    every = len(keys) * len(queries)
    assert lookup._shared(asked, grams, True).count() < 0.05 * every
    tied = lookup._tied(asked, grams, 10)
    assert tied.groupBy("q").count().agg(F.max("count")).first()[0] <= 10
    block = S.Block(keys)
    for q in queries[::50]:
        block.best(q, 45.0, 15)
    assert block.scored < 0.05 * len(queries[::50]) * len(keys)


def test_few_of_many_keys_are_scored():
    """Over 100,000 keys under 5 % are scored one by one, at the low score of suggestions."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("aeioubcdfghlmnprstvxz", k=r.randint(5, 12)))
    keys = sorted({f"{word()} {word()}" if r.random() < 0.5 else word() for _ in range(100_000)})
    block, queries = S.Block(keys), [k[:2] + k[3:] for k in r.sample(keys, 8)]
    for q in queries:
        assert block.best(q, 45.0, 15)[0][1] >= 80
    assert block.scored < 0.05 * len(queries) * len(keys)


def test_bounds_hold_and_reach():
    r = random.Random(7)
    name = lambda: " ".join(r.choices([*PARTS, "y" * 40], k=r.randint(1, 5))) if r.random() < 0.6 else _bent(r, "abc pab cp")
    for _ in range(250):
        keys = sorted({name() for _ in range(r.randint(1, 25))})
        block = S.Block(keys)
        for q in (name(), name()):
            bound = block.bound(q)
            assert all(S.weighted_ratio(q, k) <= bound[i] for i, k in enumerate(keys))
            for cutoff, limit in ((0.0, 3), (45.0, 15), (80.0, 10)):
                want = sorted((-S.weighted_ratio(q, k), i) for i, k in enumerate(keys))
                assert block.best(q, cutoff, limit) == [(i, -s) for s, i in want if -s >= cutoff][:limit]
