"""A trie of conversation prefixes by partition refinement.

All conversations start in one class. A round reads the next turns of the classes that have two members or more, and splits
each class by them, turn by turn; a class that is left with one member retires, and the rest of that conversation is a
unary chain, which is written straight from its turns. Rounds take twice as many turns each, so a shared prefix of n turns
costs about log n rounds, and a turn is read in the one round that splits by it. A class bears the smallest conversation
in it as its name.

Folding back needs no walk over levels. A conversation owns the nodes that bear its name: a suffix of its path. What all
of them add up to hangs on the node above the first, and counts for every node above that; so a sum over a node's subtree
is what its owner has below it, plus a sum over its other members. Chains add one leaf each and no saved text.

Turns are 128-bit digests of role and text from the start; texts are read once and never move. Positions come from a range
sort, so that no conversation need fit a task, and classes are counted before they are shuffled. The members that end in a node are
written as blocks of sorted ids, which only one hash per node reads one after the other, as SHA-256 demands.

Defined cases: turns are in order of `turn`, nulls first, equal ones by their digests; null roles and texts are empty;
rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own; an empty table
has no node, not even a root; texts may be of any length; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Turns that the first round splits by, and the most that any does.
FIRST_TURNS, MOST_TURNS = 8, 512
#: Ids of members in a block of text.
BLOCK = 4096
_NOTHING = hashlib.sha256(b"").hexdigest()


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, the conversation first -> each with its place among those of its conversation in this partition."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column(0).to_numpy()
        first = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1))
        many = np.diff(np.append(first, len(c)))
        at = np.arange(len(c)) - np.repeat(first, many)
        if c[0] == last:
            at[: many[0]] += seen
        last, seen = c[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["c", "part", "a", "b", "n", "at"])


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """c, at (from 0), a, b (digests of role and text), n (code points of the text), a row for each turn."""
    role, text = (F.coalesce(conversations[x].cast("string"), F.lit("")) for x in (role_col, text_col))
    columns = [conversations[conv_col].cast("long").alias("c"), conversations[turn_col].alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, role, F.lit(1)).alias("b"), F.length(text).cast("long").alias("n")]
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    ranged = conversations.filter(conversations[conv_col].isNotNull()).select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("c", F.spark_partition_id().alias("part"), "a", "b", "n").mapInArrow(_number, "c long, part int, a long, b long, n long, at long")
    ranged = materialize(ranged, "turns")
    # conversations that go on in a later partition: at most one begins in the middle of each
    ends = ranged.groupBy("part").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    edges = ranged.join(F.broadcast(ends), "part").filter("c = lo or c = hi").groupBy("c", "part").agg(F.count("*").alias("k"))
    earlier = F.sum("k").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = edges.select(F.col("c").alias("_c"), F.col("part").alias("_part"), earlier.alias("_before")).filter("_before is not null")
    out = ranged.join(F.broadcast(before), (F.col("c") == F.col("_c")) & (F.col("part") == F.col("_part")), "left")
    return out.select("c", (F.col("at") + F.coalesce("_before", F.lit(0))).alias("at"), "a", "b", "n")


def paths_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (c, d from 1, a, b, n, length) and (c, length)."""
    lengths = materialize(turns.groupBy("c").agg(F.count("*").alias("length")), "lengths")
    return turns.join(lengths, "c").select("c", (F.col("at") + 1).alias("d"), "a", "b", "n", "length"), lengths


def branched(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: of c, the first h turns come from conversation c - c % family
    (all of them if it has fewer, none if there is none), the others are its own after its first h; h is the CRC-32 of c in decimal, modulo `most`."""
    c = F.col("c")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most))
    own = materialize(turns.groupBy("c").agg(F.count("*").alias("k")), "counts")
    told = own.select("c", "k", h.alias("h"), (c - c % family).alias("base")).join(own.select(F.col("c").alias("_c"), F.col("k").alias("_k")), F.col("base") == F.col("_c"), "left")
    told = told.withColumn("m", F.least("h", F.coalesce("_k", F.lit(0))))
    told = materialize(told.select("c", "base", "h", "m", (F.col("m") + F.greatest(F.col("k") - F.col("h"), F.lit(0))).alias("length")), "families")
    rest = turns.filter(F.col("at") >= h).join(told, "c").select("c", (F.col("m") + F.col("at") - F.col("h") + 1).alias("d"), "a", "b", "n", "length")
    heads = turns.filter((F.col("at") < most - 1) & (c % family == 0)).select(c.alias("_c"), "at", "a", "b", "n")
    heads = heads.join(told.filter("m > 0"), F.col("_c") == F.col("base")).filter("at < m").select("c", (F.col("at") + 1).alias("d"), "a", "b", "n", "length")
    return rest.unionByName(heads), told.select("c", "length")


def _refine(paths: DataFrame, root: int, first: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Classes of two members or more, (owner, d, k, n) with k members, and their members (c, d, owner), a table of each for every round."""
    nodes, members, active, depth, width = [], [], None, 0, first
    along = Window.partitionBy("c").orderBy("d")  # at most `width` turns
    while True:
        part = paths.filter((F.col("d") > depth) & (F.col("d") <= depth + width))
        part = part.withColumn("class", F.lit(root).cast("long")) if active is None else part.join(active, "c")
        told = [F.bit_xor(F.xxhash64(*x)).over(along).alias(name) for name, x in (("x", ("d", "a", "b")), ("y", ("b", "d", "a")))]
        part = materialize(part.select("c", "class", "d", "n", "length", *told), "split")
        split = part.groupBy("class", "d", "x", "y").agg(F.min("c").alias("owner"), F.count("*").alias("k"), F.max("n").alias("n"))
        split = materialize(split.filter("k > 1"), "classes")  # a table of its own, so that the members of a large class can be split in the join
        met = part.drop("n").join(split, ["class", "d", "x", "y"]).select("c", "d", "owner", "length")
        met = materialize(met, "class-members")
        nodes.append(split.select("owner", "d", "k", "n"))
        members.append(met.select("c", "d", "owner"))
        depth, width = depth + width, min(2 * width, most)
        active = met.filter((F.col("d") == depth) & (F.col("length") > depth)).select("c", F.col("owner").alias("class"))
        if active.isEmpty():
            return nodes, members


def _ends_digests(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """ends: owner, d, c. owner, d, ends_sha256: of the ids in ascending order, comma-joined."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, d, c = (x.to_numpy() for x in batch.columns)
            fresh = np.flatnonzero((owner[1:] != owner[:-1]) | (d[1:] != d[:-1])) + 1
            cuts = sorted({0, *fresh.tolist(), *range(0, len(c), block)} - {len(c)})
            texts = [",".join(map(str, c[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(c)])]
            yield pa.RecordBatch.from_arrays([pa.array(owner[cuts]), pa.array(d[cuts]), pa.array(c[cuts]), pa.array(texts, pa.string())], names=["owner", "d", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["owner", "d", "ends_sha256"])
        for batch in batches:
            done = []
            for owner, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (owner, d) == key:
                    digest.update(b",")
                else:
                    done += [(*key, digest.hexdigest())] if key else []
                    key, digest = (owner, d), hashlib.sha256()
                digest.update(ids.as_buffer())
            yield make(done)
        if key:
            yield make([(*key, digest.hexdigest())])

    order = ["owner", "d", "c"]
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, "owner long, d long, first long, ids string")
    return texts.repartition("owner", "d").sortWithinPartitions("owner", "d", "first").mapInArrow(hashed, "owner long, d long, ends_sha256 string")


def trie(paths: DataFrame, lengths: DataFrame, first: int = FIRST_TURNS, most: int = MOST_TURNS) -> DataFrame:
    """The nodes of a trie of conversations, given by paths (c, d, a, b, n, length) and lengths (c, length; turnless ones too), as paths_of() and branched() make them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    paths, lengths = materialize(paths, "paths"), materialize(lengths, "path-lengths")
    total, root = lengths.agg(F.count("*"), F.min("c")).first()
    nodes, members = _refine(paths, root, first, most) if total else ([], [])
    zero = F.lit(0).cast("long")
    top = lengths.agg(F.min("c").alias("owner"), zero.alias("d"), F.count("*").alias("k"), zero.alias("n")).filter("k > 0")
    nodes = reduce(DataFrame.unionByName, nodes, top)
    everyone = lengths.select("c", zero.alias("d"), F.lit(root).cast("long").alias("owner"))
    members = reduce(DataFrame.unionByName, members, everyone)

    # of each conversation: the depth down to which it shares nodes, the owner there, the first node that it owns, and the owner above that
    other = F.col("owner") != F.col("c")
    shared = members.groupBy("c").agg(F.max("d").alias("s"), F.max_by("owner", "d").alias("last"), F.min(F.when(~other, F.col("d"))).alias("own"), F.max_by(F.when(other, F.col("owner")), F.when(other, F.col("d"))).alias("up"))
    own = F.coalesce("own", F.when(F.col("length") > F.col("s"), F.col("s") + 1))
    told = materialize(shared.join(lengths, "c").select("c", "length", "s", "last", own.alias("own"), "up"), "told")

    # what hangs on each node from beside its owner's path, and the ends of paths that are leaves
    hung = told.filter("up is not null and own is not null").groupBy(F.col("up").alias("owner"), (F.col("own") - 1).alias("d")).agg(F.count("*").alias("hung"))
    hung = materialize(hung, "hung")
    w = (F.col("k") - 1) * F.col("n")
    below = Window.partitionBy("owner").orderBy(F.desc("d"))
    nodes = materialize(nodes.select("owner", "d", "k", F.sum(w).over(below).alias("under")), "nodes")
    total_of = nodes.groupBy(F.col("owner").alias("_c")).agg(F.max("under").alias("under"))
    last_hung = hung.select(F.col("owner").alias("_o"), F.col("d").alias("_d"))
    adds = told.filter("own is not null").join(last_hung, (F.col("c") == F.col("_o")) & (F.col("length") == F.col("_d")), "left")
    adds = adds.select("c", F.col("_o").isNull().cast("long").alias("leaf")).join(total_of, F.col("c") == F.col("_c"), "left")
    adds = materialize(adds.select(F.col("c").alias("_c"), "leaf", F.coalesce("under", zero).alias("under")).filter("leaf > 0 or under > 0"), "adds")
    sums = members.join(adds, F.col("c") == F.col("_c")).select("owner", "d", "leaf", F.when(other, F.col("under")).otherwise(zero).alias("beside"))
    sums = sums.groupBy(F.col("owner").alias("_owner"), F.col("d").alias("_d")).agg(F.sum("leaf").alias("leaves"), F.sum("beside").alias("beside"))

    at = lambda side: (F.col("owner") == F.col("_owner")) & (F.col("d") == F.col("_d"))
    beside = lambda df, *columns: df.select(F.col("owner").alias("_owner"), F.col("d").alias("_d"), *columns)
    inner = nodes
    for side in (sums, beside(hung, "hung"), beside(_ends_digests(told.filter("s = length").select(F.col("last").alias("owner"), F.col("s").alias("d"), "c")), "ends_sha256")):
        inner = inner.join(side, at(side), "left").drop("_owner", "_d")
    inner = inner.join(told.select("c", "length", "own", "up"), F.col("owner") == F.col("c"))
    more = (F.col("length") > F.col("d")).cast("long")
    parent = F.when(F.col("d") == F.col("own"), F.col("up")).otherwise(F.col("c"))
    inner = inner.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), F.col("k").alias("n_convs"), (more + F.coalesce("hung", zero)).alias("n_children"), F.coalesce("leaves", zero).alias("n_leaves"), (F.col("under") + F.coalesce("beside", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
    alone = F.lit(1).cast("long")
    ends = F.when(F.col("d") == F.col("length"), F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(_NOTHING))
    chains = paths.drop("length").join(told.select("c", "length", "s", "own", "up"), "c").filter("d > s")
    chains = chains.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), alone.alias("n_convs"), more.alias("n_children"), alone.alias("n_leaves"), zero.alias("saved_tokens"), ends.alias("ends_sha256"))
    return inner.unionByName(chains)
