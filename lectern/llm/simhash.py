"""SimHash near-deduplication with covering locality-sensitive hashing.

For radius r, each of the 64 bit places gets a vector of r + 1 bits, and each nonzero vector v gives a mask of the
places whose vector has odd inner product with v. Any r places lie in some hyperplane, so two fingerprints within the
radius agree under some mask: 2^(r+1) - 1 tables lose no pair. Equal fingerprints are one node from the start.
A cell hands on a spanning forest of its links and never all pairs: it is searched breadth first, each fingerprint once
against those not yet found, 8 bytes each. Only a cell of more than `cell` distinct fingerprints, whose search would
take seconds, is dealt out again by a second family over the same places, which covers again, until cells are small; each
such level makes 15 rows of one, as the first does of all.

Defined cases: null and wordless texts have fingerprint zero and link like others; a null doc_id counts as larger
than all; repeated rows share a component; texts may be of any length; of several texts with the smallest doc_id one
stays; an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from ._common import boxed, materialize, sliced, text_or_empty, unboxed
from .components import components

RADIUS, SHINGLE, SEED, CELL, LEVELS = 3, 3, 42, 16384, 5


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint. bytes.lower and bytes.split know A-Z and the six ASCII white-space characters only."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """doc_id, fp for each row of docs; with `hashed` also _t, the hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [fingerprint(t.as_py()) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *more])

    more = ["_t"] if hashed else []
    text = F.col(text_col).cast("string").alias("text")
    return docs.select(F.col(id_col).alias("doc_id"), text, *[_text_hash(docs, text_col).alias(c) for c in more]).mapInArrow(run, f"doc_id {kind}, fp long" + ", _t long" * hashed)


def _text_hash(docs: DataFrame, text_col: str) -> Column:
    return F.xxhash64(text_or_empty(docs, text_col))


def masks(radius: int, level: int) -> list[int]:
    """The covering family of a level, as signed numbers; every vector goes to equally many places, in an order of the level's own."""
    n = 1 << (radius + 1)
    places = np.random.RandomState(17 + level).permutation(64) if level else np.arange(64)
    out = []
    for v in range(1, n):
        mask = sum(1 << int(b) for k, b in enumerate(places) if bin(k % n & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def uncovered(radius: int, levels: int) -> int:
    """The most places that no mask covers on any way down the levels. Fingerprints of a cell agree in all others, so a cell has at most 2 to
    this power: 9 after LEVELS levels, 12 after one less, so that no cell is larger than CELL there."""
    left = np.array([(1 << 64) - 1], np.uint64)
    for level in range(levels):
        own = np.array([m & (1 << 64) - 1 for m in masks(radius, level)], np.uint64)
        left = np.unique(left[:, None] & ~own)
    return int(np.bitwise_count(left).max())


def forest(cell: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a cell (distinct fingerprints) within the radius, found breadth first."""
    left = cell.view(np.uint64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(left):
        queue, left, at = [left[:1]], left[1:], 0
        while at < len(queue) and len(left):
            for word in queue[at]:
                near = np.bitwise_count(left ^ word) <= radius
                if near.any():
                    found, left = left[near], left[~near]
                    out.append((np.full(len(found), word), found))
                    queue.append(found)
            at += 1
    if not out:
        return []
    return list(zip(*(np.concatenate([o[i] for o in out]).view(np.int64).tolist() for i in (0, 1))))


def links(distinct: DataFrame, radius: int = RADIUS, cell: int = CELL, levels: int = LEVELS) -> DataFrame:
    """distinct: fp, each value once. u, v: a set of links between them that connects what the full set connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for members in batch.column(0):
                pairs += forest(np.sort(members.values.to_numpy(zero_copy_only=False)), radius)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    found, rows = None, distinct.select("fp", F.lit(0).cast("long").alias("_cell"))
    for level in range(levels):
        family = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).cast("long").alias("m")) for k, m in enumerate(masks(radius, level))])
        dealt = rows.select("fp", "_cell", F.explode(family).alias("_t"))
        dealt = dealt.select("fp", F.xxhash64("_cell", "_t.k", F.col("fp").bitwiseAND(F.col("_t.m"))).alias("_cell"))  # cells that a hash merges only cost time
        sizes = dealt.groupBy("_cell").agg(F.count("*").alias("_n")).filter("_n > 1").withColumnRenamed("_cell", "_c")
        sizes = materialize(sizes, "cell-sizes")  # a table of its own, so that a large cell's rows can be split in the join
        dealt = materialize(dealt.join(sizes, F.col("_cell") == F.col("_c")).select("fp", "_cell", "_n"), "cells")
        last = level == levels - 1  # its cells are small: see uncovered()
        small = dealt if last else dealt.filter(F.col("_n") <= cell)
        cells = small.groupBy("_cell").agg(F.array_sort(F.collect_list("fp")).alias("_m")).select("_m").distinct()
        pairs = cells.mapInArrow(run, "u long, v long")
        found = pairs if found is None else found.unionByName(pairs)
        rows = dealt.filter(F.col("_n") > cell).select("fp", "_cell")
        if last or rows.isEmpty():
            break
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for each row of docs."""
    out = _placed(fingerprints(docs, id_col, text_col), radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _placed(prints: DataFrame, radius: int) -> DataFrame:
    """prints with component_id, and with _component, which is never null."""
    prints = materialize(prints, "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    rooted = components(links(nodes.select("fp"), radius))
    root = F.coalesce("root", "fp")
    member = materialize(nodes.join(rooted, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), "_least", root.alias("_root")), "members")
    heads = member.groupBy("_root").agg(F.min("_least").alias("component_id")).withColumnRenamed("_root", "_r")
    member = member.join(heads, F.col("_root") == F.col("_r")).select("_fp", "component_id", F.col("_r").alias("_component"))
    return prints.join(member, F.col("fp") == F.col("_fp"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay: of each component those of the smallest doc_id, and if that has several texts, of one of them.

    Rows equal in doc_id and text stay or go together.
    """
    placed = _placed(fingerprints(docs, id_col, text_col, hashed=True), radius).select("doc_id", "_t", "component_id", "_component")
    placed = materialize(placed, "placed")
    chosen = F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("_t")))
    several = placed.groupBy(F.col("_component").alias("_of")).agg(F.count("*").alias("_n"), F.min("component_id").alias("_stay"), chosen.alias("_st")).filter("_n > 1")
    several = materialize(several, "components")  # a table of its own, so that a hot component's rows can be split in the join
    lost = placed.join(several, F.col("_component") == F.col("_of")).filter(~(F.col("doc_id").eqNullSafe(F.col("_stay")) & (F.col("_t") == F.col("_st"))))
    lost = materialize(lost.select(F.col("doc_id").alias("_lost"), F.col("_t").alias("_lt")).distinct(), "lost")
    # texts that cannot be among the lost stay where they are
    bits = bloom.bits_for(lost.count())
    own = docs.select(boxed(docs), docs[id_col].alias("_id"), _text_hash(docs, text_col).alias("_t"))
    own = bloom.probe(own, F.xxhash64("_id", "_t"), bloom.member_filter(lost.select(F.xxhash64("_lost", "_lt").alias("_h")), F.col("_h"), bits), bits, "_maybe")
    left = own.filter("_maybe").join(lost, F.col("_id").eqNullSafe(F.col("_lost")) & (F.col("_t") == F.col("_lt")), "left_anti")
    return unboxed(own.filter("not _maybe").unionByName(left), docs)
