"""Resharding by minimum-cost flow.

Old shard sizes are the supplies and new capacities the demands of a transport problem in which a byte that
stays costs nothing and a byte that moves costs one. The flow says how many bytes of each old shard go where;
blocks of documents, and inside the few blocks on a border single documents, are dealt out along it.

Only block totals reach the driver: at most old shards x size classes x sub-blocks of them, whatever the input.
Documents of a block that share a size are spread over the sub-blocks by doc_id, so equal texts never pile up.

rewrite() carries every row through the plan under a number of its own and writes the shards that changed.

Defined cases: a null text has no bytes; a null doc_id is a value like others and sorts first; repeated rows are placed,
and written, one by one; a present shard that is null or out of range is taken by hash of doc_id; texts may be of any
length; an empty table gives an empty result; other columns, whatever their names, are not looked at, and are written as
they are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import boxed, materialize, power_of_two, text_or_empty

OVERHEAD = 8


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Successive shortest paths with potentials on the bipartite network; cost(i, j) >= 0 for each byte."""
    s, t = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than the supplies")
    left, room, flow = list(supply), list(capacity), {}
    pot = [0] * (s + t)
    while any(left):
        dist, back = [None] * (s + t), [None] * (s + t)
        heap = [(0, i) for i in range(s) if left[i]]
        for _, i in heap:
            dist[i] = 0
        done = [False] * (s + t)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u < s:
                steps = [(s + j, cost(u, j)) for j in range(t)]
            else:
                steps = [(i, -cost(i, u - s)) for i in range(s) if flow.get((i, u - s), 0)]
            for v, c in steps:
                new = d + c + pot[u] - pot[v]
                if not done[v] and (dist[v] is None or new < dist[v]):
                    dist[v], back[v] = new, u
                    heapq.heappush(heap, (new, v))
        sinks = [s + j for j in range(t) if room[j] and dist[s + j] is not None]
        end = min(sinks, key=lambda v: (dist[v] + pot[v], v))
        reach = max(x for x in dist if x is not None)
        pot = [p + (reach if d is None else d) for p, d in zip(pot, dist, strict=True)]
        path, v = [end], end
        while back[v] is not None:
            v = back[v]
            path.append(v)
        path.reverse()
        push = min(left[path[0]], room[end - s])
        for a, b in zip(path, path[1:]):
            if a >= s:
                push = min(push, flow[b, a - s])
        for a, b in zip(path, path[1:]):
            key, sign = ((a, b - s), 1) if a < s else ((b, a - s), -1)
            flow[key] = flow.get(key, 0) + sign * push
        left[path[0]] -= push
        room[end - s] -= push
    return {k: v for k, v in flow.items() if v}


def _even(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def reshard(docs: DataFrame, new_shards: int, old_shards: int, old_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", sub_blocks: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved for each row of docs.

    old_col names the column with the present shard (0 to old_shards - 1); without it, documents lie by hash of doc_id.
    """
    rows = materialize(docs.select(*_sized(docs, old_shards, old_col, id_col, text_col)), "sizes")
    return _dealt(rows, new_shards, old_shards, sub_blocks).drop("_row")


def _sized(docs: DataFrame, old_shards: int, old_col: str | None, id_col: str, text_col: str) -> list[Column]:
    text = text_or_empty(docs, text_col)
    hashed = F.pmod(F.xxhash64(docs[id_col]), F.lit(old_shards)).cast("int")
    old = F.coalesce(F.when(docs[old_col].between(0, old_shards - 1), docs[old_col].cast("int")), hashed) if old_col else hashed
    return [docs[id_col].alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old.alias("old_shard"), F.monotonically_increasing_id().alias("_row")]


def _dealt(rows: DataFrame, new_shards: int, old_shards: int, sub_blocks: int | None) -> DataFrame:
    """rows (a table: doc_id, size, text_crc32, old_shard, _row) with their places."""
    spark = rows.sparkSession
    if sub_blocks is None:
        sub_blocks = power_of_two(rows.count() // 4_000_000, 8, 512)
    block = ["old_shard", "_class", "_sub"]
    rows = rows.select("doc_id", "size", "text_crc32", "old_shard", "_row").withColumns({"_class": F.length(F.bin("size")), "_sub": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(sub_blocks)).cast("int")})

    totals = rows.groupBy(*block).agg(F.sum("size").alias("b")).collect()
    supply, starts = [0] * old_shards, {}
    for r in sorted(totals, key=lambda r: (r["old_shard"], -r["_class"], r["_sub"])):
        starts[r["old_shard"], r["_class"], r["_sub"]] = supply[r["old_shard"]]
        supply[r["old_shard"]] += r["b"]
    flow = min_cost_flow(supply, _even(sum(supply), new_shards), lambda i, j: int(i != j))
    ends: dict[int, tuple[list[int], list[int]]] = {}
    for i in range(old_shards):
        goes = sorted(((j != i, j), v) for (a, j), v in flow.items() if a == i)
        at, cuts = 0, ([], [])
        for (_, j), v in goes:
            at += v
            cuts[0].append(at)
            cuts[1].append(j)
        ends[i] = cuts
    plan = spark.createDataFrame([(*k, v, *ends[k[0]]) for k, v in starts.items()], "_o int, _c int, _s int, _start long, _ends array<long>, _to array<int>")
    here = (F.col("old_shard") == F.col("_o")) & (F.col("_class") == F.col("_c")) & (F.col("_sub") == F.col("_s"))

    order = Window.partitionBy(*block).orderBy(F.desc("size"), "doc_id", "text_crc32", "_row")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    dealt = rows.withColumns({"_upto": upto, "_rn": F.row_number().over(order)}).join(F.broadcast(plan), here)  # plan: at most the number of blocks
    middle = F.col("_start") + F.col("_upto") - F.col("size") / 2
    past = F.size(F.filter("_ends", lambda e: e.cast("double") <= middle))
    dealt = dealt.withColumn("shard", F.get("_to", F.least(past, F.size("_to") - 1)))
    dealt = materialize(dealt.select("doc_id", "size", "text_crc32", "_row", *block, "_rn", "shard"), "dealt")
    parts = dealt.groupBy("shard", *block).agg(F.count("*").alias("_n"), F.min("_rn").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy(*block)) - F.col("_n")
    parts = parts.select(F.col("shard").alias("_j"), F.col("old_shard").alias("_o"), F.col("_class").alias("_c"), F.col("_sub").alias("_s"), "_first", before.alias("_before"))
    out = dealt.join(F.broadcast(parts), here & (F.col("shard") == F.col("_j")))  # parts: blocks and cuts
    slot = (F.col("_before") + F.col("_rn") - F.col("_first")).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", (F.col("shard") != F.col("old_shard")).alias("moved"), "_row")


def rewrite(docs: DataFrame, path: str, new_shards: int, old_shards: int, old_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", sub_blocks: int | None = None) -> list[int]:
    """Reshard docs and write the shards that gained or lost a row under path, a folder _shard=N each, in order of slots; folders of other shards stay as they are. Returns the numbers of the shards written.

    Every row of docs in such a shard is written once, whatever its doc_id: rows are numbered in a table before they are placed.
    """
    own = materialize(docs.select(*_sized(docs, old_shards, old_col, id_col, text_col), boxed(docs)), "rows")
    placed = materialize(_dealt(own, new_shards, old_shards, sub_blocks).select(F.col("_row").alias("_r"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), "old_shard", "moved"), "placed")
    touched = sorted(r[0] for r in placed.filter("moved").select(F.explode(F.array("_shard", "old_shard"))).distinct().collect())  # at most all shards
    here = placed.filter(F.col("_shard").isin(touched)).select("_r", "_shard", "_slot")
    out = own.select("_row", "_box").join(here, F.col("_row") == F.col("_r")).select("_box", "_shard", "_slot")
    # several writers for each shard, in order of slots, so no task holds a whole shard
    out = out.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    out = out.select(*[F.col("_box").getField(c).alias(c) for c in docs.columns], "_shard")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_shard").parquet(path)
    return touched
