"""Connected components of a distributed edge list, by alternating large-star and small-star rounds.

Every round is a fixed set of shuffles and ends in a table in the shared folder; the number of rounds grows
with the logarithm of the longest chain. The least neighbour of each node is counted map-side first and is a table of its own before it is
joined, so that adaptive execution can split the edges of a hub, of which one may have very many: its one row goes to each part.

Defined cases: null ends link nothing; repeated edges and loops count once and not at all; without edges the result is
empty; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: u, v (long). Returns node, root for every node but the roots themselves; root is the smallest node reachable."""
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = _digest(now)
    for _ in range(max_rounds if last[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        low = materialize(low, "least")
        large = both.filter("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        tied = large.join(low.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = materialize(tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = _digest(now)
        if new == last:
            break
        last = new
    else:
        if last[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
