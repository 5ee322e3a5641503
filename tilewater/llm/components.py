"""Connected components of an edge table by alternating large and small stars, one table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewater.llm.common import stored, unstored


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count("*"), F.sum((h.bitwiseAND((1 << 31) - 1)).cast("decimal(38,0)")), F.bit_xor(h)).first()
    return tuple(r)


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every end of `edges` (a, b, of one orderable type): root is the smallest node that is reachable.

    Nulls, loops and repeated edges are ignored. Each star is a minimum (combined before the shuffle) and a join on the node, which
    AQE splits where a node has many edges; no list of neighbours is ever gathered. Rounds go on until nothing changes. A round reads
    its edges from a table, whose files share tasks, and has no union, which would double the tasks of its stages; the round before is removed.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(e)
    while before[0]:
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(least, "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # the row of the minimum itself keeps its node linked to it
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, e = e, stored(small.distinct())
        unstored(last)
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
