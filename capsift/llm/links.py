"""Connected components of an edge table, by rounds of joins in which every edge moves toward the smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsift.llm.common import stored

MAX_ROUNDS = 60


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``u, v`` (long, any order) -> ``node, root``: the smallest node that each node reaches.

    Alternates two steps until nothing changes.  Large star: a node hands its larger
    neighbours to the smallest of its neighbours and itself.  Small star: it hands over
    itself and its smaller neighbours.  Both keep components whole and end in stars.  The
    minimum per node is combined before it is shuffled, and the join back is a plain join
    of two shuffled sides, which adaptive execution splits where a node is a hub.
    """
    current = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder, "edges0")
    state = _state(current)
    for number in range(1, MAX_ROUNDS + 1):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), folder, f"low{number}")
        large = both.join(lowest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), folder, f"large{number}")
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m")), folder, f"least{number}")
        small = large.join(lowest, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v")))
        current = stored(small.filter("u <> v").distinct(), folder, f"edges{number}")
        before, state = state, _state(current)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Three totals that tell one edge table from the next."""
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.hash("u", "v")), F.lit(0))).first()
    return tuple(row)
