"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.plans.storage import materialize, scratch

#: Edges that a file of a round's table may hold, so that few edges don't make a file for every shuffle partition.
FILE_EDGES = 20_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str, rounds: int = 64) -> DataFrame:
    """(node, root) for each node that has an edge; root is the smallest node that it reaches.

    Each round hangs every neighbour on the smallest one, so path lengths fall
    geometrically; rows stay linear in the edges and each round's table is written to
    the shared folder, in as many files as its counted edges fill. Self loops, repeated
    edges, nulls and empty tables are accepted: an edge with a null end or equal ends links
    nothing.
    """
    with scratch(edges.sparkSession) as put:
        e = put(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
        state = _state(e)
        for _ in range(rounds):
            if not state[0]:
                break
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u")
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
            # a round makes at most one edge of each end and each edge before
            e = put(small.coalesce(2 * state[0] // FILE_EDGES + 1), "links")
            before, state = state, _state(e)
            if state == before:
                break
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return materialize(out.coalesce(2 * state[0] // FILE_EDGES + 1), "components")
