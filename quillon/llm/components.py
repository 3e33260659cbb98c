"""Connected components by alternating large and small stars, on edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import shared_checkpoints, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node it is joined to.

    Each round groups by node with map-side minima and joins the minimum back, so a hub of any
    degree is only ever one aggregate row and a splittable join. Rounds end when no edge changes.
    Loops, repeated edges and nulls on a side are harmless; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    shared_checkpoints(spark)
    # written once: every round reads its edges several times
    e = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    nodes_alone = e.where("u = v").select("u", "v")
    e = e.where("u <> v")

    def stars(e: DataFrame, large: bool) -> DataFrame:
        """large: each neighbour above a node is tied to the node's minimum; small: those below it and itself."""
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        # written, so that both sides of the join are plain exchanges and a hub's edges can be split over tasks
        least = stored(sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u", "m").alias("m")))
        j = sym.join(least, F.col("u") == F.col("u2"))
        if large:
            out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        return out.where("u <> v").distinct()

    seen = None
    for _ in range(most):
        e = stored(stars(stars(e, True), False))
        now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.select("u", "v").unionByName(roots).unionByName(nodes_alone).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))
