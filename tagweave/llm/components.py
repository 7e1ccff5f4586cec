"""Connected components of a graph by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for each end of an edge (a, b); the label is the least id of the component.

    Large-star links the larger neighbours of each vertex to its least neighbour, small-star the
    smaller ones; repeated until nothing changes (a logarithmic number of rounds
    in practice). Minima are combined before the shuffle, and a vertex with very many
    edges is only joined, which Spark can split.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
