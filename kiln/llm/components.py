"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """pairs: (u, v). Each u links its neighbours to the least of them and itself: the larger ones, or (small) the smaller ones and u."""
    own = pairs.filter("v < u") if small else pairs
    least = own.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = C.spread_join(own, least, "u", by="v")  # a hub may have a third of all nodes
    if small:
        out = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.filter("u <> m").select("u", F.col("m").alias("v"))
        )
    else:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) for every node of an edge; label is the least node reachable. Self-loops and repeated edges are harmless.

    Edges stay distributed; each round is written to the shared folder, so lineage stays short. The number of rounds
    grows with the logarithm of the longest path. No edges: no rows.
    """
    now = C.materialise(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(),
        "edges",
        narrow=True,
    )
    before = None
    while True:
        sign = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if sign == before or sign[0] == 0:
            break
        before, old = sign, now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, small=False)
        now = C.materialise(_star(large, small=True), "edges", narrow=True)
        C.discard(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
