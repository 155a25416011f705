"""Connected components of a distributed edge table by alternating star contractions (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, join_splittable, write_stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long, any order, repeats and loops allowed) -> (node, root), root the least node reachable.

    Nodes that have no edge to another node are not in the result. An empty table gives an empty table.
    A node's edges needn't meet in one task: minima are partial aggregates, and both sides of the joins are dealt anew by the
    node, so that the engine can split those of a node with very many.
    Each round is written to the shared folder, so a lost executor never costs more than one round.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path, before = write_stored(edges, "stars"), None
    for _ in range(max_rounds):
        e = spark.read.parquet(path)
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_splittable(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_splittable(large, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = write_stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        drop_stored(spark, path)
        path = new
    else:
        raise RuntimeError("components did not settle")
    return spark.read.parquet(path).select(F.col("u").alias("node"), F.col("v").alias("root"))
