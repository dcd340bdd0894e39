"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: So many edges are joined on the driver (two longs each); more are contracted in Spark, with the same result.
DRIVER_EDGES = 500_000


def roots(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, root) of every node that occurs in ``edges`` (u, v): its component's smallest node.

    Loops and repeated edges change nothing; no edges give no rows.
    """
    spark = edges.sparkSession
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])
    if edges.count() <= driver_edges:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for u, v in edges.toLocalIterator():
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        return spark.createDataFrame([(x, find(x)) for x in sorted(up)], schema)
    before = None
    while True:
        # large star: neighbours above a node join the least of its neighbourhood; small star: those below, and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select("v", "v").distinct().toDF("node", "root"))
