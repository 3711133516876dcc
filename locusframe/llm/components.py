"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Returns (node, root): every node of ``edges`` (bigint columns ``a`` and ``b``) and the least node it reaches.

    Each round links every node's larger neighbours to its least neighbour (large star), then its smaller
    ones (small star), until the table no longer changes: about log2(n) squared rounds at most. Nothing is collected
    but a count and a checksum.
    Both steps join a node's least neighbour, found by a partial aggregation and written before, so that a
    node with very many neighbours can be split over tasks. Nulls and self-links are dropped.
    """
    now = written(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    # No table of a round has more rows than two for each link.
    n, mark = 2 * now.count(), None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = written(large.where("hi != lo").distinct(), n)
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")), n)
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = written(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), n)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select("lo", "lo").distinct()
    )
