"""Connected components of an edge table, in DataFrame operations only.

Alternating large-star and small-star steps: each vertex links its larger (or smaller)
neighbours to the smallest one it knows.  A step is one aggregation that combines before its
shuffle and one equi-join that may be split where a hub is hot; no vertex's neighbours are
gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import dropped, shuffle_partitions, written

#: Edges that one file of a step holds about.
FILE_EDGES = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b), each pair in one direction with a > b."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return joined.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; ``component`` is the least node it reaches.

    Edges with a null end, self-loops and repeated edges change nothing.  Ends must be bigint.
    """
    now = written(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(),
        "edges",
    )
    seen = _digest(now)
    while seen[0]:
        files = min(shuffle_partitions(edges.sparkSession), 1 + 2 * seen[0] // FILE_EDGES)
        step = written(_star(_star(now, True), False).coalesce(files), "edges")
        after = _digest(step)
        dropped(now)
        now = step
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
