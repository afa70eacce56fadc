"""Look-ups in a numbered line table (n, text, motifs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ready(lines: DataFrame, least: int = 100) -> bool:
    return lines.limit(least).count() >= least


def opening(lines: DataFrame, n: int) -> DataFrame:
    return lines.where(F.col("n") <= max(1, n))


def between(lines: DataFrame, a: int, b: int) -> DataFrame:
    a, b = sorted((a, b))
    return lines.where(F.col("n").between(max(1, a), b))


def single(lines: DataFrame, n: int) -> DataFrame:
    return lines.where(F.col("n") == n)


def chosen(lines: DataFrame, numbers: DataFrame) -> DataFrame:
    """Lines whose number is in numbers (n)."""
    return lines.join(numbers.select("n"), "n", "left_semi")


def couplet_of(couplets: DataFrame, n: int) -> DataFrame:
    return couplets.where(F.lit(n).between(F.col("start"), F.col("end")))


def answers(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """requests (query_id, kind, a, b) with their lines: (query_id, n, text).

    Every request is unfolded to its line numbers, within the table, and equi-joined: a batch of
    any size is one join."""
    last = lines.agg(F.coalesce(F.max("n"), F.lit(0)).alias("_last"))
    r = requests.crossJoin(F.broadcast(last))  # one row
    low = F.when(F.col("kind") == "opening", F.lit(1)).when(F.col("kind") == "range", F.greatest(F.lit(1), F.least("a", "b"))).otherwise(F.col("a"))
    high = F.when(F.col("kind") == "opening", F.greatest(F.lit(1), F.least("a", "_last"))).when(F.col("kind") == "range", F.least(F.greatest("a", "b"), F.col("_last"))).otherwise(F.col("a"))
    numbers = F.when(F.col("kind") == "compare", F.array(F.col("a"), F.col("b"))).when(low <= high, F.sequence(low.cast("bigint"), high.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return r.select("query_id", F.explode(F.array_distinct(numbers)).alias("n")).join(lines.select(F.col("n").cast("bigint").alias("n"), "text"), "n").select("query_id", "n", "text")


def displayed(rows: DataFrame) -> DataFrame:
    """(query_id, answer): lines as ``%4d: text``, joined in order."""
    line = F.format_string("%4d: %s", "n", "text")
    parts = rows.withColumn("line", line).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))
    return parts.select("query_id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("answer"))


def motif_overview(ranges: DataFrame) -> DataFrame:
    return ranges.select(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")).alias("range"), "motif")
