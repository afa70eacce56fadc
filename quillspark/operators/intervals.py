"""Points in ranges, by bins whose width follows the range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits by which bins of one level are wider than those of the level below; a range covers few bins.
STEP = 2
#: Points of a bin from which they are divided, and the most parts.
HOT, PARTS = 100_000, 1024


def _level(a: Column, b: Column) -> Column:
    """The least level whose bins are as wide as the range: it touches two of them at most."""
    width = (b - a + 1).cast("double")
    return (F.ceil(F.ceil(F.log2(width)) / STEP) * STEP).cast("int")


def join_ranges(points: DataFrame, ranges: DataFrame, n: str = "n", a: str = "a", b: str = "b") -> DataFrame:
    """Points (n, …) with each of the ranges (a, b, …) around them, both ends included; columns of the
    two must differ.

    A range is put into the one or two bins of its level that it touches, a point into one bin of each
    level there is, so rows grow with points, ranges and matches and not with the ranges' width.
    Points of a bin of more than ``HOT`` are divided, its ranges repeated.  Null ends or points are in
    nothing; a range whose ends are the wrong way round is empty."""
    whole = ranges.where(F.col(a).cast("bigint") <= F.col(b).cast("bigint"))
    lo, hi = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    binned = whole.withColumn("_level", _level(lo, hi))
    binned = binned.withColumn("_bin", F.explode(F.expr(f"array_distinct(array(shiftright(cast(`{a}` as bigint), _level), shiftright(cast(`{b}` as bigint), _level)))")))
    levels = sorted(r["_level"] for r in binned.select("_level").distinct().collect())  # 32 at most
    put = points.where(F.col(n).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    put = put.withColumn("_bin", F.expr(f"shiftright(cast(`{n}` as bigint), _level)"))
    there = binned.select("_level", "_bin").distinct()
    hot = put.join(there, ["_level", "_bin"], "left_semi").groupBy("_level", "_bin").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT)
    hot = hot.select("_level", "_bin", F.least(F.lit(PARTS), F.ceil(F.col("_n") / HOT)).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    left = put.join(hot, ["_level", "_bin"], "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), parts)).drop("_parts")
    right = binned.join(hot, ["_level", "_bin"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint")))).drop("_parts")
    return left.join(right, ["_level", "_bin", "_part"]).where((F.col(n) >= F.col(a)) & (F.col(n) <= F.col(b))).drop("_level", "_bin", "_part")
