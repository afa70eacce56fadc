"""Sharding by extendible hashing, in DataFrame operations only.

A row's key hash is a string of bits.  The directory is indexed by hash prefixes: a bucket whose
bytes exceed the limit splits on one more bit, all others stay, until every shard fits.  Buckets
come from a histogram of prefixes some bits finer than the expected depth; only prefixes that are
too large even there are counted again with more bits.  Rows look their bucket up by a prefix about
as long as the buckets are many, so the directory that is broadcast has a row for each bucket or two,
and texts are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, written

#: Bytes of text that a shard holds at most.
SHARD_BYTES = 64 << 20
#: Hash bits in all, and how many finer than the expected depth a histogram is.
BITS, FINER = 60, 4
#: Buckets up to which the directory is broadcast, some 100 bytes each: 100 TB in shards of 64 MiB.
BROADCAST_BUCKETS = 3_000_000
#: Shards' worth of bytes that one task numbers in a bucket that bits can't split.
RUN = 8


def key_bits(key: Column) -> Column:
    """The first 60 bits of the key's md5 as a bigint; a null key counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits.cast("int"))


def _level(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, bytes, depth, prefix, bucket_bytes): each ``high``-bit cell's shallowest prefix of at
    least ``low`` bits that fits; nulls where none does."""
    deep = cells.select("cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "bytes")
    deep = deep.withColumn("prefix", _right(F.col("cell"), F.lit(high) - F.col("depth")))
    fits = deep.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bucket_bytes")).where(F.col("bucket_bytes") <= limit)
    best = deep.drop("bytes").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "bucket_bytes"), "depth").alias("b"))
    return cells.join(best, "cell", "left").select("cell", "bytes", "b.depth", "b.prefix", "b.bucket_bytes")


def _buckets(level: DataFrame) -> DataFrame:
    return level.where("depth is not null").select("depth", "prefix", "bucket_bytes").distinct()


def directory(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(depth, prefix, bucket_bytes) of all buckets of ``rows`` (bits, bytes).

    Every prefix of fewer bits than the first histogram's is tried on that histogram's coarser
    sums.  A bucket of all bits may exceed the limit: one hash that bits cannot split."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth = 0 if total <= limit else math.ceil(math.log2(total / limit))
    low, high = max(0, depth - FINER), min(BITS, depth + FINER) if depth else 0
    found = None
    while True:
        cells = written(rows.groupBy(F.shiftright("bits", BITS - high).alias("cell")).agg(F.sum("bytes").alias("bytes")), "cells")
        level = written(_level(cells, low, high, limit), "directory")
        if found is None and low:  # the first histogram: a prefix that fits at its least depth may be part of a shallower one
            top = level.groupBy(F.shiftright("cell", high - low).alias("cell")).agg(F.sum("bytes").alias("bytes"))
            shallow = written(_buckets(_level(top, 0, low, limit)), "directory")
            found = shallow.unionByName(_buckets(level.where(F.col("depth") > low)))
        else:
            found = _buckets(level) if found is None else found.unionByName(_buckets(level))
        over = level.where("depth is null")
        if not over.limit(1).count():
            return found
        if high == BITS:
            return found.unionByName(over.select(F.lit(BITS).alias("depth"), F.col("cell").alias("prefix"), F.col("bytes").alias("bucket_bytes")))
        rows = rows.join(over.select("cell"), F.shiftright("bits", BITS - high) == F.col("cell"), "left_semi")
        low, high = high + 1, min(BITS, high + 2 * FINER)


def _looked_up(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (row, n_bytes, bits) and their ``depth``, ``prefix``, ``shard_bytes``."""
    n = buckets.count()
    bits = max(0, math.ceil(math.log2(max(n, 1))) - 1)
    # A bucket shallower than the keys is under several of them, as many as there are buckets in all.
    away = F.lit(bits) - F.col("depth")
    left = lambda x: F.call_function("shiftleft", x, F.greatest(away, F.lit(0)).cast("int"))
    keys = F.when(away > 0, F.sequence(left(F.col("prefix")), left(F.col("prefix") + 1) - 1)).otherwise(F.array(_right(F.col("prefix"), F.greatest(-away, F.lit(0)))))
    # Hashes are uniform, so a key has few buckets, and a path of 60 at most where one hash is hot.
    table = buckets.select(F.explode(keys).alias("key"), F.struct("depth", "prefix", "bucket_bytes").alias("b")).groupBy("key").agg(F.collect_list("b").alias("under"))
    hint = F.broadcast if n <= BROADCAST_BUCKETS else (lambda d: d)
    met = rows.join(hint(table), F.shiftright("bits", BITS - bits) == F.col("key"), "left")
    own = F.element_at(F.filter("under", lambda b: _right(F.col("bits"), F.lit(BITS) - b["depth"]) == b["prefix"]), 1)
    return met.withColumn("b", own).select(*rows.columns, "b.depth", "b.prefix", F.col("b.bucket_bytes").alias("shard_bytes"))


def _numbered(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of buckets that bits cannot split, dealt by running bytes.

    A row over half the limit is a shard of its own; the others fill shards whose running bytes
    cross no half limit, so these fit.  A hot bucket is first dealt into runs of some shards each.
    """
    runs = F.ceil(F.col("shard_bytes") / (limit * RUN))
    # Written once: names and sums must see the same numbers, whatever is computed again.
    rows = written(rows.withColumn("n", F.monotonically_increasing_id()), "numbered").withColumn("run", F.pmod(F.xxhash64("n"), runs))
    rows = rows.withColumn("single", F.col("n_bytes") > limit // 2)
    order = Window.partitionBy("prefix", "run", "single").orderBy("n")
    part = F.when(F.col("single"), F.concat(F.lit("s"), F.row_number().over(order))).otherwise(F.concat(F.lit("r"), F.floor((F.sum("n_bytes").over(order) - F.col("n_bytes")) / F.lit(limit // 2))))
    named = rows.withColumn("shard", F.concat_ws("-", "shard", "run", part))
    sums = named.groupBy("shard").agg(F.sum("n_bytes").alias("sum"))
    return named.join(sums, "shard").withColumn("shard_bytes", F.col("sum")).drop("sum", "n", "run", "single")


def shard(docs: DataFrame, *, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8 bytes of the text, null 0), ``depth``, ``shard`` (the hash
    prefix as ``depth`` binary digits, ``*`` at depth 0) and ``shard_bytes``.

    No shard exceeds ``limit`` but one of a single larger row.  Rows with equal keys share a hash;
    a bucket that they overfill is divided by running bytes and its name extended.  Columns of
    these names in ``docs`` are replaced; null ids, null texts and empty tables are allowed.
    """
    made = ("n_bytes", "depth", "shard", "shard_bytes")
    kept = [c for c in docs.columns if c not in made]
    row = F.struct(*[F.col(c) for c in kept])  # whatever the columns' names, none meets one of this module
    keyed = docs.select(row.alias("row"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), key_bits(F.col(doc_id)).alias("bits"))
    with Scratch(docs.sparkSession) as scratch:
        sizes = written(keyed.groupBy("bits").agg(F.sum("n_bytes").alias("bytes")), "sizes")
        buckets = scratch.keep(written(directory(sizes, limit), "buckets"))
    digits = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    out = _looked_up(keyed, buckets).withColumn("shard", digits)
    if buckets.where(F.col("bucket_bytes") > limit).limit(1).count():
        out = out.where(F.col("shard_bytes") <= limit).unionByName(_numbered(out.where(F.col("shard_bytes") > limit), limit))
    return out.select("row.*", *made)
