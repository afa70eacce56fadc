"""Document fingerprints: SimHash, and a search of all fingerprints within a Hamming radius.

Terms are five-word shingles (a text of fewer words is one term) weighted 1 + ln(count), rounded to
a whole number of 128ths.  Each term's 128-bit hash votes on every bit with its weight as sign; the
sign of the sum is the bit.  Sums are exact, so equal texts agree on any machine.
The search keeps permuted block tables: fingerprints are cut into blocks, and for every choice of
all but ``radius`` blocks one table is keyed by the chosen ones.  Two fingerprints that differ in
at most ``radius`` bits leave that many blocks equal, so they meet in a table: nothing is missed.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textvec as tv
from quillspark.llm.common import Scratch, shuffle_partitions, written

BITS = 128
SHINGLE = 5
#: Bits that fingerprints may differ in, and blocks that they are cut into: four tables of 32 bits.
RADIUS = 3
BLOCKS = 4
#: Terms whose votes are held at once: sums of so many weights under 4,096 are exact in 24 bits.
TERMS = 4096
#: Rows of a bucket that one task compares with the bucket's queries, and rows that are broadcast.
BUCKET, BROADCAST_ROWS = 50_000, 200_000
_U = np.uint64


def fingerprints(col: pa.Array) -> np.ndarray:
    """(rows, 16) bytes; equal texts have equal rows, a text without words has all zeros."""
    out = np.zeros((len(col), BITS // 8), np.uint8)
    for w in tv.pieces(col):
        bag = tv.shingles(w, SHINGLE)
        weight = np.round(128 * (1 + np.log(bag.count))).astype(np.float32)
        with np.errstate(over="ignore"):
            wide = np.stack([bag.hash, tv.mix(bag.hash ^ _U(0x94D049BB133111EB))], axis=1).view(np.uint8)
        for i in np.flatnonzero(np.diff(bag.ptr)).tolist():
            votes = np.zeros(BITS)
            for at in range(bag.ptr[i], bag.ptr[i + 1], TERMS):
                part = slice(at, min(at + TERMS, bag.ptr[i + 1]))
                votes += weight[part] @ np.unpackbits(wide[part], axis=1).astype(np.float32)
            out[w.first + i] = np.packbits(2 * votes > weight[bag.ptr[i] : bag.ptr[i + 1]].sum(dtype=np.float64))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def with_fingerprint(docs: DataFrame, *, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with a column of 32 hex digits (replaced if it is there); nulls count as empty."""
    names = [c for c in docs.columns if c != name]
    out = docs.select(*names).withColumn(name, F.lit(""))

    def run(batches):
        for batch in batches:
            found = pa.array(_hex(fingerprints(batch.column(names.index(text)))), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), found], [*names, name])

    return out.mapInArrow(run, out.schema)


def _tables(fingerprint: str, radius: int, blocks: int):
    step = BITS // 4 // blocks
    cut = [F.substring(fingerprint, 1 + step * k, step) for k in range(blocks)]
    return [F.concat_ws("", *[cut[k] for k in chosen]) for chosen in combinations(range(blocks), blocks - radius)]


def _distance(a: str, b: str):
    half = lambda c, at: F.conv(F.substring(c, at, 16), 16, -10).cast("bigint")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 17).bitwiseXOR(half(b, 17)))


def search(queries: DataFrame, index: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS, fingerprint: str = "fingerprint") -> DataFrame:
    """(fingerprint, near, distance): every distinct indexed fingerprint within ``radius`` bits of
    a distinct query fingerprint, itself included.

    Both sides are reduced to distinct fingerprints first, so copies aren't expanded; join the
    result back on the fingerprint.  Null fingerprints find and are found by nothing.  ``blocks``
    must divide 32 hex digits and exceed ``radius``; more blocks make more tables of longer keys.
    """
    if not radius < blocks or (BITS // 4) % blocks:
        raise ValueError("blocks must exceed radius and divide 32")

    def keyed(side: DataFrame, name: str) -> DataFrame:
        one = side.select(F.col(fingerprint).alias(name)).where(F.col(name).isNotNull()).distinct()
        return one.select(name, F.posexplode(F.array(*_tables(name, radius, blocks))).alias("table", "key"))

    met = keyed(queries, "fingerprint").join(keyed(index, "near"), ["table", "key"])
    same = F.array(*[a == b for a, b in zip(_tables("fingerprint", radius, blocks), _tables("near", radius, blocks))])
    first = F.array_position(same, F.lit(True)) - 1  # a pair counts in the first table it meets in
    return met.withColumn("distance", _distance("fingerprint", "near")).where(F.col("distance") <= radius).where(first == F.col("table")).select("fingerprint", "near", F.col("distance").cast("int").alias("distance"))


def _near_counts(radius: int, blocks: int):
    """Counts of neighbours within a bucket: rows (key, part, table, fingerprint, asked) in order of
    key and part give (fingerprint, n_near) for each query."""
    width = BITS // 8 // blocks
    tables = list(combinations(range(blocks), blocks - radius))

    def counts(group: pa.Table):
        all_of = np.frombuffer(b"".join(group.column("fingerprint").to_pylist()), np.uint8).reshape(-1, BITS // 8)
        table = group.column("table").to_numpy()
        asked = np.flatnonzero(group.column("asked").to_numpy(zero_copy_only=False))
        own = np.flatnonzero(group.column("own").to_numpy(zero_copy_only=False))
        halves, cut = all_of.copy().view(np.uint64), all_of.reshape(-1, blocks, width)
        for i in asked.tolist():
            distance = np.bitwise_count(halves[own] ^ halves[i]).sum(axis=1)
            near = own[(distance <= radius) & (distance > 0) & (table[own] == table[i])]
            if len(near):
                same = (cut[near] == cut[i]).all(axis=2)
                # A pair counts in the first table whose blocks it shares, where keys can't collide.
                first = np.argmax(np.stack([same[:, list(t)].all(axis=1) for t in tables], axis=1), axis=1)
                shares = same[:, list(tables[table[i]])].all(axis=1)
                n = int((shares & (first == table[i])).sum())
                if n:
                    yield all_of[i].tobytes(), n

    def run(batches):
        held, last = [], None

        def done():
            found = list(counts(pa.Table.from_batches(held))) if held else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["fingerprint", "n_near"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            ends = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(ends, ends[1:]):
                if held and tuple(keys[a]) != last:
                    yield from done()
                    held.clear()
                last = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        yield from done()

    return run


def near_counts(rows: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS, fingerprint: str = "fingerprint", asked: str = "asked") -> DataFrame:
    """(fingerprint, n_near) of each distinct fingerprint of a row with ``asked``: how many other
    distinct fingerprints of the whole table differ from it in at most ``radius`` bits; those with
    none are left out.

    Block tables bring candidates together; only buckets of several with a query go on.  A large
    bucket is dealt into parts that all its queries visit, so pairs are never rows and no task
    holds a whole bucket.  Null fingerprints count nowhere; copies count once.
    """
    if not radius < blocks or (BITS // 8) % blocks:
        raise ValueError("blocks must exceed radius and divide 16")
    hexed = rows.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("f")).agg(F.max(F.coalesce(F.col(asked), F.lit(False))).alias("asked"))
    one = written(hexed, "distinct")
    keys = F.array(*[F.xxhash64(F.lit(k), t) for k, t in enumerate(_tables("f", radius, blocks))])
    keyed = one.select(F.unhex("f").alias("fingerprint"), "asked", F.posexplode(keys).alias("table", "key"))
    buckets = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("asked").alias("any")).where("n > 1 and any").select("key", F.ceil(F.col("n") / BUCKET).alias("parts")), "near")
    few = F.broadcast if buckets.count() <= BROADCAST_ROWS else (lambda d: d)
    met = keyed.join(few(buckets), "key").withColumn("home", F.pmod(F.xxhash64("fingerprint"), F.col("parts")))
    # A query goes to every part, other rows to one; ``own`` rows of a part are those compared with.
    met = met.withColumn("part", F.explode(F.when(F.col("asked"), F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array("home"))))
    dealt = met.select("key", "part", "table", "fingerprint", "asked", (F.col("part") == F.col("home")).alias("own")).repartition("key", "part").sortWithinPartitions("key", "part")
    found = dealt.mapInArrow(_near_counts(radius, blocks), "fingerprint binary, n_near bigint")
    return found.groupBy(F.lower(F.hex("fingerprint")).alias(fingerprint)).agg(F.sum("n_near").alias("n_near"))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


LEAVES = 256


def _ranges(docs: DataFrame, n: int):
    """Column giving the ascending range, of about ``n``, that an id falls into: quantiles cut the
    ids into leaves, equal widths cut each leaf again; null ids are in the first."""
    seen = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if seen[0] is None:
        return F.lit(0)
    leaves = min(n, LEAVES)
    cuts = docs.where("doc_id is not null").stat.approxQuantile("doc_id", [k / leaves for k in range(1, leaves)], 0.2 / leaves) if leaves > 1 else []
    lows = sorted({int(seen[0]), *(int(x) for x in cuts if x > seen[0])})
    widths = [hi - lo for lo, hi in zip(lows, [*lows[1:], int(seen[1]) + 1])]
    parts = -(-n // len(lows))

    def tree(lo: int, hi: int):
        if hi - lo == 1:
            inner = F.floor((F.col("doc_id") - lows[lo]).cast("double") * parts / widths[lo])
            return F.lit(lo * parts) + F.least(F.greatest(inner, F.lit(0)), F.lit(parts - 1))
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < lows[mid], tree(lo, mid)).otherwise(tree(mid, hi))

    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(tree(0, len(lows))).cast("int")


def with_next(docs: DataFrame, fn, schema: str, *, partitions: int | None = None) -> DataFrame:
    """Apply ``fn(ids, texts, next_texts)`` over (doc_id, text) in ascending order of id.

    Ids are cut into ranges; a range also gets the first row of the following one, so that its
    last row sees its successor.  Texts are shuffled once and every range is streamed in sorted
    order: a task holds one batch at a time, and the driver one id for each range.  Nulls sort
    first; equal ids are ordered by text; the last row is followed by the first one.
    """
    spark = docs.sparkSession
    n = partitions or 4 * shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", _ranges(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), n))
    heads = sorted((r[0], r[1]) for r in rows.where("doc_id is not null").groupBy("bucket").agg(F.min("doc_id")).collect())
    least = rows.orderBy("doc_id", "text").limit(1).select("doc_id", "text", F.lit(heads[-1][0] if heads else 0).alias("bucket"))
    tails = least
    if len(heads) > 1:
        jumps = F.broadcast(spark.createDataFrame([(b[1], a[0]) for a, b in zip(heads, heads[1:])], "doc_id bigint, bucket int"))
        tails = tails.union(rows.drop("bucket").join(jumps, "doc_id").groupBy("doc_id", "bucket").agg(F.min("text").alias("text")).select("doc_id", "text", "bucket"))
    both = rows.withColumn("tail", F.lit(0)).union(tails.withColumn("tail", F.lit(1)))
    both = both.repartition(max(1, min(n // 4, len(heads))), "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")

    def run(batches):
        held = None  # the row that waits for its successor
        for batch in batches:
            ids, texts, nexts = [], [], []
            for doc, text, tail in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                if held is not None:
                    ids.append(held[0])
                    texts.append(held[1])
                    nexts.append(text)
                held = None if tail else (doc, text)
                if len(ids) == ROWS_AT_ONCE:
                    yield fn(ids, texts, nexts)
                    ids, texts, nexts = [], [], []
            if ids:
                yield fn(ids, texts, nexts)

    return both.select("doc_id", "text", "tail").mapInArrow(run, schema)


ROWS_AT_ONCE = 512


#: Every row whose id this divides is a query of the search.
EVERY = 20


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, the likenesses of a text's fingerprint to its
    edited text's (``near_edited``) and to the next document's (``near_next``), and for ids divisible by
    ``EVERY`` in ``n_near`` how many other distinct fingerprints of the table stand within the
    radius; null for others.

    A null text is empty; a text without words has a fingerprint of zeros.  Null ids sort first and
    ask nothing; rows that repeat an id follow each other in order of their texts; a single row
    follows itself; other columns are left out; an empty table gives no rows."""

    def fn(ids, texts, nexts):
        changed = [edited(a, b) for a, b in zip(texts, nexts)]
        own, new, following = (fingerprints(pa.array(x, pa.large_string())) for x in (texts, changed, nexts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array(_hex(own), pa.string()), pa.array(_hex(new), pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, following)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(written(with_next(docs, fn, schema), "fingerprints")).withColumn("asked", F.coalesce(F.col("doc_id") % EVERY == 0, F.lit(False)))
        near = scratch.keep(written(near_counts(rows), "counts"))
    few = F.broadcast if near.count() <= BROADCAST_ROWS else (lambda d: d)
    names = [x.split()[0] for x in schema.split(", ")]
    asked = rows.where("asked").select(*names).join(few(near), "fingerprint", "left").select(*names, F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"))
    return asked.unionByName(rows.where("not asked").select(*names, F.lit(None).cast("bigint").alias("n_near")))
