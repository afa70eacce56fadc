"""Centroid clustering by weighted deduplication: Lloyd's rounds over distinct quantised vectors.

Components become integers, equal vectors one row with its multiplicity, and every sum, distance
and mean is a whole number, so a run on any number of machines gives the same centroids.  A round
reads the distinct vectors once; a task returns one weighted sum for each centroid's component.  The
last assignment is joined back to the rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, heavy_keys, joined_on, written

#: Components of a vector, steps to a unit, clusters, rounds.
WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Quantised components lie within this, so that squared distances of 64 of them fit in 63 bits.
MOST = 1 << 27
#: Rows that meet the centroids at once in a task.
STEP = 4096


def usable(vector: Column, width: int = WIDTH) -> Column:
    """Whether a vector has ``width`` components, none of them null or not finite."""
    return F.coalesce((F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Whole numbers floor(scale * x); a component beyond ``MOST`` is an error that names the limit,
    since distances would no longer fit in 63 bits."""

    def whole(x: Column) -> Column:
        y = F.floor(x.cast("double") * float(scale))
        return F.when(F.abs(x.cast("double")) * float(scale) < float(MOST), y.cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {MOST}")).cast("int"))

    return F.transform(vector, whole)


def seed_key(vec_id: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))).cast("binary"), 256)


@dataclass
class Clusters:
    """Distinct vectors (q, n, cluster, distance) and the final centroids."""

    distinct: DataFrame
    centroids: np.ndarray
    rounds: int


def _nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; ties go to the smaller number.

    Where every product and sum stays below 2**53 it is made in doubles, which are exact there."""
    most = int(max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)))
    if v.shape[1] * 4 * most * most < 1 << 53:
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        d = ((x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        d = np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)
    own = np.argmin(d, axis=1)
    return own, d[np.arange(len(v)), own]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _summer(spread, width: int):
    """A task's sums (cluster, j, s) over its distinct vectors; component -1 is the number of rows."""

    def run(batches):
        centroids = spread.value
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                v, weight = _rows(part.column(0), width), np.asarray(part.column(1), np.int64)
                own, _ = _nearest(v, centroids)
                for c in np.unique(own):
                    mine = own == c
                    n[c] += weight[mine].sum()
                    sums[c] += (v[mine] * weight[mine, None]).sum(0)
        some = np.flatnonzero(n)
        both = np.concatenate([n[:, None], sums], 1)[some]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, width + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, width, dtype=np.int32), len(some))), pa.array(both.ravel())], ["cluster", "j", "s"])

    return run


def _assigner(spread, width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                own, d = _nearest(_rows(part.column(0), width), spread.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.astype(np.int32)), pa.array(d)], ["q", "n", "cluster", "distance"])

    return run


def lloyd(distinct: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> Clusters:
    """Rounds over distinct (q, n): assign, then replace each centroid that has vectors by the floor
    of their mean.  Centroids that stand still would stay so, so the rounds end there.

    Only the sums of each centroid reach the driver, added up exactly, in decimals."""
    context, centroids = distinct.sparkSession.sparkContext, start
    width, done = start.shape[1], 0
    for done in range(1, rounds + 1):
        spread = context.broadcast(centroids)
        parts = distinct.select("q", "n").mapInArrow(_summer(spread, width), "cluster int, j int, s bigint")
        total = {(r["cluster"], r["j"]): int(r["s"]) for r in parts.groupBy("cluster", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each component of a centroid
        moved = centroids.copy()
        for c in {c for c, _ in total}:
            moved[c] = [total[c, j] // total[c, -1] for j in range(width)]
        spread.unpersist()
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    spread = context.broadcast(centroids)
    return Clusters(distinct.select("q", "n").mapInArrow(_assigner(spread, width), "q array<int>, n bigint, cluster int, distance bigint"), centroids, done)


def cluster(embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector.

    Null vectors, those of another length and those with a component that is null or not finite take
    no part.  A null id is seeded as an empty one; rows that repeat an id or a vector are rows of
    their own, each weighs in the means and gets its row.  Equal seeding hashes are ordered by vector.
    Fewer than ``clusters`` vectors give as many clusters; of equal centroids the one of the smaller
    number gets all.  An empty table gives an empty result; other columns aren't read."""
    spark = embeddings.sparkSession
    kept = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(usable(F.col("v"), width)).select("vec_id", quantised(F.col("v"), scale).alias("q"))
    with Scratch(spark) as scratch:
        # The hot vectors are counted before the shuffle: a task sends a distinct vector once.
        distinct = written(kept.groupBy("q").agg(F.count("*").alias("n")), "distinct")
        first = kept.orderBy(seed_key(F.col("vec_id"), seed), "q").limit(clusters).collect()  # one row for each cluster
        schema = f"vec_id {embeddings.schema[vec_id].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        if not first:
            return spark.createDataFrame([], schema)
        found = lloyd(distinct, np.array([r["q"] for r in first], np.int64), rounds)
        assigned = scratch.keep(written(found.distinct, "assigned"))
        heavy = heavy_keys(assigned, "q")
        inertia = {r["cluster"]: int(r["i"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("i")).collect()}  # a row for each cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    of_cluster = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digests)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    rows = joined_on(kept, assigned.select("q", "cluster", "distance"), "q", heavy)
    return rows.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
