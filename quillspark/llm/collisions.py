"""Nearest neighbours by collision counting over sorted single projections.

A random rotation gives each row one value on each of up to 64 lines.  Rows are cut into cells of
like length, norm and direction; a cell holds, for each line, its values in sorted order and each
row's place in it.  A query stands at the middle of a window on every line, found by binary search;
windows widen by a factor of two from level to level (virtual rehashing) and a row that lies within
enough of a query's windows is verified by its inner product.  Under a random rotation the number of
lines on which two points collide depends on nothing but their distance, so the threshold and the
width at which a query may stop follow from the distance of its k-th best row so far.

Largest inner products become smallest distances by one more component, sqrt(M^2 - |x|^2), with M the
largest norm of the cell and the query scaled to M.  A cell whose M cannot reach the query's k-th best
product is passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import shuffle_partitions, written

#: Neighbours, lines, rows of a cell, queries that one pass answers.
K, LINES, CELL, BLOCK = 20, 64, 8192, 4096
#: Half a window at the last level, in standard deviations of the k-th best row's distance on a line,
#: and standard deviations of the number of collisions by which the threshold lies below its mean.
REACH, SLACK = 1.5, 2.0
#: Levels below the last; each is half as wide as the next.
LEVELS = 3
#: Bytes of queries in a block.
BLOCK_BYTES = 8 << 20
#: Rows, chosen by hash, whose products give every query a first bound for its k-th best.
SAMPLE = 2048

_CELL = "dim int, n int, top double, ids binary, vectors binary, ranks binary, values binary"


def rotation(dim: int, lines: int = LINES) -> np.ndarray:
    """(dim + 1, lines): orthonormal columns, as many sets of them as the lines need; the same in
    every run."""
    rng, parts, left = np.random.default_rng(np.random.SeedSequence([7, dim])), [], max(lines, 1)
    while left > 0:
        q, r = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))
        parts.append((q * np.sign(np.diag(r)))[:, :left])
        left -= parts[-1].shape[1]
    return np.concatenate(parts, 1)


def usable_vector(vector: str) -> F.Column:
    """Neither null nor empty, all components finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _augmented(v: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, top * top - (v * v).sum(1)))
    return np.concatenate([v, rest[:, None]], 1)


def _coder(batches):
    """Rows with the order in which they are cut into cells: length, norm by eighths of a doubling,
    signs on sixteen lines."""
    for batch in batches:
        lists = batch.column(1)
        size = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten(), np.float64)
        at = np.concatenate([[0], np.cumsum(size)])
        norm, sign = np.zeros(len(size)), np.zeros(len(size), np.int32)
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            v = flat[at[rows][:, None] + np.arange(dim)]
            norm[rows] = np.linalg.norm(v, axis=1)
            bits = (v @ rotation(int(dim), 16)[:-1] > 0).astype(np.int32)
            sign[rows] = (bits << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int32)).sum(1)
        with np.errstate(divide="ignore"):
            step = np.floor(np.log2(np.where(norm > 0, norm, 1e-300)) * 8).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(size.astype(np.int32)), pa.array(step), pa.array(sign)], ["vec_id", "v", "dim", "step", "sign"])


def _celler(lines: int, cell: int):
    """Sorted rows to cells."""

    def made(dim: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        top = float(np.linalg.norm(v, axis=1).max())
        p = (_augmented(v, top) @ rotation(dim, lines)).astype(np.float32).T
        order = np.argsort(p, axis=1, kind="stable")
        ranks = np.empty_like(order, dtype=np.uint16)
        np.put_along_axis(ranks, order, np.arange(len(ids), dtype=np.uint16)[None, :], 1)
        blobs = [ids.tobytes(), v.tobytes(), ranks.tobytes(), np.take_along_axis(p, order, 1).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([top]), *[pa.array([b], pa.binary()) for b in blobs]], ["dim", "n", "top", "ids", "vectors", "ranks", "values"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, n = 0, 0

        def whole():
            return np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])

        for batch in batches:
            ids, dims = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(2), np.int64)
            flat = np.asarray(batch.column(1).flatten(), np.float64)
            at = np.concatenate([[0], np.cumsum(dims)])
            for lo in np.flatnonzero(np.diff(dims, prepend=-1)):  # runs of one length
                hi = lo + int(np.argmax(np.append(dims[lo:] != dims[lo], True)))
                dim = int(dims[lo])
                if dim != now and n:
                    yield made(now, *whole())
                    held, n = [], 0
                now = dim
                held.append((ids[lo:hi], flat[at[lo] : at[hi]].reshape(-1, dim)))
                n += hi - lo
                if n >= cell:
                    i, v = whole()
                    full = n // cell * cell
                    for a in range(0, full, cell):
                        yield made(dim, i[a : a + cell], v[a : a + cell])
                    held, n = ([(i[full:], v[full:])], n - full) if full < n else ([], 0)
        if n:
            yield made(now, *whole())

    return run


@dataclass
class Index:
    """Cells of all rows, and the sample (ids, vectors) that bounds are taken from."""

    cells: DataFrame
    sample: list[tuple[int, np.ndarray]]


def index(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", lines: int = LINES, cell: int = CELL) -> Index:
    """Cells of all usable rows, written to the shared folder.

    Rows without an id and vectors that are null, empty, zero or not finite are left out.  Rows are
    dealt by ranges of (length, norm, direction, hash of the id), so equal vectors of any number are
    divided among cells."""
    if not 0 < cell < 1 << 16:
        raise ValueError("a cell holds 1 to 65,535 rows")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable_vector("v"))
    coded = rows.mapInArrow(_coder, "vec_id bigint, v array<double>, dim int, step int, sign int").withColumn("salt", F.xxhash64("vec_id"))
    order = ["dim", "step", "sign", "salt"]
    dealt = coded.repartitionByRange(shuffle_partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)
    cells = written(dealt.select("vec_id", "v", "dim").mapInArrow(_celler(lines, cell), _CELL), "cells")
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE).collect()  # of bounded size
    return Index(cells, [(r["vec_id"], np.array(r["v"], np.float64)) for r in sample])


@dataclass
class _Asked:
    """A block's queries of one length: places in the block, ids, vectors, norms, values on the lines,
    bounds that their k-th best product reaches."""

    place: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    norm: np.ndarray
    on: np.ndarray
    floor: np.ndarray


def _threshold(lines: int, dim: int, reach: float, slack: float) -> int:
    """Collisions that a row at the k-th best distance reaches with near certainty at the last level.

    Of a vector of fixed length, its values on orthonormal lines are nearly normal and their squares
    add up, which leaves the number of large ones less room than independent values would."""
    from math import erf, exp, pi, sqrt

    p = erf(reach / sqrt(2))
    slope = 2 * reach * exp(-reach * reach / 2) / sqrt(2 * pi)
    spread = lines * max(p * (1 - p) - slope * slope / 2, 0.01) if lines <= dim + 1 else lines * p * (1 - p)
    return max(1, int(np.floor(lines * p - slack * sqrt(spread))))


class _Best:
    """The k best (score, id) of each query of a block, over all cells of a task."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.ids = [np.zeros(0, np.int64)] * n
        self.scores = [np.zeros(0)] * n

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]

    def least(self, q: int) -> float:
        """What the k-th best product reaches at least; minus infinity while that isn't known."""
        return max(self.floor[q], float(self.scores[q][-1])) if len(self.ids[q]) == self.k else self.floor[q]


def _verified(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (v * q).sum(1)  # row by row in one fixed order, so equal vectors score alike


def _searcher(spread, k: int, lines: int, reach: float, slack: float):
    def run(batches):
        groups, total = spread.value
        floor = np.full(total, -np.inf)
        for g in groups.values():
            floor[g.place] = g.floor
        best = _Best(total, k, floor)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] in groups:
                    _visit(row, groups[row["dim"]], best, k, lines, reach, slack)
        n = [len(x) for x in best.ids]
        if sum(n):
            ids = np.zeros(total, np.int64)
            for g in groups.values():
                ids[g.place] = g.ids
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "vec_id", "score"])

    return run


def _visit(row: dict, asked: _Asked, best: _Best, k: int, lines: int, reach: float, slack: float) -> None:
    """All queries of one length meet one cell."""
    n, dim, top = row["n"], row["dim"], row["top"]
    ids = np.frombuffer(row["ids"], np.int64)
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
    ranks = np.frombuffer(row["ranks"], np.uint16).reshape(lines, n)
    values = np.frombuffer(row["values"], np.float32).reshape(lines, n)
    need = _threshold(lines, dim, reach, slack)
    scale = top / asked.norm  # a query's length becomes the cell's largest norm
    center = asked.on * scale[:, None]
    least = np.array([best.least(p) for p in asked.place])
    # A row of product s lies at distance sqrt(2 M (M - s / |q|)); on a line that is a share 1 / sqrt(dim + 1).
    gap = 2 * top * (top - np.where(np.isfinite(least), least, -asked.norm * top) / asked.norm)
    full = reach * np.sqrt(np.maximum(gap, 0.0) / (dim + 1))
    out_of_reach = asked.norm * top * (1 + 1e-12) < least
    widths = full[:, None] / 2.0 ** np.arange(LEVELS, -1, -1) + 1e-6 * top
    low, high = np.empty((lines, *widths.shape), np.int64), np.empty((lines, *widths.shape), np.int64)
    for j in range(lines):
        low[j] = np.searchsorted(values[j], (center[:, j, None] - widths).astype(np.float32), "left")
        high[j] = np.searchsorted(values[j], (center[:, j, None] + widths).astype(np.float32), "right")
    for x, place in enumerate(asked.place):
        if out_of_reach[x]:
            continue
        seen = np.zeros(n, bool)
        for level in range(widths.shape[1]):
            lo, hi = low[:, x, level], high[:, x, level]
            last = level == widths.shape[1] - 1
            if last and not np.isfinite(best.least(place)):
                found = ~seen  # k rows aren't known: no width is enough
            elif (hi > lo).sum() < need:
                continue
            else:
                found = _counted(ranks, lo, hi) >= need
                found &= ~seen
            at = np.flatnonzero(found)
            if len(at):
                seen[at] = True
                at = at[ids[at] != asked.ids[x]]
                best.add(place, ids[at], _verified(vectors[at], asked.vectors[x]))
            now = best.least(place)
            if np.isfinite(now) and widths[x, level] >= reach * np.sqrt(max(0.0, 2 * top * (top - now / asked.norm[x])) / (dim + 1)):
                break


def _counted(ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each row of a cell, the windows [lo, hi) of sorted places that it lies in."""
    inside = (ranks - lo.astype(np.uint16)[:, None]) < (hi - lo).astype(np.uint16)[:, None]
    return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if len(ranks) < 256 else np.uint16)


def nearest(queries: DataFrame, found_in: Index, k: int = K, *, vec_id: str = "vec_id", vector: str = "embedding", lines: int = LINES, reach: float = REACH, slack: float = SLACK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query among
    the rows of an :func:`index`, but rows of the query's own id.

    Ties go to the smaller id; fewer rows than ``k`` are all found.  A query meets vectors of its own
    length.  Queries that are null, empty, zero or not finite, or have no id, find nothing; one whose
    id repeats is asked with its least vector, while every row that repeats an id is found as itself.
    An empty table gives an empty result.

    Queries are read in blocks of bounded bytes: one block is broadcast, meets all cells, and leaves
    at most ``k`` rows a query and task.  Each block's result is written before the next is begun.
    Queries that found fewer than ``k`` rows are asked again without a bound from the sample, which
    verifies whole cells until ``k`` rows are known."""
    asked = queries.select(F.col(vec_id).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v")).where(F.col("q").isNotNull() & usable_vector("v"))
    asked = written(asked.groupBy("q").agg(F.min("v").alias("v")), "asked")
    out = _in_blocks(asked, found_in, k, lines, reach, slack, True)
    short = asked.join(out.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") == k), F.col("q") == F.col("query_id"), "left_anti")
    if not short.isEmpty():
        again = _in_blocks(short, found_in, k, lines, reach, slack, False)
        out = out.join(short.select(F.col("q").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return out.select("query_id", "rank", "vec_id", "score")


def _in_blocks(asked: DataFrame, found_in: Index, k: int, lines: int, reach: float, slack: float, bounded: bool) -> DataFrame:
    spark = asked.sparkSession
    size = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-size[0] // BLOCK), -(-8 * size[0] * (size[1] or 0) // BLOCK_BYTES))
    blocks = blocks if blocks == 1 else 2 * blocks
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        spread = spark.sparkContext.broadcast(_groups(part.collect(), found_in.sample if bounded else [], k, lines))  # one block
        found = found_in.cells.mapInArrow(_searcher(spread, k, lines, reach, slack), "query_id bigint, vec_id bigint, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = written(found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k), "found")
        spread.destroy()
        out = ranked if out is None else out.unionByName(ranked)
    return out


def _groups(rows: list, sample: list[tuple[int, np.ndarray]], k: int, lines: int) -> tuple[dict[int, _Asked], int]:
    by: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by.setdefault(len(r["v"]), []).append(i)
    groups = {}
    for dim, at in by.items():
        ids, v = np.array([rows[i]["q"] for i in at], np.int64), np.array([rows[i]["v"] for i in at], np.float64)
        floor = np.full(len(at), -np.inf)
        like = [(i, x) for i, x in sample if len(x) == dim]
        if len(like) > k:
            products = v @ np.array([x for _, x in like]).T
            products[ids[:, None] == np.array([i for i, _ in like])[None, :]] = -np.inf
            floor = np.partition(products, len(like) - k, axis=1)[:, len(like) - k]
            floor -= 1e-9 * np.abs(floor)  # products may be rounded otherwise than when verified
        groups[dim] = _Asked(np.array(at), ids, v, np.linalg.norm(v, axis=1), v @ rotation(dim, lines)[:-1], floor)
    return groups, len(rows)


def search(embeddings: DataFrame, k: int = K, *, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows whose id ``every`` divides, as queries against all rows; see :func:`nearest`."""
    return nearest(embeddings.where(F.col(vec_id) % every == 0), index(embeddings, vec_id=vec_id, vector=vector), k, vec_id=vec_id, vector=vector)
