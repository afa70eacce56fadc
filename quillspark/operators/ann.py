"""A stored vector index: inverted lists of product-quantised vectors, verified by their originals.

``build`` writes under a path, which ``Index.open`` reads in any session:

* ``centres``: the lists' centres, as many as the square root of the rows, by k-means whose rounds are
  Spark jobs over a share of the rows that grows with the lists;
* ``codebooks``: 256 words for each group of components of what is left after the centre;
* ``cells``: some thousand rows of one list, ids and a byte for each group;
* ``vectors``: the originals by id; ``sample``: a bounded number of codes; ``meta``: one row.

A search reads ids and codes of the lists nearest to its queries, keeps for each query the rows whose
rebuilt vectors score best, and fetches the originals of these alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.search import _HITS, SCORES, _by_block, _matrix, _Top, _unit, ranked
from quillspark.session import prepared, stored

#: Lists at most, rows a list for fitting, rounds, rows of a cell.
LISTS, PER_LIST, ROUNDS, CELL = 16_384, 128, 8, 4096
#: Components of a group, words of a codebook, rows that codebooks and probes are fitted on.
GROUP, WORDS, SAMPLE = 4, 256, 16_384
#: Share of the sample's true neighbours that lie in the lists which are looked at; neighbours and
#: questions that this is measured with.
WITHIN, NEAR, PROBES_FROM = 0.98, 10, 256
#: Rows whose originals are scored for each query: this share of all, and so many times k at most.
SCORED, TIMES = 0.05, 100
#: Tasks for each core that scan cells, pairs of an original and a query that are scored at once.
DEALT, PAIRS = 2, 1 << 15


def _means(rows: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Spherical k-means: a task returns one sum for each centre that has rows, the driver gets the
    centres; one without rows stays where it was."""
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        spread = context.broadcast(centres)

        def run(batches, spread=spread):
            c = spread.value
            n, sums = np.zeros(len(c), np.int64), np.zeros_like(c)
            for batch in batches:
                v = _unit(_matrix(batch.column(0)))
                for at in range(0, len(v), CELL):
                    own = _nearest(v[at : at + CELL], c)
                    n += np.bincount(own, minlength=len(c))
                    np.add.at(sums, own, v[at : at + CELL])
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(sums[some]), pa.list_(pa.float64()))], ["list", "s"])

        parts = rows.mapInArrow(run, "list int, s array<double>").select("list", F.posexplode("s").alias("j", "x")).groupBy("list", "j").agg(F.sum("x").alias("x"))
        moved, seen = centres.copy(), np.zeros(len(centres), bool)
        t = parts.toArrow()  # a row for each component of a centre
        lists, j = np.asarray(t.column("list")), np.asarray(t.column("j"))
        moved[lists, j] = np.asarray(t.column("x"))
        seen[lists] = True
        centres = np.where(seen[:, None], _unit(moved), centres)
        spread.unpersist()
    return centres


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(v @ centres.T, axis=1)


def _codebooks(left: np.ndarray, groups: list[slice]) -> np.ndarray:
    """(group, word, component) of k-means over the groups of a bounded sample; unused words are far off."""
    books = np.full((len(groups), WORDS, GROUP), 1e6)
    for g, part in enumerate(groups):
        x = left[:, part]
        words = x[:: max(1, len(x) // WORDS)][:WORDS].copy()
        for _ in range(ROUNDS):
            own = np.argmin((words**2).sum(1) - 2 * x @ words.T, axis=1)
            n = np.bincount(own, minlength=len(words))
            sums = np.zeros_like(words)
            np.add.at(sums, own, x)
            words[n > 0] = sums[n > 0] / n[n > 0, None]
        books[g, : len(words), : x.shape[1]] = words
        books[g, : len(words), x.shape[1] :] = 0
    return books


def _groups(dim: int) -> list[slice]:
    return [slice(a, min(a + GROUP, dim)) for a in range(0, dim, GROUP)]


def _coded(left: np.ndarray, books: np.ndarray) -> np.ndarray:
    out = np.empty((len(left), len(books)), np.uint8)
    for g, part in enumerate(_groups(left.shape[1])):
        words = books[g, :, : part.stop - part.start]
        out[:, g] = np.argmin((words**2).sum(1) - 2 * left[:, part] @ words.T, axis=1)
    return out


def _rebuilt(lists: np.ndarray, codes: np.ndarray, centres: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that lists and codes stand for."""
    words = books[np.arange(len(books))[None, :], codes].reshape(len(codes), -1)
    return centres[lists] + words[:, : centres.shape[1]]


@dataclass
class Index:
    """A stored index; :meth:`open` gives it to any session."""

    path: str
    cells: DataFrame
    vectors: DataFrame
    centres: np.ndarray
    books: np.ndarray
    sample: np.ndarray
    rows: int
    probes: int

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        path = path.rstrip("/")
        read = prepared(spark).read.parquet
        m = read(f"{path}/meta").first()
        c = sorted(read(f"{path}/centres").collect(), key=lambda r: r["list"])  # bounded by LISTS
        centres = np.array([r["centre"] for r in c]).reshape(len(c), m["dim"])
        books = np.frombuffer(m["books"], np.float64).reshape(-1, WORDS, GROUP)
        s = read(f"{path}/sample").collect()  # bounded by SAMPLE
        lists, codes = np.array([r["list"] for r in s], int), np.array([list(r["code"]) for r in s], np.uint8).reshape(len(s), len(books))
        sample = _rebuilt(lists, codes, centres, books) if len(s) else np.zeros((0, m["dim"]))
        return Index(path, read(f"{path}/cells"), read(f"{path}/vectors"), centres, books, sample, m["rows"], m["probes"])


def build(docs: DataFrame, path: str, *, doc_id: str = "doc_id", vector: str = "vector", lists: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of all rows with an id and a vector, written under ``path``.

    Centres are fitted on ``PER_LIST`` rows a list, codebooks on at most ``sample`` rows, all chosen by
    the hash of their ids.  Rows are dealt by ranges of (list, hash of the id), so a list of any number
    of rows is coded and written by as many tasks as it needs."""
    spark = prepared(docs.sparkSession)
    path, size = path.rstrip("/"), CELL
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(vector).cast("array<double>").alias("vector")).where("doc_id is not null and vector is not null")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/vectors")
    n = rows.count()
    many = lists or min(max(1, int(np.sqrt(n))), LISTS)
    drawn = rows.withColumn("h", F.xxhash64("doc_id"))
    seen = drawn.orderBy("h", "doc_id").limit(max(sample, many)).select("vector").toArrow().column("vector").combine_chunks()  # of bounded size
    v = _unit(_matrix(seen)) if n else np.zeros((0, 1))
    share = min(1.0, many * PER_LIST / max(n, 1))
    fitted = drawn.where(F.pmod(F.col("h"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vector")
    centres = _means(fitted, v[:many].copy(), ROUNDS) if n else v
    own = _nearest(v, centres) if n else np.zeros(0, int)
    books = _codebooks(v - centres[own], _groups(v.shape[1])) if n else np.full((1, WORDS, GROUP), 1e6)
    spread = spark.sparkContext.broadcast((centres, books))

    def coded(batches):
        c, b = spread.value
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1)))
                near = np.concatenate([_nearest(x[a : a + CELL], c) for a in range(0, len(x), CELL)])
                code = _coded(x - c[near], b)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array([r.tobytes() for r in code], pa.binary())], ["doc_id", "list", "code"])

    def celled(batches):
        held: list[tuple[int, int, bytes]] = []

        def cell(part):
            return pa.RecordBatch.from_arrays([pa.array([part[0][1]], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([np.array([x[0] for x in part], np.int64).tobytes()]), pa.array([b"".join(x[2] for x in part)])], ["list", "n", "ids", "codes"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (row[1] != held[0][1] or len(held) == size):
                    yield cell(held)
                    held = []
                held.append(row)
        if held:
            yield cell(held)

    codes = rows.mapInArrow(coded, "doc_id bigint, list int, code binary").withColumn("salt", F.xxhash64("doc_id"))
    codes.repartitionByRange("list", "salt").sortWithinPartitions("list", "salt").select("doc_id", "list", "code").mapInArrow(celled, "list int, n int, ids binary, codes binary").write.parquet(f"{path}/cells")
    local = lambda columns: spark.createDataFrame(pa.table(columns)).coalesce(1)
    local({"list": pa.array(np.arange(len(centres)), pa.int32()), "centre": pa.array(list(centres), pa.list_(pa.float64()))}).write.parquet(f"{path}/centres")
    few = own[:sample]
    local({"list": pa.array(few, pa.int32()), "code": pa.array([r.tobytes() for r in (_coded(v[: len(few)] - centres[few], books) if n else [])], pa.binary())}).write.parquet(f"{path}/sample")
    local({"rows": [n], "dim": [v.shape[1]], "probes": [_probes(v[:sample], few, centres)], "books": pa.array([books.tobytes()], pa.binary())}).write.parquet(f"{path}/meta")
    return Index.open(spark, path)


def _probes(v: np.ndarray, own: np.ndarray, centres: np.ndarray) -> int:
    """How many of its nearest lists a query looks at, so that they hold ``WITHIN`` of the sample's
    nearest neighbours."""
    if len(v) < 2:
        return len(centres)
    q = v[:PROBES_FROM]
    scores = q @ v.T
    scores[np.arange(len(q)), np.arange(len(q))] = -2
    near = np.argsort(-scores, axis=1)[:, : min(NEAR, len(v) - 1)]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], 1), WITHIN, method="higher")) + 1


def topk(queries: DataFrame, index: Index, k: int, *, query_id: str = "query_id", vector: str = "vector", probes: int | None = None, scored: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best by cosine among ``scored`` rows a query (by
    default ``SCORED`` of all, and not more than ``TIMES`` k), those that score best by their codes in
    the ``probes`` nearest lists.  With all lists and all rows the result is exact."""
    index_rows = index.rows
    deep = scored if scored is not None else max(k, min(int(index_rows * SCORED), TIMES * k))

    def search(part: DataFrame):
        rows = part.select(F.col(query_id).cast("bigint").alias("q"), F.col(vector).alias("v")).where("v is not null").collect()  # one block
        if not rows or not index_rows:
            return None
        ids, q = np.array([r.q for r in rows], np.int64), _unit(np.array([list(r.v) for r in rows], np.float64))
        order = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")[:, : probes or index.probes]
        probed = np.zeros((len(q), len(index.centres)), bool)
        np.put_along_axis(probed, order, True, axis=1)
        # What a query's ``deep`` best rows reach, as the sample tells; some more are let by.
        place = int(1.5 * deep / index_rows * len(index.sample)) + 20
        floor = np.full(len(q), -np.inf)
        if place < len(index.sample):
            s = np.concatenate([q[a : a + 256] @ index.sample.T for a in range(0, len(q), 256)])
            floor = np.partition(s, len(index.sample) - place, axis=1)[:, len(index.sample) - place]
        context = index.cells.sparkSession.sparkContext
        spread = context.broadcast((ids, q, probed, floor, index.centres, index.books))
        wanted = np.flatnonzero(probed.any(axis=0)).tolist()
        cells = index.cells if len(wanted) == len(index.centres) else index.cells.where(F.col("list").isin(wanted))
        # Cells are few bytes and much work: read as they lie they would go to a task or two.
        found = cells.repartition(DEALT * context.defaultParallelism).mapInArrow(_scanner(spread, deep), _HITS)
        # Each original is fetched once for all queries of the block that want it.
        asked = ranked(found, deep).groupBy("doc_id").agg(F.collect_set("query_id").alias("asked"))
        return asked.join(index.vectors, "doc_id").select("doc_id", "vector", "asked").mapInArrow(_rescorer(spread, k), _HITS), spread

    found = _by_block(queries, query_id, search)
    if found is None:
        found = index.vectors.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    return ranked(found, k)


def _scanner(spread, deep: int):
    def run(batches):
        ids, q, probed, floor, centres, books = spread.value
        step, top = max(1, SCORES // len(ids)), _Top(ids, deep, np.maximum(floor, -2.0))
        for batch in batches:
            for row in batch.to_pylist():
                mine = np.flatnonzero(probed[:, row["list"]])
                if not len(mine):
                    continue
                docs, codes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["codes"], np.uint8).reshape(row["n"], -1)
                for a in range(0, row["n"], step):
                    v = _rebuilt(np.full(len(codes[a : a + step]), row["list"]), codes[a : a + step], centres, books)
                    scores = v @ q[mine].T
                    at, asked = np.nonzero(scores >= top.least[mine])
                    top.put(mine[asked], docs[a : a + step][at], scores[at, asked])
        yield from top.rows()

    return run


def _rescorer(spread, k: int):
    """Cosines of originals (doc_id, vector, asked) with the queries that ask for them."""

    def run(batches):
        ids, q = spread.value[:2]
        order, top = np.argsort(ids, kind="stable"), _Top(ids, k, -2.0)
        known = ids[order]
        for batch in batches:
            docs, v, asked = np.asarray(batch.column(0), np.int64), _unit(_matrix(batch.column(1))), batch.column(2)
            row, query = np.repeat(np.arange(len(docs)), asked.value_lengths().to_numpy()), np.asarray(asked.flatten(), np.int64)
            first = np.searchsorted(known, query)
            many = np.searchsorted(known, query, "right") - first  # an id may stand for several vectors
            row, at = np.repeat(row, many), np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            for a in range(0, len(row), PAIRS):
                r, p = row[a : a + PAIRS], order[at[a : a + PAIRS]]
                top.put(p, docs[r], np.round(np.einsum("ij,ij->i", v[r], q[p]), 9))
        yield from top.rows()

    return run
