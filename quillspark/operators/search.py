"""Vector and text search for batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import RANKING
from quillspark.functions.text import terms
from quillspark.session import stored

#: Queries that one pass over the documents answers; more are answered in blocks, one at a time.
QUERY_BLOCK = 4096
#: Scores that are held at once, and single additions to them; rows that a task gathers beyond its best
#: before it thins them out.
SCORES, ADDITIONS, GATHERED = 1 << 21, 1 << 22, 1 << 19
#: How far rounding may move a score.
_ROUNDED = 2e-9


def _matrix(column: pa.Array) -> np.ndarray:
    width = set(pc.list_value_length(column).drop_null().unique().to_pylist())
    if len(width) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(width)}")
    flat = np.asarray(column.flatten(), np.float64)  # without null rows
    return flat.reshape(-1, width.pop() if width else 1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _blocks(queries: DataFrame, query_id: str) -> Iterator[DataFrame]:
    """Queries in blocks of about half of ``QUERY_BLOCK``, or all at once if they are few."""
    total = queries.count()
    n = 1 if total <= QUERY_BLOCK else -(-2 * total // QUERY_BLOCK)
    for b in range(n):
        yield queries if n == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == b)


def _by_block(queries: DataFrame, query_id: str, search: Callable[[DataFrame], tuple[DataFrame, object] | None]) -> DataFrame | None:
    """Results of all blocks.  With several, each is written before the next one is begun, so only
    one block's queries are on the driver and in the workers."""
    found: list[tuple[DataFrame, object]] = []
    for block in _blocks(queries, query_id):
        if found and found[-1][1] is not None:
            last, spread = found[-1]
            found[-1] = stored(last, "block"), None
            spread.destroy()
        got = search(block)
        if got is not None:
            found.append(got)
    out = None
    for df, _ in found:
        out = df if out is None else out.unionByName(df)
    return out


def _best(scores: np.ndarray, k: int | None, least: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of scores of at least each query's ``least``, and where these are many, of no more
    than its best ``k`` and their ties; all but for ``slack``."""
    keep = scores >= least - slack
    if k is not None and len(scores) > k and np.count_nonzero(keep) > k * scores.shape[1]:
        keep &= scores >= np.partition(np.where(keep, scores, -np.inf), len(scores) - k, axis=0)[len(scores) - k] - slack
    return np.nonzero(keep)


_HITS = "query_id bigint, doc_id bigint, score double"


class _Top:
    """Each query's best ``k`` rows of a task, gathered over its products; all rows without ``k``.

    Rows are thinned out when there are many, which raises what a row must reach to be gathered; ties
    go to lesser ids."""

    def __init__(self, ids: np.ndarray, k: int | None, least: float | np.ndarray):
        self.ids, self.k, self.least = ids, k, np.full(len(ids), least)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, 0 if k is None else k * len(ids) + min(k * len(ids), GATHERED)

    def add(self, docs: np.ndarray, scores: np.ndarray, digits: int | None = None) -> None:
        """A (row, query) table of scores, which are rounded to ``digits`` where they matter."""
        row, query = _best(scores, self.k, self.least, 0.0 if digits is None else _ROUNDED)
        score = scores[row, query]
        if digits is not None:
            score = np.round(score, digits)
            keep = score >= self.least[query]
            row, query, score = row[keep], query[keep], score[keep]
        self.put(query, docs[row], score)

    def put(self, query: np.ndarray, docs: np.ndarray, score: np.ndarray) -> None:
        """Single rows; ``query`` has places in ``ids``."""
        if len(query):
            self.parts.append((query, docs, score))
            self.held += len(query)
        if self.k is not None and self.held > self.most:
            self._thin()

    def _thin(self) -> None:
        query, docs, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((docs, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        if self.k is not None:
            last = order[place == self.k - 1]
            self.least[query[place == self.k - 1]] = score[last]
            order, query = order[place < self.k], query[place < self.k]
        self.parts, self.held = [(query, docs[order], score[order])], len(order)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is held, which is then let go."""
        if self.parts:
            self._thin()
            query, docs, score = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(docs), pa.array(score)], ["query_id", "doc_id", "score"])
        self.parts, self.held = [], 0


def vector_topk(queries: DataFrame, index: DataFrame, k: int, *, query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "vector", where: Column | None = None, min_score: float | None = None, skip_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` nearest rows by cosine in double precision.

    ``where`` filters the index before it is scored (pushed to its scan).  Rows of the index meet a
    broadcast block of queries in matrix products of bounded size; a task keeps its best, so at most
    ``k`` rows for each query and task are shuffled.  Ties go to the lesser id."""
    index = index if where is None else index.where(where)
    side = index.select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("v")).where("v is not null")

    def search(part: DataFrame):
        rows = part.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).where("v is not null").collect()  # one block
        if not rows:
            return None
        ids = np.array([r.q for r in rows], np.int64)
        spread = index.sparkSession.sparkContext.broadcast((ids, _unit(np.array([list(r.v) for r in rows], np.float64))))
        return side.mapInArrow(_scorer(spread, k, min_score, skip_self), _HITS), spread

    out = _by_block(queries, query_id, search)
    if out is None:
        out = side.select(F.lit(None).cast("bigint").alias("query_id"), F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    return ranked(out, k)


def _scorer(spread, k: int, min_score: float | None, skip_self: bool):
    def run(batches):
        ids, q = spread.value
        step, top = max(1, SCORES // len(ids)), _Top(ids, k, -2.0 if min_score is None else min_score)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                docs = np.asarray(part.column(0), np.int64)
                scores = _unit(_matrix(part.column(1))) @ q.T  # (rows, queries)
                if skip_self:
                    scores[docs[:, None] == ids[None, :]] = -np.inf
                top.add(docs, scores, 9)
        yield from top.rows()

    return run


def ranked(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The best ``k`` rows of each query with their rank; ties go to the lesser id."""
    best = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, length): the inverted index, one row for each term of each document.

    Terms are sorted and counted within their row, so building it needs no shuffle; rows that
    repeat an id are documents of their own."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.sort_array(terms(text)).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    t = t.where(F.size("t") > 0).withColumn("s", starts)
    counted = F.transform("s", lambda at, i: F.struct(F.get("t", at).alias("term"), (F.coalesce(F.get("s", i + 1), F.size("t")) - at).cast("bigint").alias("tf")))
    return t.select("doc_id", F.size("t").alias("length"), F.explode(counted).alias("x")).select("doc_id", "x.term", "length", "x.tf")


class _Asked:
    """The terms of a block of queries and, for each term, the queries that have it."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.ids = np.array([q for q, _ in rows], np.int64)
        self.terms = pa.array(sorted({t for _, ts in rows for t in ts}), pa.string())
        place = {t: i for i, t in enumerate(self.terms.to_pylist())}
        pairs = np.array(sorted((place[t], q) for q, (_, ts) in enumerate(rows) for t in ts), np.int64).reshape(-1, 2)
        self.queries = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))

    def counts(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf) of the asked terms in lists of terms, and the lists' lengths."""
        length = pc.list_value_length(lists).fill_null(0).to_numpy()
        at = pc.index_in(lists.flatten(), value_set=self.terms)
        row = np.repeat(np.arange(len(lists)), length)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        key, tf = np.unique(row[known] * max(len(self.terms), 1) + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
        return key // max(len(self.terms), 1), key % max(len(self.terms), 1), tf, length


def _doc_counts(spread):
    """(term, n): documents with each asked term; -1 counts documents, -2 adds up their lengths."""

    def run(batches):
        for batch in batches:
            _, term, _, length = spread.value.counts(batch.column(1))
            found, n = np.unique(term, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found, [-1, -2])), pa.array(np.append(n, [len(length), int(length.sum())]))], ["term", "n"])

    return run


def _text_scorer(spread, weights, k: int | None, k1: float, b: float):
    def run(batches):
        asked, (idf, mean) = spread.value, weights.value
        n_queries = len(asked.ids)
        step, top = max(1, SCORES // n_queries), _Top(asked.ids, k, 1e-9)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                docs = np.asarray(part.column(0), np.int64)
                row, term, tf, length = asked.counts(part.column(1))
                w = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
                scores = np.zeros(len(docs) * n_queries)
                width = np.diff(asked.first)[term]
                ends = np.cumsum(width)
                cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, ADDITIONS)).tolist() + [len(ends)]
                for x, y in zip(cuts, cuts[1:]):
                    n = width[x:y]
                    each = np.repeat(asked.first[term[x:y]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    scores += np.bincount(np.repeat(row[x:y] * n_queries, n) + asked.queries[each], np.repeat(w[x:y], n), len(scores))
                scores = np.round(scores.reshape(len(docs), n_queries), 9)
                top.add(docs, scores)
                if k is None:
                    yield from top.rows()
        yield from top.rows()

    return run


def bm25(queries: DataFrame, docs: DataFrame, *, k: int | None = None, query_id: str = "query_id", query: str = "query", doc_id: str = "doc_id", text: str = "text", k1: float = RANKING.bm25_k1, b: float = RANKING.bm25_b) -> DataFrame:
    """(query_id, doc_id, score) of documents with a term of the query; with ``k``, at least the best
    ``k`` of each query (:func:`ranked` takes these).

    Texts are split in the JVM; a block of queries meets them as a broadcast table of its terms, of
    which a first pass counts the documents.  Only candidates for the top leave a task, so no more
    than ``k`` rows for each query and task are shuffled.  A query's repeated terms count once;
    rows without a text, as those that have only a vector, are no documents here."""
    t = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), terms(text).alias("t"))
    asked_terms = queries.select(F.col(query_id).alias("q"), F.array_distinct(terms(query)).alias("t")).where(F.size("t") > 0)
    context = docs.sparkSession.sparkContext

    def search(part: DataFrame):
        rows = [(r.q, list(r.t)) for r in part.collect()]  # one block
        if not rows:
            return None
        asked = _Asked(rows)
        spread = context.broadcast(asked)
        counted = dict(t.mapInArrow(_doc_counts(spread), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())  # a row for each asked term
        n, total = counted.get(-1, 0), counted.get(-2, 0)
        df = np.array([counted.get(i, 0) for i in range(len(asked.terms))], np.float64)
        weights = context.broadcast((np.log(1 + (n - df + 0.5) / (df + 0.5)), total / n if total else 1.0))
        return t.mapInArrow(_text_scorer(spread, weights, k, k1, b), _HITS), spread

    out = _by_block(asked_terms, "q", search)
    return t.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score")).where(F.lit(False)) if out is None else out


def text_topk(queries: DataFrame, docs: DataFrame, k: int, **options) -> DataFrame:
    return ranked(bm25(queries, docs, k=k, **options), k)
