"""A stored inverted index that text search reads, with block-max pruning.

``build`` writes three tables under a path, which ``TextIndex.open`` reads in any session:

* ``blocks``: postings of one term and one slice of the documents, 128 to a row in the order of their
  ids, with the largest BM25 part among them; in folders by the term's hash and sorted by term;
* ``terms``: for each term its number of documents, its largest part, and from which part on it has
  1, 2, 5, ... documents;
* ``meta``: one row of counts and constants.

A search reads the folders of the asked terms only.  A term's k-th largest part is a bound for a
query's k-th best score before any posting is read; blocks that cannot reach the bound of any query
stay behind, the others meet by slice.  In a slice, terms that together cannot reach the bound are
looked up for what other terms have found, and only in blocks that hold such documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.config import RANKING
from quillspark.functions import text as T
from quillspark.functions.text import terms
from quillspark.operators.search import _HITS, ranked
from quillspark.session import prepared, stored

#: Postings of a block, documents and words of a slice on average at most and slices at least, documents
#: for each folder of terms, folders at least and at most.  A search holds a slice's asked postings in a task.
BLOCK, SLICE_DOCS, SLICE_WORDS, SLICES, FOLDER_DOCS, FOLDERS = 128, 8192, 1 << 22, 8, 20_000, (8, 1024)
#: Steps of a term's largest parts that ``terms`` keeps, and their resolution.
RANKS, LEVELS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000), 256
#: Queries, and words of all these, that are searched at once.
QUERIES, ASKED = 4096, 50_000
#: What scores may be apart by rounding.
_EPS = 1e-8

_BLOCKS = "term string, slice int, first bigint, last bigint, n int, top double, docs binary, tfs binary, lengths binary"


def bucket(term: Column | str, buckets: int) -> Column:
    return (F.crc32(T.col(term).cast("binary")) % F.lit(buckets)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, tf, length) of documents and their terms; a row of the empty term for each."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        length = pc.list_value_length(lists).fill_null(0).to_numpy()
        flat = lists.flatten().dictionary_encode()
        size = max(len(flat.dictionary), 1)
        key, tf = np.unique(np.repeat(np.arange(len(lists)), length) * size + flat.indices.to_numpy().astype(np.int64), return_counts=True)
        row = np.append(key // size, np.arange(len(lists)))
        term = pa.concat_arrays([flat.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array([""] * len(lists), pa.string())])
        yield pa.RecordBatch.from_arrays([term, ids.take(pa.array(row)), pa.array(np.append(tf, np.zeros(len(lists), np.int64)).astype(np.int32)), pa.array(length[row].astype(np.int32))], ["term", "doc_id", "tf", "length"])


def part(tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    """A posting's part of a BM25 score, but for the term's weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _blocker(mean: float, k1: float, b: float):
    """Postings sorted by term, slice and id to blocks."""

    def made(t: pa.Table) -> pa.RecordBatch:
        term, slices = t.column("term").combine_chunks(), np.asarray(t.column("slice"))
        docs, tf, length = (np.asarray(t.column(c)) for c in ("doc_id", "tf", "length"))
        code = np.asarray(term.dictionary_encode().indices)
        new = np.append(True, (code[1:] != code[:-1]) | (slices[1:] != slices[:-1]))
        at = np.flatnonzero(new)
        place = np.arange(len(code)) - np.repeat(at, np.diff(np.append(at, len(code))))
        first = np.flatnonzero(place % BLOCK == 0)
        last = np.append(first[1:], len(code)) - 1
        top = np.maximum.reduceat(tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)), first)
        cut = lambda x: pa.array([x[i : j + 1].tobytes() for i, j in zip(first, last)], pa.binary())
        columns = [term.take(pa.array(first)), pa.array(slices[first]), pa.array(docs[first]), pa.array(docs[last]), pa.array((last - first + 1).astype(np.int32)), pa.array(top), cut(docs), cut(tf), cut(length)]
        return pa.RecordBatch.from_arrays(columns, ["term", "slice", "first", "last", "n", "top", "docs", "tfs", "lengths"])

    def run(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            # The last block may go on in the next batch.
            last = pc.and_(pc.equal(t.column("term"), t.column("term")[-1]), pc.equal(t.column("slice"), t.column("slice")[-1])).to_numpy()
            begin = len(t) - int(last[::-1].argmin() if not last.all() else len(t))
            cut = begin + (len(t) - begin) // BLOCK * BLOCK
            cut -= BLOCK if cut == len(t) and cut > begin else 0
            if cut:
                yield made(t.slice(0, cut))
            left = t.slice(cut)
        if left is not None and len(left):
            yield made(left)

    return run


@dataclass
class TextIndex:
    """A stored index; :meth:`open` gives it to any session."""

    path: str
    blocks: DataFrame
    terms: DataFrame
    documents: int
    mean: float
    k1: float
    b: float
    buckets: int

    @staticmethod
    def open(spark: SparkSession, path: str) -> TextIndex:
        path = path.rstrip("/")
        m = prepared(spark).read.parquet(f"{path}/meta").first()
        blocks = spark.read.schema(_BLOCKS + ", bucket int").parquet(f"{path}/blocks")
        known = spark.read.schema(f"term string, df bigint, {', '.join(f'top{k} int' for k in RANKS)}, bucket int").parquet(f"{path}/terms")
        return TextIndex(path, blocks, known, m["documents"], m["mean"], m["k1"], m["b"], m["buckets"])


def build(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", k1: float = RANKING.bm25_k1, b: float = RANKING.bm25_b, buckets: int | None = None, slice_docs: int = SLICE_DOCS) -> TextIndex:
    """The index of all rows with a text, written under ``path``; rows without an id or a text are left
    out, and ids must not repeat.

    Postings are dealt by ranges of (folder, term, slice, id), so a term of any number of documents is
    written by as many tasks as it needs."""
    spark = prepared(docs.sparkSession)
    path = path.rstrip("/")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    postings = stored(rows.select("doc_id", terms("text").alias("t")).mapInArrow(_counted, "term string, doc_id bigint, tf int, length int"), "postings")
    each = postings.where("term = ''")
    n, distinct, total = each.agg(F.count("*"), F.count_distinct("doc_id"), F.sum("length")).first()
    if n != distinct:
        raise ValueError(f"{n - distinct} rows repeat an id")
    mean = total / n if total else 1.0
    slices = max(SLICES, -(-n // slice_docs), -(-(total or 0) // SLICE_WORDS))
    buckets = buckets or min(max(FOLDERS[0], n // FOLDER_DOCS), FOLDERS[1])
    words = postings.where("term <> ''").withColumns({"bucket": bucket("term", buckets), "slice": F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int")})
    order = ["bucket", "term", "slice", "doc_id"]
    # Adaptive execution joins small ranges, so a folder is written by few tasks.
    blocks = words.repartitionByRange(*order).sortWithinPartitions(*order).select("term", "slice", "doc_id", "tf", "length").mapInArrow(_blocker(mean, k1, b), _BLOCKS)
    blocks.withColumn("bucket", bucket("term", buckets)).write.partitionBy("bucket").parquet(f"{path}/blocks")
    level = F.floor(part(F.col("tf"), F.col("length"), mean, k1, b) * (LEVELS / (k1 + 1))).cast("int")
    steps = words.groupBy("bucket", "term", level.alias("level")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("bucket", "term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    reached = steps.repartition("bucket", "term").withColumn("sum", F.sum("n").over(down))  # at most LEVELS rows a term
    reach = [F.max(F.when(F.col("sum") >= k, F.col("level"))).alias(f"top{k}") for k in RANKS]
    # Dealt by folder, without a sample: one would count all postings again.
    reached.groupBy("bucket", "term").agg(F.sum("n").alias("df"), *reach).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    spark.createDataFrame([(n, float(mean), float(k1), float(b), buckets, slices)], "documents bigint, mean double, k1 double, b double, buckets int, slices int").coalesce(1).write.parquet(f"{path}/meta")
    return TextIndex.open(spark, path)


@dataclass
class _Plan:
    """A block of queries: ids, for each its terms with their weights, and its bound."""

    ids: np.ndarray
    terms: list[list[tuple[int, float]]]
    bound: np.ndarray


class _Slice:
    """One slice's blocks of the asked terms; their postings stay where they came, in any order, and
    are decoded when first looked at."""

    def __init__(self, table: pa.Table, mean: float, k1: float, b: float):
        self.columns = {c: table.column(c) for c in ("docs", "tfs", "lengths")}
        tid, first = np.asarray(table.column("tid")), np.asarray(table.column("first"))
        self.row = np.lexsort((first, tid))
        self.first, self.last, self.top = (np.asarray(table.column(c))[self.row] for c in ("first", "last", "top"))
        tid = tid[self.row]
        at = np.flatnonzero(np.append(True, tid[1:] != tid[:-1])) if len(tid) else np.zeros(0, int)
        self.of = {int(tid[i]): np.arange(i, j) for i, j in zip(at, np.append(at[1:], len(tid)))}
        self.mean, self.k1, self.b = mean, k1, b
        self.seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def decoded(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and parts of the postings of some blocks."""
        found = []
        for i in at.tolist():
            if i not in self.seen:
                docs, tf, length = (np.frombuffer(self.columns[c][int(self.row[i])].as_buffer(), t) for c, t in (("docs", np.int64), ("tfs", np.int32), ("lengths", np.int32)))
                self.seen[i] = docs, tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))
            found.append(self.seen[i])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate([d for d, _ in found]), np.concatenate([p for _, p in found])

    def best(self, asked: list[tuple[int, float]], k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the documents here that may be among a query's ``k`` best."""
        held = sorted(((w * self.top[self.of[t]].max(), w, self.of[t]) for t, w in asked if t in self.of), key=lambda x: x[0])
        most = np.array([x[0] for x in held])
        before = np.cumsum(most) - most  # of all terms that are looked at later
        essential = int(np.searchsorted(np.cumsum(most), bound - _EPS))
        docs, parts = [], []
        for top, w, at in held[essential:]:
            at = at[w * self.top[at] + (most.sum() - top) >= bound - _EPS]
            d, p = self.decoded(at)
            docs.append(d)
            parts.append(w * p)
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0)
        ids, place = np.unique(np.concatenate(docs), return_inverse=True)
        scores = np.bincount(place, np.concatenate(parts), len(ids))
        for j in range(essential - 1, -1, -1):
            if len(scores) > k:
                bound = max(bound, np.partition(scores, len(scores) - k)[len(scores) - k])
            keep = scores + before[j] + most[j] >= bound - _EPS
            ids, scores = ids[keep], scores[keep]
            _, w, at = held[j]
            at = at[np.searchsorted(ids, self.first[at]) < np.searchsorted(ids, self.last[at], "right")]
            d, p = self.decoded(at)
            if len(d):
                place = np.minimum(np.searchsorted(d, ids), len(d) - 1)
                scores = scores + np.where(d[place] == ids, w * p[place], 0.0)
        scores = np.round(scores, 9)
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _scorer(spread, k: int, mean: float, k1: float, b: float, read, decoded):
    def run(table: pa.Table) -> pa.Table:
        plan, here = spread.value, _Slice(table, mean, k1, b)
        query, docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for q, asked in enumerate(plan.terms):
            d, s = here.best(asked, k, plan.bound[q])
            query.append(np.full(len(d), plan.ids[q]))
            docs.append(d)
            scores.append(s)
        read.add(len(here.top))
        decoded.add(len(here.seen))
        return pa.table([np.concatenate(query), np.concatenate(docs), np.concatenate(scores)], names=["query_id", "doc_id", "score"])

    return run


def _plan(asked: list, known: dict[str, tuple], index: TextIndex, k: int) -> tuple[_Plan, dict[str, tuple[int, float]]]:
    """The queries' weights and bounds, and for each asked term its number and the least part of a
    block that any query can do with."""
    place = {t: i for i, t in enumerate(known)}
    step = (index.k1 + 1) / LEVELS
    weight = {t: float(np.log(1 + (index.documents - df + 0.5) / (df + 0.5))) for t, (df, _) in known.items()}
    deep = next((i for i, r in enumerate(RANKS) if r >= k), None)
    ids, words, bounds, least = [], [], [], dict.fromkeys(known, np.inf)
    for q, ts in asked:
        ts = [t for t in ts if t in known]
        bound = max([1e-9, *(weight[t] * known[t][1][deep] * step - _EPS for t in ts if deep is not None and known[t][1][deep] is not None)])
        most = {t: weight[t] * min((known[t][1][0] + 1) * step, index.k1 + 1) for t in ts}
        every = sum(most.values())
        for t in ts:
            least[t] = min(least[t], (bound - (every - most[t])) / weight[t] - _EPS)
        ids.append(q)
        words.append([(place[t], weight[t]) for t in ts])
        bounds.append(bound)
    return _Plan(np.array(ids, np.int64), words, np.array(bounds)), {t: (place[t], float(least[t])) for t in known}


def _query_blocks(asked: DataFrame) -> Iterator[list]:
    """Rows (q, t) in blocks of bounded queries and terms; few are read in one go."""
    few = asked.limit(QUERIES // 8 + 1).collect()
    if len(few) <= QUERIES // 8 and sum(len(r["t"]) for r in few) <= ASKED:
        yield few
        return
    n, words = asked.agg(F.count("*"), F.sum(F.size("t"))).first()
    blocks = max(-(-n // QUERIES), -(-(words or 0) // ASKED))
    blocks = blocks if blocks < 2 else 2 * blocks
    for i in range(blocks):
        yield (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)).collect()


def topk(queries: DataFrame, index: TextIndex, k: int, *, query_id: str = "query_id", query: str = "query", counts: dict | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents of each query by BM25, exactly.

    Repeated terms of a query count once, ties go to the lesser id, queries without a known term find
    nothing.  With several blocks of queries each one's result is written before the next is begun.
    ``counts`` gets accumulators of the blocks that reached a slice and of those that were decoded."""
    spark = queries.sparkSession
    context = spark.sparkContext
    asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.array_distinct(terms(query)).alias("t")).where(F.size("t") > 0)
    counts = {} if counts is None else counts
    spread = None
    counts["read"], counts["decoded"] = context.accumulator(0), context.accumulator(0)
    out = None
    for rows in _query_blocks(asked):
        words = sorted({t for r in rows for t in r["t"]})
        if not words:
            continue
        folders = sorted({zlib.crc32(t.encode()) % index.buckets for t in words})
        found = index.terms.where(F.col("bucket").isin(folders)).join(F.broadcast(_local(spark, {"term": words})), "term").collect()  # asked terms
        known = {r["term"]: (r["df"], [r[f"top{x}"] for x in RANKS]) for r in found}
        if not known:
            continue
        plan, least = _plan([(r["q"], r["t"]) for r in rows], known, index, k)
        wanted = _local(spark, {"term": list(least), "tid": [i for i, _ in least.values()], "least": [x for _, x in least.values()]})
        folders = sorted({r["bucket"] for r in found})
        if out is not None:  # the block before; its queries are no longer needed
            out[-1] = stored(out[-1], "block")
            spread.destroy()
        blocks = index.blocks.where(F.col("bucket").isin(folders)).join(F.broadcast(wanted), "term").where(F.col("top") >= F.col("least"))
        spread = context.broadcast(plan)
        hits = blocks.select("slice", "tid", "first", "last", "top", "docs", "tfs", "lengths").groupBy("slice").applyInArrow(_scorer(spread, k, index.mean, index.k1, index.b, counts["read"], counts["decoded"]), _HITS)
        out = [*(out or []), hits]
    empty = index.terms.select(F.lit(0).cast("bigint").alias("query_id"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    return ranked(reduce(DataFrame.unionByName, out or [empty]), k)


def _local(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    return spark.createDataFrame(pa.table(columns))
