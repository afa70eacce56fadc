"""The stored vector index against all rows."""

import numpy as np
import pyspark.sql.functions as F
import pytest

from quillspark.operators import ann, search

SCHEMA = "doc_id bigint, vector array<float>"


def vectors(kind, n=4000, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    if kind == "clusters":
        v += 3 * rng.standard_normal((30, dim))[rng.integers(0, 30, n)]
    if kind == "hot":
        v[: n // 3] = v[0] + 0.01 * rng.standard_normal((n // 3, dim))
    return v


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, x) for i, x in enumerate(np.asarray(v, np.float32).tolist())], SCHEMA)


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


@pytest.mark.parametrize("kind", ["plain", "clusters", "hot"])
def test_recall_with_a_twentieth_of_the_rows(spark, tmp_path, kind):
    docs = table(spark, vectors(kind)).cache()
    asked = docs.where("doc_id % 40 = 1").withColumnRenamed("doc_id", "query_id")
    index = ann.build(docs, str(tmp_path / "i"))
    got, want = ann.topk(asked, index, 10).collect(), search.vector_topk(asked, docs, 10).collect()
    if kind == "hot":  # hundreds of rows are nearly as near: scores tell
        near = {(r.query_id, r["rank"]): r.score for r in want}
        assert len(got) == len(want) and np.mean([r.score >= near[r.query_id, r["rank"]] - 1e-3 for r in got]) >= 0.9
    else:
        same = {(r.query_id, r.doc_id) for r in got} & {(r.query_id, r.doc_id) for r in want}
        assert len(got) == len(want) and len(same) / len(want) >= 0.9
    assert index.rows == 4000 and len(index.centres) == 63
    if kind == "clusters":
        assert index.probes <= len(index.centres) // 3  # clusters narrow the scan
    held = index.cells.groupBy("list").agg(F.sum("n").alias("n"), F.max("n").alias("m")).collect()
    assert sum(r.n for r in held) == 4000 and max(r.m for r in held) <= ann.CELL


def test_reopened_in_another_session_and_exact_with_all(spark, tmp_path):
    docs = table(spark, vectors("plain", 500, 30))
    asked = docs.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    ann.build(docs, str(tmp_path / "i"))
    other = spark.newSession()
    index = ann.Index.open(other, str(tmp_path / "i"))
    mine = other.createDataFrame(asked.collect(), "query_id bigint, vector array<float>")
    found = lambda d: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in d.collect())
    assert found(ann.topk(mine, index, 7, probes=len(index.centres), scored=500)) == found(search.vector_topk(asked, docs, 7))


def test_hot_list_is_divided(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 100)
    docs = table(spark, vectors("hot", 1500, 16))
    index = ann.build(docs, str(tmp_path / "i"))
    most = index.cells.groupBy("list").agg(F.count("*").alias("c"), F.sum("n").alias("n")).orderBy(F.desc("n")).first()
    assert most.c >= -(-most.n // 100) and index.cells.agg(F.max("n")).first()[0] <= 100


def test_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, None), (None, [1.0, 1.0, 1.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0, 1.0, 0.0])], SCHEMA)
    asked = spark.createDataFrame([(7, [1.0, 0.1, 0.0]), (8, None)], "query_id bigint, vector array<float>")
    index = ann.build(docs, str(tmp_path / "odd"))
    got = ann.topk(asked, index, 10, probes=9, scored=10).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got) == [(7, 1, 1), (7, 1, 3), (7, 3, 4), (7, 4, 2)]
    none = ann.build(docs.where("vector is null"), str(tmp_path / "none"))
    assert ann.topk(asked, none, 10).collect() == []


def test_cells_are_scanned_by_all_cores(spark, tmp_path, monkeypatch):
    """However few bytes they are."""
    from pyspark import TaskContext

    def scanner(spread, deep):
        def run(batches):
            import pyarrow as pa

            if any(b.num_rows for b in batches):
                yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([TaskContext.get().partitionId()]), pa.array([1.0])], ["query_id", "doc_id", "score"])

        return run

    monkeypatch.setattr(ann, "CELL", 50)
    docs = table(spark, vectors("plain", 2000, 16))
    index = ann.build(docs, str(tmp_path / "i"))
    monkeypatch.setattr(ann, "_scanner", scanner)
    asked = docs.where("doc_id = 1").withColumnRenamed("doc_id", "query_id")
    assert ann.topk(asked, index, 100).count() >= spark.sparkContext.defaultParallelism


def test_originals_are_fetched_once_for_all_queries(spark, tmp_path, monkeypatch):
    """Also for an id that stands for two queries; scores are the scan's."""
    seen = spark.sparkContext.accumulator(0)

    def counted(spread, k, real=ann._rescorer):
        def run(batches):
            def each():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            yield from real(spread, k)(each())

        return run

    monkeypatch.setattr(ann, "_rescorer", counted)
    docs = table(spark, vectors("plain", 600, 16))
    asked = docs.where("doc_id < 40").withColumn("query_id", F.expr("doc_id % 39")).drop("doc_id")
    index = ann.build(docs, str(tmp_path / "i"))
    got = sorted((r.query_id, r.doc_id, r.score) for r in ann.topk(asked, index, 30, probes=len(index.centres), scored=600).collect() if r.query_id)
    assert seen.value == 600
    assert got == sorted((r.query_id, r.doc_id, r.score) for r in search.vector_topk(asked.where("query_id > 0"), docs, 30).collect())


@pytest.mark.parametrize("gathered", [0, 1 << 19])
def test_best_rows_of_a_task(monkeypatch, gathered):
    """Thinned out early or late, with ties that only rounding makes, with a bound for each query."""
    monkeypatch.setattr(search, "GATHERED", gathered, raising=False)
    rng = np.random.default_rng(3)
    scores, docs = np.round(rng.random((500, 4)), 2) + rng.uniform(-4e-10, 4e-10, (500, 4)), rng.permutation(500)
    scores[7, :] = np.nan
    top = search._Top(np.array([5, 6, 7, 8]), 20, np.array([-2.0, -2.0, 0.99, 2.0]))
    for a in range(0, 500, 60):
        top.add(docs[a : a + 60], scores[a : a + 60], 9)
    got = [r for b in top.rows() for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
    every = [[(-s, d) for s, d in zip(np.round(scores[:, j], 9), docs) if s >= (0.99 if j == 2 else 2.0 if j == 3 else -2)] for j in range(4)]
    assert got == [(5 + j, d, -s) for j in range(4) for s, d in sorted(every[j])[:20]]
