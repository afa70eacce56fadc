"""The stored text index against the scan of all texts."""

import random

import pyspark.sql.functions as F
import pytest

from quillspark.operators import search, textindex

DOCS, ASKED = "doc_id bigint, text string", "query_id bigint, query string"


def corpus(n, seed=1, vocabulary=400):
    rng = random.Random(seed)
    vocab, weights = [f"w{i}" for i in range(vocabulary)], [1 / (i + 1) for i in range(vocabulary)]
    return [(i * 3, " ".join(["all"] * rng.randint(1, 3) + rng.choices(vocab, weights, k=rng.randint(1, 80)))) for i in range(n)]


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(6000), DOCS).cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return textindex.build(docs, str(tmp_path_factory.mktemp("index") / "a"))


def asked(spark, n=60, seed=2):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(rng.choices([f"w{i}" for i in range(420)] + ["all"], k=rng.randint(1, 12)))) for i in range(n)] + [(900, "all"), (901, ""), (902, None), (903, "nowhere"), (904, "w0 w0 w0 w1"), (905, "all w399")], ASKED)


@pytest.mark.parametrize("k", [1, 10, 3000])
def test_equals_the_scan(spark, docs, index, k):
    q = asked(spark)
    assert rows(textindex.topk(q, index, k)) == rows(search.text_topk(q, docs, k))


def test_reopened_in_another_session(spark, docs, index):
    other = spark.newSession()
    again = textindex.TextIndex.open(other, index.path)
    q = other.createDataFrame(asked(spark, 5).collect(), ASKED)
    assert rows(textindex.topk(q, again, 5)) == rows(search.text_topk(asked(spark, 5), docs, 5))


def test_only_the_asked_folders_are_read(spark, index):
    q = spark.createDataFrame([(1, "w7 w390")], ASKED)
    folders = {r[0] for r in spark.createDataFrame([("w7",), ("w390",)], "t string").select(textindex.bucket("t", index.buckets)).collect()}
    seen = []
    real = index.blocks
    # Every read of the blocks goes through a filter on their folders.
    probe = textindex.TextIndex(**{**index.__dict__, "blocks": Probe(real, seen), "terms": Probe(index.terms, seen)})
    assert textindex.topk(q, probe, 5).count() == 5
    assert len(seen) == 2 and all({f.split("bucket=")[1].split("/")[0] for f in files} == {str(b) for b in folders} for files in seen)


class Probe:
    """A table that notes the files which are left by a filter."""

    def __init__(self, df, seen):
        self.df, self.seen = df, seen

    def where(self, condition):
        out = self.df.where(condition)
        self.seen.append({r[0] for r in out.select(F.input_file_name()).distinct().collect()})
        return out

    def select(self, *columns):
        return self.df.select(*columns)


def test_blocks_are_skipped(spark, docs, index):
    """A common word beside a rare one is only looked at where the rare one stands."""
    counts = {}
    got = rows(textindex.topk(spark.createDataFrame([(1, "all w399")], ASKED), index, 3, counts=counts))
    assert got == rows(search.text_topk(spark.createDataFrame([(1, "all w399")], ASKED), docs, 3))
    held = index.blocks.where("term in ('all', 'w399')").count()
    assert counts["read"].value <= held and counts["decoded"].value < held / 2
    alone = {}
    textindex.topk(spark.createDataFrame([(1, "w0")], ASKED), index, 1, counts=alone).collect()
    assert alone["read"].value < index.blocks.where("term = 'w0'").count() / 2  # left behind before they meet


def test_common_terms_are_divided(index):
    held = index.blocks.where("term = 'all'").groupBy("slice").agg(F.sum("n").alias("n"), F.max("n").alias("m")).collect()
    assert len(held) == textindex.SLICES and sum(r.n for r in held) == 6000 and all(r.m <= textindex.BLOCK for r in held)
    assert index.terms.where("term = 'all'").collect()[0].df == 6000


def test_blocks_hold_every_posting_once(spark, docs, index):
    import numpy as np

    want = {(r.term, r.doc_id): (r.tf, r.length) for r in search.postings(docs).collect()}
    got = {}
    for r in index.blocks.collect():
        ids, tf, length = np.frombuffer(r.docs, np.int64), np.frombuffer(r.tfs, np.int32), np.frombuffer(r.lengths, np.int32)
        assert len(ids) == r.n <= textindex.BLOCK and (ids[0], ids[-1]) == (r.first, r.last) and (np.diff(ids) > 0).all()
        assert np.isclose((tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / index.mean))).max(), r.top)
        got |= {(r.term, i): (a, b) for i, a, b in zip(ids.tolist(), tf.tolist(), length.tolist())}
    assert got == want


def test_blocks_of_queries(spark, docs, index, monkeypatch):
    want = rows(textindex.topk(asked(spark), index, 4))
    monkeypatch.setattr(textindex, "QUERIES", 9)
    assert rows(textindex.topk(asked(spark), index, 4)) == want


def test_odd_tables(spark, tmp_path):
    some = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "a b"), (4, "a a b"), (5, "x " * 50_000)], DOCS)
    q = spark.createDataFrame([(1, "a b x"), (2, None)], ASKED)
    index = textindex.build(some, str(tmp_path / "odd"))
    assert index.documents == 4  # a text without words is a document
    assert rows(textindex.topk(q, index, 10)) == rows(search.text_topk(q, some.where("doc_id is not null"), 10))
    empty = textindex.build(some.where("false"), str(tmp_path / "none"))
    assert textindex.topk(q, empty, 10).count() == 0
    with pytest.raises(ValueError, match="repeat"):
        textindex.build(some.union(some), str(tmp_path / "twice"))


def test_terms_are_written_without_a_sample(spark, tmp_path, monkeypatch):
    """Ranges sample what they deal; only the blocks are dealt so, whose rows are read from files.  The
    steps of a term's parts are those of a plain count."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    ranges = []
    monkeypatch.setattr(Frame, "repartitionByRange", lambda self, *a, real=Frame.repartitionByRange: ranges.append(a) or real(self, *a))
    docs = spark.createDataFrame([(i, " ".join(["common"] * (i % 9 + 1) + [f"w{i % 4}"] * (i % 3))) for i in range(60)], "doc_id bigint, text string")
    index = textindex.build(docs, str(tmp_path / "i"))
    assert len(ranges) == 1
    parts = {}
    for r in textindex.prepared(spark).createDataFrame([(i, t, n, i % 9 + 1 + i % 3) for i in range(60) for t, n in (("common", i % 9 + 1), (f"w{i % 4}", i % 3)) if n], "i int, term string, tf int, length int").withColumn("p", textindex.part(F.col("tf"), F.col("length"), index.mean, index.k1, index.b)).collect():
        parts.setdefault(r.term, []).append(int(r.p * (textindex.LEVELS / (index.k1 + 1)) // 1))
    for r in index.terms.collect():
        held = sorted(parts.pop(r.term), reverse=True)
        assert r.df == len(held) and [r[f"top{k}"] for k in textindex.RANKS] == [held[k - 1] if k <= len(held) else None for k in textindex.RANKS]
    assert not parts


def test_slices_are_bounded_by_words(spark, tmp_path, monkeypatch):
    """Long texts make more slices; results stay the scan's."""
    monkeypatch.setattr(textindex, "SLICE_WORDS", 400, raising=False)
    some = spark.createDataFrame([(i, " ".join(["all"] * 40 + [f"w{i % 7}"] * (i % 5))) for i in range(200)], DOCS)
    index = textindex.build(some, str(tmp_path / "words"))
    words = some.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    held = index.blocks.groupBy("slice").agg(F.sum("n").alias("n")).collect()
    assert len(held) > 2 * textindex.SLICES and index.blocks.agg(F.max("slice")).first()[0] < -(-words // 400)
    q = spark.createDataFrame([(1, "all w3"), (2, "w5 w6")], ASKED)
    assert rows(textindex.topk(q, index, 5)) == rows(search.text_topk(q, some, 5))


def test_a_slice_is_not_copied():
    """Postings that a task has got stay where they are, whatever order their blocks come in."""
    import numpy as np
    import pyarrow as pa

    def blocks(tids):
        n = [textindex.BLOCK] * len(tids)
        docs = [np.arange(128, dtype=np.int64) + 128 * i for i in range(len(tids))]
        cut = lambda kind: pa.array([np.full(128, 3, kind).tobytes() for _ in n])
        return pa.table([pa.array(tids, pa.int32()), pa.array([d[0] for d in docs]), pa.array([d[-1] for d in docs]), pa.array(np.linspace(1, 2, len(n))), pa.array([d.tobytes() for d in docs]), cut(np.int32), cut(np.int32)], names=["tid", "first", "last", "top", "docs", "tfs", "lengths"])

    table = pa.concat_tables([blocks([3, 1] * 500), blocks([2, 0] * 500)])
    before = pa.total_allocated_bytes()
    held = textindex._Slice(table, 3.0, 1.2, 0.75)
    assert pa.total_allocated_bytes() - before < table.nbytes / 10
    docs, _ = held.decoded(held.of[1])
    assert len(docs) == 500 * 128 and (np.diff(docs) > 0).all()
