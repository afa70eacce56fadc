"""Stores by key: merged batches, appends of what is absent."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.plans import queries
from quillspark.sources import keyed

SCHEMA = "k bigint, v string, t int"


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_its_folders_only(spark, tmp_path):
    store = keyed.KeyedStore(spark, str(tmp_path / "s"), "k", buckets=16)
    store.merge(spark.createDataFrame([(i, f"v{i}", 0) for i in range(400)], SCHEMA))
    before = files(store.path + "/rows")
    store.merge(spark.createDataFrame([(3, "new", 1), (3, None, 2), (3, "older", 0), (1000, "more", 1)], SCHEMA), order="t")
    after = files(store.path + "/rows")
    touched = {f.split("_bucket=")[1].split("/")[0] for f in (before.keys() | after.keys()) if before.get(f) != after.get(f)}
    assert 1 <= len(touched) <= 2
    assert {f for f in before if f.split("_bucket=")[1].split("/")[0] not in touched} <= {f for f in after if before.get(f) == after[f]}
    got = {r.k: (r.v, r.t) for r in store.read().collect()}
    assert len(got) == 401 and got[3] == ("v3", 2) and got[1000] == ("more", 1) and got[4] == ("v4", 0)
    assert [(r.k, r.v) for r in store.lookup([7]).collect()] == [(7, "v7")]


def test_a_replayed_batch_does_nothing(spark, tmp_path):
    store = keyed.KeyedStore(spark, str(tmp_path / "s"), "k", buckets=4)
    batch = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA)
    assert store.merge(batch, batch_id="x-0")
    before = files(store.path)
    assert not store.merge(spark.createDataFrame([(1, "z", 9)], SCHEMA), batch_id="x-0") and files(store.path) == before
    assert store.merge(batch, batch_id="x-1")  # one that failed before its mark was set comes again as itself
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, "a", 1), (2, "b", 1)]


def test_random_batches_against_a_dict(spark, tmp_path):
    rng, want = random.Random(1), {}
    store = keyed.KeyedStore(spark, str(tmp_path / "s"), "k", buckets=8)
    for n in range(4):
        rows = [(rng.randint(0, 60), rng.choice([None, f"b{n}"]), rng.choice([None, n])) for _ in range(30)]
        rows = list({r[0]: r for r in rows}.values())
        for k, v, t in rows:
            a, b = want.get(k, (None, None))
            want[k] = (v if v is not None else a, t if t is not None else b)
        store.merge(spark.createDataFrame([*rows, (None, "x", 1)], SCHEMA))
    assert {r.k: (r.v, r.t) for r in keyed.KeyedStore(spark.newSession(), store.path, "k", buckets=8).read().collect()} == want


def test_columns_are_added(spark, tmp_path):
    store = keyed.KeyedStore(spark, str(tmp_path / "s"), "k", buckets=8)
    store.merge(spark.createDataFrame([(i, "v") for i in range(20)], "k bigint, v string"))
    store.merge(spark.createDataFrame([(3, 1.5)], "k bigint, w double"))
    assert {r.k: (r.v, r.w) for r in store.read().collect()} == {i: ("v", 1.5 if i == 3 else None) for i in range(20)}
    store.merge(spark.createDataFrame([], "k bigint, v string"))
    assert store.read().count() == 20


def test_a_stream_of_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame([(i, f"s{n}", n) for i in range(n, n + 5)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    store = keyed.KeyedStore(spark, str(tmp_path / "s"), "k", buckets=4)

    def run():
        q = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(store.writer("in", "t")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    first = files(store.path)
    run()  # nothing new
    assert files(store.path) == first
    assert {r.k: r.v for r in store.read().collect()} == {0: "s0", 1: "s1", 2: "s2", 3: "s2", 4: "s2", 5: "s2", 6: "s2"}


def test_an_append_reads_the_files_that_may_hold_a_key(spark, tmp_path):
    path = str(tmp_path / "a")
    for n in range(5):  # files of their own ranges
        keyed.append_absent(spark.createDataFrame([(f"{n}-{i:03}", n) for i in range(100)], "k string, n int").coalesce(1), path, "k")
    read = []
    keyed.append_absent(spark.createDataFrame([("2-050", 9), ("2-999", 9), ("2-999", 9), (None, 9), ("zz", 9)], "k string, n int"), path, "k", read=read)
    assert len(read) == 1  # that of 2-050
    got = {r.k: r.n for r in spark.read.parquet(path).collect()}
    assert len(got) == 502 and got["2-050"] == 2 and got["2-999"] == 9 == got["zz"]
    keyed.append_absent(spark.createDataFrame([("none", 9)], "k string, n int"), path, "k", read=(again := []))
    assert again == []


def test_no_key_is_taken_for_absent(spark, tmp_path):
    rng, path, want = random.Random(2), str(tmp_path / "a"), set()
    for n in range(4):
        batch = [rng.randint(0, 300) for _ in range(80)]
        want |= set(batch)
        keyed.append_absent(spark.createDataFrame([(x,) for x in batch], "k bigint"), path, "k")
    # A file that another writer put there has no filter, so it is read.
    spark.createDataFrame([(5000,)], "k bigint").coalesce(1).write.mode("append").parquet(path)
    keyed.append_absent(spark.createDataFrame([(5000,), (5001,)], "k bigint"), path, "k", read=(read := []))
    assert len(read) >= 1
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == sorted(want | {5000, 5001})


@pytest.mark.parametrize("keys", [[], [None]])
def test_empty_appends(spark, tmp_path, keys):
    path = str(tmp_path / "a")
    keyed.append_absent(spark.createDataFrame([(k,) for k in keys], "k bigint"), path, "k")
    keyed.append_absent(spark.createDataFrame([(1,)], "k bigint"), path, "k")
    assert [r.k for r in spark.read.parquet(path).collect()] == [1]


def test_pages_of_one_address_are_all_appended(spark, tmp_path):
    """Rows of one batch that repeat a key aren't there yet for each other."""
    pages = [(0, "http://a/x"), (1, "http://a/x"), (2, "http://a/y"), (4, "http://a/y"), (5, "http://a/z"), (6, "http://a/w"), (9, "http://a/w"), (10, None)]
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.queries()["write_if_absent"](spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got) == [2, 4, 5]
