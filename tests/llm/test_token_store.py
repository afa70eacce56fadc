import glob
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import token_store as ts
from quillspark.llm.common import scratch_path

from .conftest import words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(whole):
    encoder, rng = ts.Encoder(PATH, remembered=500), random.Random(4)
    signs = [*"ab \n\t.,1²'", "é", "Ω", "’", "ж", "_", "-", "ſ", "́", "'s", "'re", " x", "  ", " ", "\x1c", "日", "<|endoftext|>"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(4000)] + [words(i, 50) for i in range(50)]
    assert [x.tolist() for x in encoder.encode(texts)] == [whole(t) for t in texts]


def test_pieces_around_apostrophes_and_any_characters(whole):
    import unicodedata

    encoder, rng = ts.Encoder(PATH, remembered=300), random.Random(6)
    near = [*"ab' ", "é", "×", "“", "ß", "'s", " '", "ª", "µ", "\xad", "…", "\x85", "\u3000", "\u2028", "ɏ"]
    every = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) != "Cs"]
    texts = ["".join(rng.choices(near, k=rng.randint(0, 9))) for _ in range(4000)]
    texts += ["".join(rng.choices(every, k=2) + rng.choices(near, k=3) + rng.choices(every, k=1) + rng.choices(near, k=2)) for _ in range(8000)]
    for at in range(0, len(texts), 900):  # the encoder forgets in between
        part = texts[at : at + 900]
        assert [x.tolist() for x in encoder.encode(part)] == [whole(t) for t in part]


def test_pieces_of_one_hash_are_told_apart(whole, monkeypatch):
    """A piece whose hash is another's is seen by its other hash; its text is encoded whole."""
    encoder = ts.Encoder(PATH)
    monkeypatch.setattr(ts.tv, "mix", lambda x: x & np.uint64(0xFF))
    texts = [words(i, 30) for i in range(60)]
    assert [x.tolist() for x in encoder.encode(texts)] == [whole(t) for t in texts]


def test_round_trip(make, whole, spark):
    shared = words(1, 3000)
    rows = [(2 * i, words(i, 5 * i)) for i in range(60)] + [(501, shared), (503, shared), (505, words(9, 700) + " " + shared + " end"), (-3, None), (601, ""), (7, "twice"), (7, "twice")]
    docs, path = make(rows), scratch_path(spark, "test")
    ts.write(docs, path, PATH)
    got = sorted((r.start, r) for r in ts.read_digests(spark, path).collect())
    at = 0
    for (start, r), (i, t) in zip(got, sorted(rows, key=lambda x: x[0])):
        ids = np.array([*whole(t), 0], "<u4")
        assert (start, r.doc_id, r.n_tokens, r.ids_crc32, r.verified) == (at, i, len(ids), zlib.crc32(ids.tobytes()), True)
        at += len(ids)
    rebuilt = {r.start: r.ids for r in ts.read_ids(spark, path).collect()}
    assert [rebuilt[s] for s, _ in got] == [[*whole(t), 0] for _, t in sorted(rows, key=lambda x: x[0])]
    stored = ts._chunks(spark, path).collect()
    assert len(stored) == len({bytes(r["hash"]) for r in stored})
    uses = spark.read.parquet(f"{path}/chunks").count()
    assert uses > len(stored) + 3  # shared passages are stored once


def test_heavy_chunks_are_read_the_same(make, spark, monkeypatch):
    from quillspark.llm import common

    shared = words(1, 2000)
    path = scratch_path(spark, "heavy")
    ts.write(make([(i, shared if i % 3 else words(i, 300)) for i in range(60)]), path, PATH)
    plain = sorted(ts.read_digests(spark, path).collect())
    monkeypatch.setattr(common, "HEAVY", 5)
    assert sorted(ts.read_digests(spark, path).collect()) == plain and all(r.verified for r in plain)


def test_damage_is_seen(make, spark):
    path = scratch_path(spark, "damaged")
    ts.write(make([(1, words(1, 900)), (2, words(2, 50))]), path, PATH)
    good = {r.doc_id: r.verified for r in ts.read_digests(spark, path).collect()}
    bad = spark.read.parquet(f"{path}/chunks").toPandas()
    k = bad.index[(bad.doc_id == 1) & bad.data.notna()][0]
    ids = ts.unpack(bad.data[k]).copy()
    ids[0] ^= 1
    import zstandard

    bad.at[k, "data"] = ts.pack(ids, zstandard.ZstdCompressor())
    spark.createDataFrame(bad, ts._CHUNK).write.mode("overwrite").parquet(f"{path}/chunks")
    assert good == {1: True, 2: True} and {r.doc_id: r.verified for r in ts.read_digests(spark, path).collect()} == {1: False, 2: True}


def test_special_tokens_as_in_a_plain_call(make):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> <|endoftext|>y's", "<|endoftext", "hello <|endoftext|> world"]
    plain = Tokenizer.from_file(PATH)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in ts.Encoder(PATH).encode(texts)] == want and want[0] == [64, 50256, 65]
    got = {r.doc_id: r.ids_crc32 for r in ts.round_trip(make(list(enumerate(texts))), PATH).collect()}
    assert got == {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(want)}


def _files(path, part):
    return sorted(glob.glob(f"{path.removeprefix('file://')}/{part}/part-*.parquet"))


@pytest.fixture
def store(make, spark):
    path = scratch_path(spark, "lost")
    ts.write(make([(i, words(i, 200 + i)) for i in range(40)]), path, PATH)
    assert all(r.verified for r in ts.read_digests(spark, path).collect())
    return path


def test_a_lost_recipe_file_fails_the_read(spark, store):
    os.remove(max(_files(store, "recipes"), key=os.path.getsize))
    with pytest.raises(ValueError, match="missing or unsound"):
        ts.read_digests(spark, store)


def test_a_lost_chunk_file_is_seen(spark, store):
    os.remove(max(_files(store, "chunks"), key=os.path.getsize))
    got = ts.read_digests(spark, store).collect()
    assert len(got) == 40 and not all(r.verified for r in got)
    with pytest.raises(Exception, match="missing or unsound"):
        ts.read_ids(spark, store).collect()


def test_an_altered_manifest_fails_the_read(spark, store):
    rows = spark.read.parquet(f"{store}/manifest").toPandas()
    spark.createDataFrame(rows.iloc[1:], ts._MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest")
    with pytest.raises(ValueError, match="unsound"):
        ts.read_digests(spark, store)


def test_an_altered_recipe_is_seen(spark, store):
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{store}/recipes").withColumn("root", F.when(F.col("doc_id") == 3, F.lit(bytes(16))).otherwise(F.col("root")))
    other = scratch_path(spark, "altered")
    rows.write.parquet(f"{other}/recipes")
    spark.read.parquet(f"{store}/manifest").write.parquet(f"{other}/manifest")
    spark.read.parquet(f"{store}/chunks").write.parquet(f"{other}/chunks")
    with pytest.raises(ValueError, match="missing or unsound"):
        ts.read_digests(spark, other)


def test_clashing_columns(make):
    from pyspark.sql import functions as F

    docs = make([(1, "some words"), (2, "more")]).withColumns({"uid": F.lit("x"), "hash": F.lit("y"), "part": F.lit(9), "start": F.lit(8)})
    assert sorted((r.doc_id, r.start, r.verified) for r in ts.round_trip(docs, PATH).collect()) == [(1, 0, True), (2, 3, True)]


def test_crc_of_parts_adds_up():
    rng = np.random.default_rng(0)
    data = rng.bytes(5000)
    cuts = [0, 17, 1300, 1301, 5000]
    parts = [(zlib.crc32(data[a:b]), len(data) - b) for a, b in zip(cuts, cuts[1:])]
    assert np.bitwise_xor.reduce(ts.moved(np.array([c for c, _ in parts]), np.array([n for _, n in parts]))) == zlib.crc32(data)


def test_odd_rows(odd, none):
    got = ts.round_trip(odd, PATH).collect()
    assert len(got) == odd.count() and all(r.verified for r in got)
    assert ts.round_trip(none, PATH).collect() == []
