import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import simhash
from quillspark.llm import textvec as tv

from .conftest import words


def test_edits_against_brute_force(make):
    rows = [(3 * i % 101, words(i, 3 + i % 50)) for i in range(101)]
    got = {r.doc_id: r for r in simhash.compare_edits(make(rows)).collect()}
    order = sorted(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        k = len(t) // 4
        new = t[: len(t) - k] + nxt[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (x.tobytes() for x in simhash.fingerprints(pa.array([t, new, nxt])))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (a.hex(), b.hex())
        apart = lambda x, y: (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
        assert (got[i].near_edited, got[i].near_next) == (1 - apart(a, b) / 128, 1 - apart(a, c) / 128)


def plain_fingerprint(text):
    """SimHash of one text by loops over terms and bits, with hashes of terms from the module"""
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    terms = Counter(" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else Counter()
    votes = [0] * 128
    for term, n in terms.items():
        w = tv.split(*tv.buffers(pa.array([term])))
        h = tv.windows(w, len(w.hash))[:1]
        wide = h.tobytes() + tv.mix(h ^ np.uint64(0x94D049BB133111EB)).tobytes()
        weight = round(128 * (1 + math.log(n)))
        for b in range(128):
            votes[b] += weight if (wide[b // 8] >> (7 - b % 8)) & 1 else -weight
    return "".join("1" if v > 0 else "0" for v in votes)


def test_fingerprints_against_loops():
    texts = [words(i, i) for i in range(0, 60, 7)] + ["", "One", "a b c", "the same words " * 40, "Été, über! " * 9 + words(3, 30), words(1, 9000)]
    got = simhash.fingerprints(pa.array(texts))
    assert ["".join(f"{b:08b}" for b in row) for row in got.tolist()] == [plain_fingerprint(t) for t in texts]


def test_likeness_follows_overlap(make):
    rows = [(i, words(i, 300)) for i in range(40)]
    got = simhash.compare_edits(make(rows)).collect()
    assert sum(r.near_edited for r in got) / 40 > 0.72 and sum(r.near_next for r in got) / 40 < 0.62
    assert sum(r.near_edited <= r.near_next for r in got) <= 1


def test_search_finds_all_within_the_radius(spark):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(30)]
    every = base + [b ^ sum(1 << p for p in rng.sample(range(128), rng.randint(0, 9))) for b in base for _ in range(5)]
    fps = [format(x, "032x") for x in every]
    df = spark.createDataFrame([(f,) for f in fps + [None]], "fingerprint string")
    got = {(r.fingerprint, r.near): r.distance for r in simhash.search(df, df).collect()}
    want = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a in set(fps) for b in set(fps)}
    assert got == {k: d for k, d in want.items() if d <= simhash.RADIUS}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 7])
def test_counts_of_all_within_the_radius(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(8)]
    every = base + [b ^ sum(1 << p for p in rng.sample(range(128), rng.randint(0, 5))) for b in base for _ in range(30)]
    rows = [(format(x, "032x"), i % 3 == 0) for i, x in enumerate(every)] + [(None, True), (format(base[0], "032x"), True)]
    got = {r.fingerprint: r.n_near for r in simhash.near_counts(spark.createDataFrame(rows, "fingerprint string, asked boolean")).collect()}
    want = {f: sum(0 < (int(f, 16) ^ x).bit_count() <= simhash.RADIUS for x in set(every)) for f, a in rows if f and any(a2 for f2, a2 in rows if f2 == f)}
    assert got == {f: n for f, n in want.items() if n}


def test_the_query_counts_neighbours(make):
    rows = [(i, words(i // 10, 300)[: -1 - i % 4]) for i in range(100)]
    got = {r.doc_id: r for r in simhash.compare_edits(make(rows)).collect()}
    prints = {r.fingerprint for r in got.values()}
    for i, r in got.items():
        near = sum(0 < (int(r.fingerprint, 16) ^ int(f, 16)).bit_count() <= simhash.RADIUS for f in prints)
        assert r.n_near == (near if i % 20 == 0 else None)


def test_clashing_columns(make):
    from pyspark.sql import functions as F

    docs = make([(i, words(i, 30)) for i in range(25)])
    more = docs.withColumns({c: F.lit("x") for c in ("bucket", "tail", "fingerprint", "asked", "table", "key", "f")})
    assert sorted(simhash.compare_edits(more).collect(), key=str) == sorted(simhash.compare_edits(docs).collect(), key=str)


def test_odd_rows(odd, none, make):
    got = simhash.compare_edits(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.near_edited <= 1 for r in got)
    assert simhash.compare_edits(none).collect() == []
    one = simhash.compare_edits(make([(1, "abcdefgh")])).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert "fingerprint" in simhash.with_fingerprint(odd).columns
