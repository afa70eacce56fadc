import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from quillspark.llm import bagminhash as bmh
from quillspark.llm import textvec as tv
from quillspark.llm.components import components

from .conftest import words


def bag(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def edited(text, n, seed):
    rng = random.Random(seed)
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = "zz" + w[i]
    return " ".join(w)


def brute(rows):
    """least id of each component of links of 0.8 or more"""
    bags = {i: bag(t) for i, t in rows}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and (bags[a] == bags[b] or jaccard(bags[a], bags[b]) >= 0.8):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in bags}


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    errors = []
    for k in range(60):
        base = [f"w{rng.randint(0, 60)}" for _ in range(200)]
        other = [x if rng.random() > k / 150 else f"v{rng.randint(0, 60)}" for x in base]
        w = tv.split(*tv.buffers(pa.array([" ".join(base), " ".join(other)])))
        b = tv.bags(w.row_of(), w.hash, 2)
        s = bmh.signatures(b, 2, 512)
        errors.append((s[0] == s[1]).mean() - jaccard(Counter(base), Counter(other)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035


def test_classes_against_brute_force(make):
    rows, i = [], 0
    for g in range(12):
        base = words(g, 80 + 10 * g)
        for k in range(1 + g % 6):
            rows.append((i, edited(base, k % 4, i)))
            i += 1
        rows.append((i, base))
        i += 1
    rows += [(i + k, "the same words " * 12) for k in range(30)] + [(i + 30, "the same words " * 11)]
    got = {r.doc_id: r.class_id for r in bmh.near_duplicates(make(rows)).collect()}
    assert got == brute(rows)


def test_heavy_classes_are_named_the_same(make, monkeypatch):
    from quillspark.llm import common

    rows = [(i, "the same words " * (5 + i % 2)) for i in range(60)] + [(100 + i, words(i, 40)) for i in range(20)]
    monkeypatch.setattr(common, "HEAVY", 7)
    got = {r.doc_id: (r.class_id, r.copy_of) for r in bmh.near_duplicates(make(rows)).collect()}
    assert {i: c for i, (c, _) in got.items()} == brute(rows) and len(got) == 80 and got[58][1] == 0


def test_large_family_of_near_copies(make):
    """Members of one family that are too far apart to be linked are joined by others."""
    base = words(5, 400)
    rows = [(i, edited(base, 1 + i % 8, i)) for i in range(250)] + [(1000 + i, words(100 + i, 60)) for i in range(50)]
    got = {r.doc_id: r.class_id for r in bmh.near_duplicates(make(rows)).collect()}
    assert got == brute(rows)


def test_members_at_the_edge_of_a_family(make):
    """Texts that have a link or two in a family of hundreds, none of them to a central text."""
    base = words(5, 400)
    rows = [(i, edited(base, 1 + i % 9, i)) for i in range(250)]
    got, want = {r.doc_id: r.class_id for r in bmh.near_duplicates(make(rows)).collect()}, brute(rows)
    assert got == want


def brute_sets(rows):
    """brute() for many texts without repeated shingles: shared shingles by a matrix product"""
    sets = [set(bag(t)) for _, t in rows]
    often = Counter(x for s in sets for x in s)
    at = {x: k for k, x in enumerate(x for x in often if often[x] > 1)}
    held = np.zeros((len(rows), len(at)), np.float32)
    for i, s in enumerate(sets):
        held[i, [at[x] for x in s if x in at]] = 1
    both, size = held @ held.T, np.array([len(s) for s in sets])
    root = np.array([i for i, _ in rows])
    for a, b in zip(*np.nonzero(np.triu(both / (size[:, None] + size[None, :] - both) >= 0.8, 1))):
        x, y = sorted((root[a], root[b]))
        root[root == y] = x
    return {i: int(r) for (i, _), r in zip(rows, root)}


def test_pairs_in_a_large_family_of_template_texts(make):
    """Texts of one template just under the threshold to each other, with pairs planted among them."""
    base = words(5, 400)
    rows = [(i, edited(base, 7, i)) for i in range(1900)]
    rows += [(5000 + i, edited(rows[19 * i][1], 2, 9000 + i)) for i in range(100)]
    got, want = {r.doc_id: r.class_id for r in bmh.near_duplicates(make(rows)).collect()}, brute_sets(rows)
    assert 500 < len(set(want.values())) < 1950
    assert got == want


def test_blocks_of_a_family(make, monkeypatch):
    """The same links come out where a bucket takes several blocks."""
    base = words(6, 300)
    rows = [(i, edited(base, 5, i)) for i in range(120)]
    rows += [(500 + i, edited(rows[3 * i][1], 1, 900 + i)) for i in range(30)]
    monkeypatch.setattr(bmh, "BLOCK", 16)
    assert {r.doc_id: r.class_id for r in bmh.near_duplicates(make(rows)).collect()} == brute_sets(rows)


def test_a_large_family_with_outliers_costs_rows_in_proportion(make, monkeypatch, spark):
    """Members of the largest component are dealt once, whatever the number of blocks."""
    monkeypatch.setattr(bmh, "BLOCK", 16)
    apart = spark.createDataFrame([(7, 0, i, 1 if i < 400 else i, i < 400) for i in range(420)], "bucket bigint, band int, cid bigint, component bigint, main boolean")
    sizes = spark.createDataFrame([(7, 25, 2)], "bucket bigint, blocks bigint, others bigint")
    dealt = bmh._blocked(apart, sizes).collect()
    assert len(dealt) == 400 + 20 * (25 + 2)
    met = {(r.x, r.y): {s.cid for s in dealt if (s.x, s.y) == (r.x, r.y)} for r in dealt}
    for a in range(400, 420):
        assert {b for v in met.values() if a in v for b in v} == set(range(420))


def test_one_of_each_class_stays(make):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g!"), (9, "other words stand in here now"), (3, "A b c d e f g!"), (None, "a b c d e f g"), (3, "again quite different words with that id")]
    got = sorted((r.doc_id, r.text) for r in bmh.deduplicate(make(rows)).collect())
    assert got == [(3, "A b c d e f g!"), (3, "again quite different words with that id"), (9, "other words stand in here now")]


def test_odd_rows_and_clashing_columns(odd, none):
    docs = odd.withColumns({"class_id": F.lit("x"), "cid": F.lit("y"), "sig": F.lit("z")})
    got = bmh.near_duplicates(docs).collect()
    assert len(got) == odd.count()
    assert len({(r.class_id) for r in got if r.doc_id == 4}) == 1
    assert bmh.near_duplicates(none).collect() == [] and bmh.deduplicate(none).collect() == []
    assert bmh.deduplicate(docs).columns == docs.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (200, 200)] + [(300, 300 + k) for k in range(1, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 103)} == {100} and 200 not in got
    assert {got[300 + k] for k in range(60)} == {300}


def test_null_and_repeated_ids_meet_their_own_class_only(make, spark):
    """Near copies without ids and under one id: each class's text is found once, by its key."""
    texts = [t for i in range(400) for t in (words(i, 60), edited(words(i, 60), 1, i))]
    rows = [(None, t) for t in texts[:400]] + [(7, t) for t in texts[400:]]
    docs = make(rows)
    assert bmh.deduplicate(docs).count() == 400
    plain = docs.selectExpr("doc_id doc", "text words")
    classes = docs.select("doc_id", "text").mapInArrow(bmh._sign("text"), "doc_id bigint, class_key binary, sig binary").groupBy("class_key").agg(F.min("doc_id").alias("want")).withColumn("cid", F.monotonically_increasing_id()).cache()
    bags = bmh.class_bags(plain, classes)
    assert classes.count() == 800 and bags.count() == 800 and bags.select("cid").distinct().count() == 800
    assert "NestedLoop" not in bags._jdf.queryExecution().toString() and "Cartesian" not in bags._jdf.queryExecution().toString()


def test_every_candidate_can_be_verified(make):
    rows = [(i, edited(words(3, 80), 1 + i % 9, i)) for i in range(120)]
    got = {r.doc_id: r.class_id for r in bmh.near_duplicates(make(rows), estimate=0.0).collect()}
    assert got == brute(rows)
