"""Patterns in texts and points in ranges, against loops."""

import random

import pyspark.sql.functions as F
import pytest

from quillspark.operators import intervals, patterns


def first(texts, found):
    out = []
    for i, t in texts:
        places = [place for p, place in found if t is not None and p is not None and p in t]
        if places:
            out.append((i, min(places)))
    return sorted(out, key=repr)


def scanned(spark, texts, found):
    a, b = spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame(found, "p string, place bigint")
    return sorted((tuple(r) for r in patterns.first_found(a, b).collect()), key=repr)


@pytest.mark.parametrize("chars", [4 << 20, 60])
def test_patterns_against_a_loop(spark, monkeypatch, chars):
    monkeypatch.setattr(patterns, "BLOCK_CHARS", chars)
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcđ ") for _ in range(n))
    texts = [(i, make(rng.randint(0, 40))) for i in range(300)] + [(900, None), (901, ""), (902, "x" * 100_000 + "abc")]
    found = [(make(rng.randint(1, 5)), rng.randint(0, 90)) for _ in range(60)] + [(None, 1), ("zzz", 0)]
    assert scanned(spark, texts, found) == first(texts, found)


def test_empty_patterns_and_tables(spark):
    texts = [(1, "abc"), (2, ""), (3, None)]
    assert scanned(spark, texts, [("", 5), ("b", 2)]) == [(1, 2), (2, 5)]
    assert scanned(spark, texts, []) == [] and scanned(spark, [], [("a", 1)]) == []


def test_a_hundred_thousand_patterns(spark):
    found = [(f"p{i}q", i) for i in range(100_000)]
    texts = [(i, f"some text with p{i * 97}q and p{i * 89 + 1}q in it") for i in range(1000)]
    a, b = spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame(found, "p string, place bigint")
    df = patterns.first_found(a, b)
    assert "NestedLoop" not in df._jdf.queryExecution().toString()
    assert {r.id: r.place for r in df.collect()} == {i: min(i * 97, i * 89 + 1) for i in range(1000)}


def ranges_of(rng, n):
    out = []
    for i in range(n):
        a = rng.randint(-500, 500)
        out.append((a, a + int(2 ** rng.uniform(-1, 11)), f"r{i}"))
    return out + [(1, 10**9, "wide"), (-(2**40), 2**40, "wider"), (7, 7, "one"), (9, 8, "none"), (None, 3, "null"), (3, None, "null")]


@pytest.mark.parametrize("hot", [100_000, 5])
def test_ranges_against_a_loop(spark, monkeypatch, hot):
    monkeypatch.setattr(intervals, "HOT", hot)
    rng = random.Random(2)
    points = [(rng.randint(-700, 1500), i) for i in range(400)] + [(7, 900 + i) for i in range(50)] + [(None, 1), (10**9, 2), (10**9 + 1, 3)]
    held = ranges_of(rng, 120)
    got = intervals.join_ranges(spark.createDataFrame(points, "n bigint, i bigint"), spark.createDataFrame(held, "a bigint, b bigint, name string"))
    want = sorted((n, i, name) for n, i in points for a, b, name in held if None not in (n, a, b) and a <= n <= b)
    assert sorted((r.n, r.i, r["name"]) for r in got.collect()) == want


def test_wide_ranges_cost_few_rows(spark):
    """Rows follow points, ranges and matches, not widths."""
    points = spark.range(0, 10**6, 1000).select(F.col("id").alias("n"))
    wide = spark.createDataFrame([(i * 10**6, i * 10**6 + 10**9, i) for i in range(50)], "a bigint, b bigint, r bigint")
    out = intervals.join_ranges(points, wide)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == 1000 and intervals.join_ranges(points, wide.where("false")).count() == 0


@pytest.mark.parametrize("tags", [100_000, 20])
def test_contexts_against_a_loop(spark, monkeypatch, tags):
    from quillspark.operators import evaluate

    monkeypatch.setattr(evaluate, "ASKED_TAGS", tags)
    rng = random.Random(3)
    pick = lambda n: rng.sample([f"t{i}" for i in range(12)], rng.randint(0, n))
    chunks = [(i, pick(6), f"text {i}") for i in range(300)] + [(900, None, "none"), (901, ["t1", "t1", None], "twice")]
    asked = [(i, pick(5)) for i in range(25)] + [(90, None), (91, [None, "nowhere"])]
    want = {}
    for i, req in asked:
        near = sorted((-len(set(req or ()) & set(t or ()) - {None}), place, text) for place, t, text in chunks)
        want[i] = "\n\n---\n\n".join(text for score, _, text in near[:2] if score < 0)
    got = evaluate.pick_contexts(spark.createDataFrame(asked, "request_id int, required_tags array<string>"), spark.createDataFrame(chunks, "place bigint, tags array<string>, text string").repartition(5))
    assert {r.request_id: r.context for r in got.collect()} == want
