from collections import Counter, defaultdict

import pyspark.sql.functions as F
import pytest

from quillspark.llm import mixing

from .conftest import words


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, left = 1.5 * sum(sizes.values()), {}, set(order)
    while left:
        rest = total - sum(out.values())
        w = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / w > 2 * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / w for s in left}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return out


@pytest.fixture(scope="module")
def docs(make):
    rows = [(i, words(i, 1 + (i * 37) % 300), "abcde"[min(i % 9, 4)]) for i in range(700)]
    return make(rows + [(1000 + i, words(i, 20), None) for i in range(30)] + [(2000, None, "a"), (2001, " \t\n", "b"), (3000, "one two", "tiny")])


def test_targets_and_taken_words(docs):
    got = mixing.account(docs).collect()
    assert len(got) == docs.count()
    size, took, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r["size"]
        took[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.source_size >= r["size"]
    want = brute_targets(size)
    assert all(abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert all(abs(took[s] - want[s]) <= max(4, 0.002 * want[s]) for s in want)
    again = {r.doc_id: r.copies for r in mixing.account(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_rates_meet_targets_before_rounding(docs):
    plan = mixing.decide(docs).where("size > 0").groupBy("source").agg(F.sum(F.col("rate") * F.col("size") * F.col("m")).alias("r"), F.first("target").alias("t")).collect()
    assert all(abs(x.r - x.t) < 1e-6 * x.t for x in plan)


@pytest.mark.parametrize("bound", [mixing.BROADCAST_CELLS, 0])
def test_mix_repeats_rows_with_and_without_broadcasts(docs, make, monkeypatch, bound):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", bound)
    monkeypatch.setattr(mixing, "CELL", 16)
    more = docs.unionByName(make([(i, words(i, 9), "a") for i in range(5000, 5200)])).unionByName(make([(77, "twice the same", "b")] * 3 + [(None, "no id", "c")] * 2))
    copies = {(r.doc_id, r.source, r["size"]): r.copies * r.m for r in mixing.decide(more).collect()}
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixing.mix(more).collect())
    assert got == {k: n for k, n in copies.items() if n}


def test_mix_repeats_rows(docs):
    copies = {r.doc_id: r.copies for r in mixing.account(docs).collect()}
    mixed = mixing.mix(docs.withColumns({"size": F.lit("s"), "copies": F.lit("c"), "target": F.lit("t")}))
    assert mixed.columns[-3:] == ["size", "copies", "target"]
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in copies.items() if n}


def test_clashing_columns_keep_their_values(docs):
    names = ["_size", "_d", "_s", "_z", "_copies", "_copy", "d", "s", "z", "copy", "copies", "m", "rate"]
    mixed = mixing.mix(docs.withColumns({c: F.concat(F.lit(c), "doc_id") for c in names}))
    assert mixed.columns == [*docs.columns, *names]
    assert all(r[c] == f"{c}{r.doc_id}" for r in mixed.where("doc_id is not null").collect() for c in names)


def test_rates_that_do_not_converge_raise(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ITERATIONS", 1)
    with pytest.raises(ArithmeticError):
        mixing.account(docs)


def test_odd_rows(odd, none):
    got = mixing.account(odd).collect()
    assert len(got) == odd.count()
    assert mixing.account(none).collect() == [] and mixing.mix(none).collect() == []
    assert mixing.mix(odd).columns == odd.columns


def test_words_are_runs_without_ascii_space(make):
    got = mixing.account(make([(1, "a b  c\x1cd\te\x0bf\x85g")])).collect()[0]
    assert got["size"] == 4


def test_many_small_documents_close_a_large_gap(make, monkeypatch):
    """One document of most words leaves a gap that only hundreds of small ones close; corrections go
    on until none helps, whatever a round may change at most."""
    rows = [(i, "w", "a") for i in range(900)] + [(1000 + i, words(i, 7), "a") for i in range(90)] + [(5000, words(1, 4000), "a"), (5001, words(2, 900), "a")]
    rows += [(6000 + i, words(i, 40), "b") for i in range(60)]
    taken = []
    for at_once in (1000, 50):
        monkeypatch.setattr(mixing, "AT_ONCE", at_once)
        got = mixing.account(make(rows)).collect()
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
        for s in "ab":
            mine = [r for r in got if r.source == s]
            gap = mine[0].target - sum(r.taken for r in mine)
            helps = [r for r in mine if r["size"] and (r.taken < 2 * r["size"] if gap > 0 else r.taken > 0) and abs(abs(gap) - r["size"]) < abs(gap)]
            assert abs(gap) <= mixing.NEAR * mine[0].target or not helps
        taken.append(sum(r.taken for r in got if r.source == "a"))
    assert abs(taken[0] - taken[1]) <= 1
