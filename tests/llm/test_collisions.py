import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import collisions

SCHEMA = "vec_id bigint, embedding array<double>, rank int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows], SCHEMA)


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i in sorted({i for i, _ in ok if i % every == 0}):
        q = min(tuple(v) for j, v in ok if j == i)
        like = [(j, v) for j, v in ok if j != i and len(v) == len(q)]
        scores = (np.array([v for _, v in like]).reshape(-1, len(q)) * np.array(q)).sum(1).tolist()
        out[i] = [(j, -s) for s, j in sorted(zip([-s for s in scores], [j for j, _ in like]))[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(have, want):
    hits = sum(len({j for j, _ in have.get(q, [])} & {j for j, _ in w}) for q, w in want.items())
    return hits / sum(len(w) for w in want.values())


def shapes(kind, rng):
    x = rng.standard_normal((5000, 64))
    if kind == "clusters":
        x = 0.2 * x + 3 * rng.standard_normal((25, 64))[rng.integers(0, 25, len(x))]
    if kind == "norms":
        x *= np.exp(rng.normal(0, 1, (len(x), 1)))
    if kind == "flat":  # few dimensions carry all
        x[:, 5:] *= 0.01
    if kind == "copies":
        x[: len(x) // 3] = x[0]
    if kind == "outlier":
        x[7] *= 1000
    return x


@pytest.mark.parametrize("kind", ["plain", "clusters", "norms", "flat", "copies", "outlier"])
def test_recall_against_brute_force(spark, kind):
    rows = list(enumerate(shapes(kind, np.random.default_rng(5))))
    have, want = got(collisions.search(table(spark, rows))), brute(rows)
    assert have.keys() == want.keys() and all(len(have[q]) == 20 for q in want)
    scores = {q: np.array([s for _, s in x]) for q, x in want.items()}
    if kind == "copies":  # of equal rows any twenty with the smallest ids are right; scores tell
        assert np.mean([np.isclose([s for _, s in have[q]], scores[q]) for q in want]) >= 0.95
    else:
        assert recall(have, want) >= 0.95
    by = dict(rows)
    for q, x in list(have.items())[:20]:
        assert np.allclose([s for _, s in x], [by[q] @ by[j] for j, _ in x], rtol=1e-12)
        assert [(-s, j) for j, s in x] == sorted((-s, j) for j, s in x)


def test_few_rows_are_verified(spark, monkeypatch):
    """Of clustered rows most are left out without their product being made."""
    rng, seen = np.random.default_rng(6), []
    rows = list(enumerate(shapes("clusters", rng)))
    index = collisions.index(table(spark, rows))
    asked = collisions._groups([{"q": i, "v": v.tolist()} for i, v in rows if i % 20 == 0], index.sample, 20, collisions.LINES)
    real = collisions._verified
    monkeypatch.setattr(collisions, "_verified", lambda v, q: seen.append(len(v)) or real(v, q))
    best = collisions._Best(asked[1], 20, asked[0][64].floor)
    for cell in index.cells.collect():
        collisions._visit(cell.asDict(), asked[0][64], best, 20, collisions.LINES, collisions.REACH, collisions.SLACK)
    assert sum(seen) <= 0.1 * len(rows) * asked[1]


def test_blocks_and_short_results(spark, monkeypatch):
    rows = list(enumerate(np.random.default_rng(7).standard_normal((300, 16))))
    whole = got(collisions.search(table(spark, rows), every=5))
    monkeypatch.setattr(collisions, "BLOCK", 20)
    assert got(collisions.search(table(spark, rows), every=5)) == whole
    # A threshold that nothing reaches leaves all to the exact way.
    index = collisions.index(table(spark, rows))
    have = got(collisions.nearest(table(spark, rows).where(F.col("vec_id") % 20 == 0), index, slack=-50.0))
    want = brute(rows)
    assert {q: [j for j, _ in x] for q, x in have.items()} == {q: [j for j, _ in x] for q, x in want.items()}


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((30, 8)))] + [(40, None), (60, []), (80, [0.0] * 8), (100, [float("nan")] * 8), (120, [None] * 8), (140, [float("inf")] * 8), (None, [1.0] * 8), (160, [1.0, 2.0, 3.0]), (161, [2.0, 2.0, 2.0]), (180, [5.0] * 5), (20, [1.0] * 8), (21, [9.0] * 8), (21, [9.0] * 8)]
    have, want = got(collisions.search(table(spark, rows))), brute(rows)
    assert {q: [j for j, _ in x] for q, x in have.items()} == {q: [j for j, _ in x] for q, x in want.items() if x}
    assert set(have) == {0, 20, 160}


def test_empty(spark):
    assert got(collisions.search(table(spark, []))) == {}
    assert got(collisions.search(table(spark, [(0, [1.0, 2.0])]))) == {}
