import hashlib

import numpy as np
import pytest

from quillspark.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, Q string, cluster int"


def brute(rows, k=8, rounds=10):
    """Lloyd over all rows, in Python's whole numbers"""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assign():
        return [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for c in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    d = [far(v, cents[o]) for (_, v), o in zip(kept, own)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((repr(i), o, x, sum(y for y, p in zip(d, own) if p == o), sum(d), digest[o]) for (i, _), o, x in zip(kept, own, d))


def ran(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], schema)
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df).collect())


def unit(rng, n):
    v = rng.standard_normal((n, 64))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()


def test_against_lloyd_over_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate(unit(rng, 150)))
    rows += [(1000 + i, rows[3][1]) for i in range(90)] + [(2000 + i, rows[i % 5][1]) for i in range(40)]  # a third alike
    assert ran(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    v = unit(rng, 30)
    rows = list(enumerate(v)) + [(None, v[0]), (None, v[1]), (5, v[2]), (5, v[2]), (40, None), (41, []), (42, v[0][:63]), (43, v[0] + [0.0]), (44, [None] + v[0][1:]), (45, [float("nan")] + v[0][1:]), (46, [float("inf")] + v[0][1:]), (47, [0.0] * 64), (48, [-0.0] * 64)]
    got = ran(spark, rows)
    assert got == brute(rows)
    assert len(got) == 36


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = list(enumerate(unit(np.random.default_rng(3), n)))
    assert ran(spark, rows) == brute(rows)


def test_all_equal_leaves_centroids_empty(spark):
    rows = [(i, [0.25] * 64) for i in range(20)]
    got = ran(spark, rows)
    assert got == brute(rows) and {r[1] for r in got} == {0} and {r[2] for r in got} == {0}


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (v * 1e4).tolist()) for i, v in enumerate(rng.uniform(-1, 1, (60, 64)))]
    assert ran(spark, rows, SCHEMA.replace("float", "double")) == brute(rows)
    with pytest.raises(Exception, match="is beyond"):
        ran(spark, [(1, [1e30] * 64)])
