from collections import Counter

import pyspark.sql.functions as F
import pytest

from quillspark.llm import sharding

from .conftest import words


def brute(sizes, limit):
    """shard of each 60-bit hash by splitting oversized buckets one bit at a time"""
    out, work = {}, [(0, 0, dict(sizes))]
    while work:
        depth, prefix, rows = work.pop()
        if sum(rows.values()) <= limit or depth == sharding.BITS:
            for h in rows:
                out[h] = (depth, prefix)
            continue
        for bit in (0, 1):
            part = {h: n for h, n in rows.items() if (h >> (sharding.BITS - 1 - depth)) & 1 == bit}
            if part:
                work.append((depth + 1, prefix * 2 + bit, part))
    return out


def test_buckets_split_only_where_too_large(make):
    docs = make([(i, words(i, 5 + i % 40)) for i in range(400)])
    got = sharding.shard(docs, limit=3000).withColumn("bits", sharding.key_bits(F.col("doc_id"))).collect()
    sizes = Counter()
    for r in got:
        sizes[r.bits] += r.n_bytes
    want = brute(sizes, 3000)
    for r in got:
        depth, prefix = want[r.bits]
        assert (r.depth, r["shard"]) == (depth, format(prefix, f"0{depth}b") if depth else "*")
    per = Counter()
    for r in got:
        per[r["shard"]] += r.n_bytes
    assert max(per.values()) <= 3000 and all(per[r["shard"]] == r.shard_bytes for r in got)


@pytest.mark.parametrize("limit", [200, 900, 20_000, 10**6])
def test_any_limit_against_brute_force(make, limit, monkeypatch):
    """Buckets far deeper and far shallower than expected, looked up with and without broadcasts."""
    monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", 5 if limit < 1000 else 10**6)
    docs = make([(i, words(i, 3)) for i in range(150)] + [(1000 + i, words(i, 400)) for i in range(3)])
    got = sharding.shard(docs, limit=limit).withColumn("bits", sharding.key_bits(F.col("doc_id"))).collect()
    sizes = Counter()
    for r in got:
        sizes[r.bits] += r.n_bytes
    want = brute(sizes, limit)
    for r in got:
        depth, prefix = want[r.bits]
        assert r.depth == depth and r["shard"].startswith(format(prefix, f"0{depth}b") if depth else "*")


def test_one_key_over_the_limit_is_divided(make):
    docs = make([(7, "x" * 100) for _ in range(300)] + [(i, "y" * 50) for i in range(20)] + [(8, "z" * 5000)])
    got = sharding.shard(docs, limit=1000).collect()
    per = Counter()
    for r in got:
        per[r["shard"]] += r.n_bytes
    assert len(got) == 321 and sum(per.values()) == 300 * 100 + 20 * 50 + 5000
    assert sorted(per.values())[-1] == 5000 and sorted(per.values())[-2] <= 1000


def test_odd_rows_and_clashing_columns(odd, none):
    docs = odd.withColumns({"shard": F.lit("old"), "bits": F.lit(1), "cell": F.lit(2), "prefix": F.lit("p")})
    got = sharding.shard(docs, limit=100000)
    assert got.count() == odd.count() and {r["shard"] for r in got.collect()} != {"old"}
    assert sharding.shard(none).collect() == []


def test_clashing_columns_keep_their_values(make):
    names = ["prefix", "bits", "_bits", "_cell", "row", "n", "run", "single", "sum", "bytes"]
    docs = make([(i, words(i, 20)) for i in range(50)] + [(7, "x" * 90)] * 30).withColumns({c: F.concat(F.lit(c + " "), "doc_id") for c in names})
    for limit in (sharding.SHARD_BYTES, 600):
        got = sharding.shard(docs, limit=limit)
        assert got.columns == [*docs.columns, "n_bytes", "depth", "shard", "shard_bytes"] and got.count() == 80
        assert all(r[c] == f"{c} {r.doc_id}" for r in got.collect() for c in names)
