import itertools

import numpy as np
import pyspark.sql.functions as F
import pytest

from quillspark.config import top_k
from quillspark.operators import embed, evaluate, fuse, rerank, search

HITS = "query_id bigint, doc_id bigint, score double, rank int"


def ranked(spark, ids):
    return spark.createDataFrame([(1, d, 1.0 - i / 10, i + 1) for i, d in enumerate(ids)], HITS)


@pytest.mark.parametrize("a,b", [([1, 2, 3], [3, 4]), ([1, 2], [3, 4]), ([1, 2], []), ([1, 2], [2, 1])])
def test_rrf(spark, a, b):
    want = {}
    for ids in (a, b):
        for r, d in enumerate(ids, 1):
            want[d] = want.get(d, 0) + 1 / (60 + r)
    order = sorted(want, key=lambda d: -want[d])  # stable: first list first
    out = fuse.fused_order(fuse.rrf([ranked(spark, a), ranked(spark, b)])).orderBy("rank").collect()
    assert [r.doc_id for r in out] == sorted(order, key=lambda d: -round(want[d], 12)) and all(abs(r.rrf - want[r.doc_id]) < 1e-9 for r in out)


def test_hybrid_without_text_hits_keeps_vector_scores(spark):
    v = ranked(spark, [1, 2])
    none = v.where(F.lit(False))
    assert [r.score for r in fuse.hybrid(v, none, 5).orderBy("rank").collect()] == [1.0, 0.9]
    assert fuse.hybrid(v, none, 5, always=True).orderBy("rank").collect()[0].score < 0.1


def test_dedupe_keeps_the_first_and_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "a", 0, 1, 0.1), (1, "a", 0, 2, 0.9), (1, "b", 1, 1, 0.5)], "query_id int, key string, stage int, rank int, score double")
    once = fuse.dedupe(rows, "key", ["stage", "rank"])
    assert sorted((r.key, r.score) for r in once.collect()) == [("a", 0.1), ("b", 0.5)]
    assert sorted(fuse.dedupe(once, "key", ["stage", "rank"]).collect()) == sorted(once.collect())


def simulate(hits, relaxed, k):
    """the searches that a loop with early stops makes"""
    made, got = [(1, 0)], hits[0]
    if got < max(2, k):
        for v in range(1, len(hits)):
            made.append((2, v))
            got += hits[v]
            if got >= max(3 * k, 25):
                break
    if got < k:
        for v in range(len(hits)):
            made.append((3, v))
            got += relaxed[v]
            if got >= max(4 * k, 32):
                break
    return set(made)


def test_relaxation(spark):
    cases = [list(c) for c in itertools.product((0, 1, 4, 5, 30), repeat=3)]
    relaxed = [[(sum(c) + 7 * v) % 40 for v in range(3)] for c in cases]
    rows = [(q, v, h, relaxed[q][v]) for q, c in enumerate(cases) for v, h in enumerate(c)]
    got = fuse.relax(spark.createDataFrame(rows, "query_id int, variant int, hits bigint, hits_relaxed bigint"), 5).where("kept").collect()
    for q, c in enumerate(cases):
        assert {(r.stage, r.variant) for r in got if r.query_id == q} == simulate(c, relaxed[q], 5), (c, relaxed[q])


def test_variants(spark):
    got = [r.text for r in fuse.variants(spark.createDataFrame([(1, " Từ  Hải là ai ")], "query_id int, query string")).orderBy("variant").collect()]
    assert got[:5] == ["Từ Hải là ai", "Tu Hai la ai", "từ hải", "tu hai", "từ-hải"] and "vai trò của từ hải" in got and len({g.lower() for g in got}) == len(got)


def test_vector_search_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 16)).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "doc_id bigint, vector array<float>").repartition(5)
    q = docs.where("doc_id < 10").withColumnRenamed("doc_id", "query_id")
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(10) for j in np.argsort(-(u @ u[i]))[:7]}
    assert {(r.query_id, r.doc_id) for r in search.vector_topk(q, docs, 7).collect()} == want
    assert search.vector_topk(q.where(F.lit(False)), docs, 7).collect() == []


def test_embedding_and_retries(spark):
    rows = embed.with_vectors(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "i int, text string")).orderBy("i").collect()
    assert rows[0].vector == rows[1].vector and abs(sum(x * x for x in rows[0].vector) - 1) < 1e-6

    class Flaky:
        dim, calls = 2, 0

        def embed(self, texts):
            self.calls += 1
            if len(texts) > 1 or self.calls % 2:
                raise OSError
            return np.ones((1, 2))

    assert embed.embed_batch(Flaky(), ["a", "b"], sleep=lambda s: None).shape == (2, 2)


def test_rerank_modes(spark):
    hits = spark.createDataFrame([(1, 1, "cat dog", "a cat cat sat", 0.1, 1), (1, 2, "cat dog", "none", 0.2, 2), (1, 3, "cat dog", "dog", 0.0, 3)], "query_id int, doc_id int, query string, text string, score double, rank int")
    assert [r.doc_id for r in rerank.rerank(hits, 3, "no such mode").orderBy("new_rank").collect()] == [1, 3, 2]
    assert [r.doc_id for r in rerank.rerank(hits, 2, "none").orderBy("new_rank").collect()] == [2, 1]
    assert rerank.depth(50, 5) == 12 and rerank.contexts_taken(5, True) == 6 and top_k(0) == 1 and top_k("x") == 10
    rerank.register("broken", lambda: 1 / 0)
    assert "broken" not in rerank.STRATEGIES


def test_evaluation(spark):
    rows = spark.createDataFrame([("Câu trả lời A b", ["a B", "zz"]), ("chưa đủ căn cứ", [])], "answer string, expects array<string>")
    assert evaluate.golden_mean(rows).collect()[0].golden_avg == 0.25 and evaluate.refusal_rate(rows).collect()[0].refusal_rate == 0.5
    asked = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, ["q"])], "request_id int, required_tags array<string>")
    chunks = spark.createDataFrame([(1, ["x"], "one"), (2, ["x", "y"], "two"), (3, ["y"], "three")], "place int, tags array<string>, text string")
    assert {r.request_id: r.context for r in evaluate.pick_contexts(asked, chunks).collect()} == {1: "two\n\n---\n\none", 2: "", 3: ""}


def test_postings_against_counter(spark):
    import re
    from collections import Counter

    rows = [(1, "a b a C c, a"), (2, ""), (3, None), (4, "đ'x É é"), (1, "b")]
    got = Counter((r.doc_id, r.term, r.tf, r.length) for r in search.postings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    want = Counter()
    for i, t in rows:
        words = re.findall(r"[\w']+", (t or "").lower())
        want.update((i, w, n, len(words)) for w, n in Counter(words).items())
    assert got == want


@pytest.mark.parametrize("block", [search.QUERY_BLOCK, 3])
def test_text_search_against_loops(spark, monkeypatch, block):
    import math
    import random

    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(search, "SCORES", 40)
    monkeypatch.setattr(search, "ADDITIONS", 16)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(100, None)]
    asked = [(q, " ".join(rng.choice("abcdefghz") for _ in range(q % 5))) for q in range(9)]
    held = [(i, t.split()) for i, t in docs if t is not None]
    mean, want = sum(len(w) for _, w in held) / len(held), set()
    for q, text in asked:
        scores = {}
        for t in set(text.split()):
            df = sum(t in w for _, w in held)
            for i, w in held:
                if t in w:
                    tf = w.count(t)
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:4]
        want |= {(q, i, k, round(scores[i], 6)) for k, i in enumerate(best, 1)}
    d, a = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(asked, "query_id bigint, query string")
    assert {(r.query_id, r.doc_id, r["rank"], round(r.score, 6)) for r in search.text_topk(a, d, 4).collect()} == want
    v = spark.createDataFrame([(i, [float(rng.randint(-2, 2)) for _ in range(3)] + [1.0]) for i in range(40)], "doc_id bigint, vector array<double>")
    m = {r.doc_id: np.array(r.vector) / np.linalg.norm(r.vector) for r in v.collect()}
    near = {(q, i) for q in m for i in sorted(m, key=lambda i: (-round(float(m[q] @ m[i]), 9), i))[:5]}
    assert {(r.query_id, r.doc_id) for r in search.vector_topk(v.withColumnRenamed("doc_id", "query_id"), v, 5).collect()} == near


def test_variants_are_searched_as_themselves(spark, monkeypatch):
    from quillspark.plans import retrieval

    probes = []
    search_both = retrieval.hybrid_search
    monkeypatch.setattr(retrieval, "hybrid_search", lambda asked, *a, **o: probes.extend(asked.collect()) or search_both(asked, *a, **o))

    texts = ["tu hai hero", "từ hải hero", "the river runs", "another text here", "kim trọng", "a hero of none"]
    docs = embed.with_vectors(spark.createDataFrame([(i, t, "poem" if i % 2 else "bio") for i, t in enumerate(texts)], "doc_id bigint, text string, type string"))
    big = 2**60 + 1
    q = spark.createDataFrame([(big, "Từ Hải"), (big + 1, "river"), (5, "")], "query_id bigint, query string")
    got = retrieval.retrieve(q, docs, 4, embedder=embed.Hashing, where=F.col("type") == "poem")
    hits = got.hits.collect()
    assert {r.query_id for r in hits} == {big, big + 1}
    assert len({(r.query_id, r.doc_id) for r in hits}) == len(hits) and any(r.relaxed for r in hits)
    assert len(probes) > len({r.query_id for r in probes}) > 8  # one query is searched again without the filter
    for r in probes:
        assert np.allclose(r.vector, embed.Hashing().embed([embed.QUERY + r.query])[0], atol=1e-6)
    assert {r.query_id for r in got.prompts.collect()} == {big, big + 1, 5}


def test_hosted_embeddings_are_read_in_any_shape():
    shapes = [lambda v: {"embeddings": [{"values": x} for x in v]}, lambda v: {"data": [{"embedding": x} for x in v]}, lambda v: {"embedding": {"values": v[0]}}, lambda v: [*v], lambda v: v[0]]
    for shape in shapes:
        sent = []
        model = embed.Hosted(lambda p: sent.append(p) or shape([[1.0, 2.0]]), "m", dim=2)  # noqa: B023
        assert model.embed(["x"]).tolist() == [[1.0, 2.0]] and sent[0]["input"] == ["x"]
    with pytest.raises(ValueError):
        embed.Hosted(lambda p: {"data": []}, "m", dim=2).embed(["x"])


def test_hosted_rerankers(spark, monkeypatch):
    monkeypatch.setattr(rerank, "STRATEGIES", dict(rerank.STRATEGIES))
    hits = spark.createDataFrame([(1, d, 0.5, d, "why", t) for d, t in enumerate(["aa", "a", "aaa"], 1)] + [(2, 9, 0.1, 1, "who", "aaaa")], "query_id bigint, doc_id bigint, score double, rank int, query string, text string")

    def send(payload):
        return {"results": [{"index": i, "relevance_score": len(t)} for i, t in enumerate(payload["documents"])]}

    rerank.register("cohere", lambda: rerank.Hosted(send, "m"))
    got = [(r.query_id, r.doc_id, r.re_score) for r in rerank.rerank(hits, 2, "cohere").orderBy("query_id", "new_rank").collect()]
    assert got == [(1, 3, 3.0), (1, 1, 2.0), (2, 9, 4.0)]
    rerank.register("jina", lambda: 1 / 0)
    assert "jina" not in rerank.STRATEGIES


def test_generation_in_batches(spark):
    from quillspark.operators import prompt

    def call(texts):
        if len(texts) > 1 and any(t == "bad" for t in texts) or texts == ["bad"]:
            raise ValueError("no")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "", "b"])], "i int, prompt string").coalesce(1)
    got = {r.i: (r.answer, r.error) for r in prompt.generate(rows, lambda: call, batch=3).collect()}
    assert got == {0: ("A", None), 1: ("", "ValueError: no"), 2: ("", "empty answer"), 3: ("B", None)}
