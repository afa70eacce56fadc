import math
import random
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest

from quillspark.llm import quality, toxicity
from quillspark.llm.training import mixed_sample

from .conftest import words

BAD = ["grumpok", "grumpel", "grumpat", "vilk"]


@pytest.fixture(scope="module")
def corpus(make, spark):
    rng, docs, labels = random.Random(3), [], []
    for i in range(600):
        w = words(i, 60).split()
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            for p in rng.sample(range(60), 4):
                w[p] = rng.choice(BAD)
        text = " ".join(w) if good else " | ".join(x + "&&&" for x in w)
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return make(docs), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


def accuracy(got, labels, column):
    want = {r.doc_id: r[column] for r in labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(column).alias(column)).collect()}
    held = [r for r in got if r.held_out]
    return np.mean([r.predicted == want[r.doc_id] for r in held])


def test_quality_on_held_out(corpus):
    docs, labels = corpus
    got = quality.assess(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert accuracy(got, labels, "quality") > 0.97


def test_toxicity_on_held_out(corpus):
    docs, labels = corpus
    got = toxicity.assess(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert accuracy(got, labels, "toxic") > 0.97
    kept = toxicity.reject_toxic(docs.withColumns({"_toxicity": F.lit("x"), "toxicity": F.lit("y"), "label": F.lit("z")}), labels)
    assert 460 <= kept.count() <= 490 and kept.columns == [*docs.columns, "_toxicity", "toxicity", "label"]
    assert {(r._toxicity, r.toxicity, r.label) for r in kept.collect()} == {("x", "y", "z")}


def test_held_out_labels_change_nothing(corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.assess(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(0, 0.3, (quality.FEATURES, 4)))
    index, x = np.array([3, 50, 700, 4100]), np.array([0.2, 1.0, 0.5, 0.3])
    z = m.bias + m.linear[index] @ x + sum(m.factors[index[i]] @ m.factors[index[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert np.isclose(m.scores(np.zeros(4, int), index, x, 1)[0], 1 / (1 + np.exp(-z)))


def test_label_model_recovers_accuracies_without_labels():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    say = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < 1 - a) for a in (0.9, 0.85, 0.8, 0.6)], axis=1)
    say = np.concatenate([say, say[:, 2:3], say[:, 2:3]], axis=1).astype(float)  # one voter thrice
    gold = np.where(np.arange(4000) < 200, y, np.nan)
    assert ((toxicity.label_model(say, gold) > 0.5) == y).mean() > 0.9


def plain_posteriors(say, known, rounds, other):
    """the label model by loops over rows and voters"""
    n, v = say.shape
    share = sum(k for k in known if k == k) / sum(k == k for k in known)
    post = [share] * n
    for turn in range(rounds):
        log_odds, repeats = [math.log(share / (1 - share))] * n, [0.0] * v
        rates = []
        for c in (1, 0):
            wt = []
            for i in range(n):
                p = known[i] if known[i] == known[i] else post[i]
                p = p if c else 1 - p
                wt.append(p * (1 if known[i] == known[i] else 0 if turn == 0 else other))
            total = sum(wt)
            signed = [[0 if x != x else 2 * x - 1 for x in row] for row in say]
            mean = [sum(wt[i] * signed[i][j] for i in range(n)) / total for j in range(v)]
            cov = [[sum(wt[i] * signed[i][j] * signed[i][k] for i in range(n)) / total - mean[j] * mean[k] for k in range(v)] for j in range(v)]
            for j in range(v):
                repeats[j] += 0.5 * sum(cov[j][k] ** 2 / (cov[j][j] * cov[k][k]) for k in range(v))
            rates.append([[min(max((sum(w for w, row in zip(wt, say) if row[j] == s) + 0.5) / (total + 1), 1e-4), 1 - 1e-4) for j in range(v)] for s in (1, 0)])
        for i in range(n):
            for j in range(v):
                for s, of_toxic, of_clean in zip((1, 0), *rates):
                    if say[i][j] == s:
                        log_odds[i] += math.log(of_toxic[j] / of_clean[j]) / max(repeats[j], 1)
        post = [1 / (1 + math.exp(-z)) for z in log_odds]
    return post


def test_posteriors_against_loops():
    rng = np.random.default_rng(5)
    y = rng.random(60) < 0.4
    say = np.where(rng.random((60, 5)) < 0.3, np.nan, (rng.random((60, 5)) < np.where(y, 0.8, 0.2)[:, None]).astype(float))
    known = np.where(np.arange(60) < 25, y, np.nan)
    assert np.allclose(toxicity.label_model(say, known, rounds=4, other=0.25), plain_posteriors(say, known, 4, 0.25), atol=2e-4)


def test_votes_are_toxic_clean_or_none():
    got = toxicity.votes(np.array([[0, 0], [1, 0], [0, 5]]))
    assert np.array_equal(got, np.array([[np.nan] * 4 + [0], [1, *[np.nan] * 4], [np.nan, 1, np.nan, 1, np.nan]]), equal_nan=True)


def test_samples_take_one_text_of_an_id_and_other_documents(make, spark):
    docs = make([(i, f"text {i}") for i in range(300)] + [(7, f"again {k}") for k in range(500)] + [(None, "a null id")])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id bigint, quality int, toxic int")
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    got = mixed_sample(docs, labels, "toxic", 50, 60, 4, 2).collect()
    assert len(got) == len({r.doc_id for r in got}) and sum(r.label is not None for r in got) == 50 and 40 <= sum(r.label is None for r in got) <= 60
    assert not [r for r in got if r.label is not None and r.doc_id in held]
    assert sorted(got) == sorted(mixed_sample(docs.repartition(3), labels, "toxic", 50, 60, 4, 2).collect())


@pytest.mark.parametrize("module,column", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(odd, none, spark, module, column):
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = module.assess(odd.withColumn("score", F.lit("clash")), no_labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert module.assess(none, no_labels).collect() == []
    one_class = spark.createDataFrame([(i, 1, 1) for i in range(8)], "doc_id bigint, quality int, toxic int")
    assert module.assess(odd, one_class).count() == odd.count()


def _area(scores, y):
    order = np.argsort(np.argsort(scores))
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_few_labels_and_many_other_texts():
    """With 30 labels, and half of the voters saying nothing of use, the label model's posteriors of 3,000
    other texts find what labels alone don't."""
    gains = []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        y = (rng.random(6030) < 0.15).astype(int)
        y[:4] = 1
        telling = np.where(y[:, None] == 1, rng.uniform(0.15, 0.4, 30), rng.uniform(0.01, 0.05, 30))
        others = np.repeat(rng.uniform(0.05, 0.3, 30)[None, :], len(y), axis=0)  # as often on toxic as on clean texts
        counts = rng.poisson(np.concatenate([telling, others], axis=1)).astype(np.int32)
        known = np.full(3030, np.nan)
        known[:30] = y[:30]
        who = toxicity.voters([])
        score = lambda c: c.bias + toxicity._inputs(counts[3030:]) @ c.weights  # noqa: E731, B023
        both = _area(score(toxicity.fit(who, counts[:3030], known)), y[3030:])
        alone = _area(score(toxicity.fit(who, counts[:30], known[:30])), y[3030:])
        gains.append(both - alone)
    assert np.mean(gains) > 0.03 and min(gains) > 0


def test_a_labelled_text_without_votes_keeps_its_label():
    """Silence of all voters is no evidence against a label."""
    counts = np.zeros((200, 7), np.int32)
    y = np.zeros(200)
    y[:40] = 1
    counts[:10, 0] = 1
    loud, silent = (toxicity.fit(toxicity.voters([]), counts, k) for k in (y, np.where(np.arange(200) < 10, 1.0, 0.0)))
    at = toxicity._inputs(np.zeros((1, 7), np.int32))
    assert loud.bias + at @ loud.weights > silent.bias + at @ silent.weights + 1
