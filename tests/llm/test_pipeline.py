"""The pipeline against a plain version of each stage on the same input."""

import math
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import textvec as tv
from quillspark.llm import toxicity
from quillspark.llm.common import read_table, written

from .test_bagminhash import brute as components
from .test_decontam import brute as contamination
from .test_mixing import brute_targets


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = read_table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf), name)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_in_order(stages):
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "sharding")


def plain_score(classifier, text):
    """A score by loops over words, their prefixes and the lexicons' words."""
    v, counts = classifier.voters, {}
    place = {int(h): k for h, k in zip(v.hashes.sorted, v.column)}
    for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)):
        raw = word.encode()
        hashes = [tv.word_hash(word)] + [int(tv.prefixes(tv.split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), n)[1][0]) for n in toxicity.PREFIXES if len(raw) > n]
        for h in hashes:
            if place.get(h, -1) >= 0:
                counts[place[h]] = counts.get(place[h], 0) + 1
        for k, lexicon in enumerate(toxicity.LEXICONS.values()):
            counts[v.mined + k] = counts.get(v.mined + k, 0) + (word in lexicon.split())
    width = v.mined + len(toxicity.LEXICONS)
    z = classifier.bias
    for k, n in counts.items():
        z += (n >= toxicity.LOW) * classifier.weights[k] + (n >= toxicity.HIGH) * classifier.weights[width + k] + min(n, 2 * toxicity.HIGH) / (2 * toxicity.HIGH) * classifier.weights[2 * width + k]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity(stages, spark, sf):
    before, after = stages["toxicity"]
    classifier = toxicity.train(before, read_table(spark, sf, "labels"))
    scores = {r.doc_id: plain_score(classifier, r.text or "") for r in before.collect()}
    assert all(abs(x - toxicity.THRESHOLD) > 1e-5 for x in scores.values())
    assert ids(after) == {i for i, x in scores.items() if x < toxicity.THRESHOLD} and len(ids(after)) < before.count()


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    clean = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)))
    rows = [(r.doc_id, clean(r.text)) for r in before.collect()]
    assert ids(after) == set(components(rows).values())


def test_decontamination(stages, spark, sf):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in read_table(spark, sf, "benchmark").collect()]
    marked = contamination([(r.doc_id, r.text) for r in before.collect()], items)
    assert ids(after) == {i for i, m in marked.items() if not m[4]}


def test_mixing(stages):
    """Sources meet targets that plain arithmetic gives; no document stands more than twice."""
    before, after = stages["mixing"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, took, times = Counter(), Counter(), Counter()
    texts = {r.doc_id: (r.source, r.text) for r in before.collect()}
    for source, text in texts.values():
        size[source] += words(text)
    for r in after.collect():
        assert texts[r.doc_id] == (r.source, r.text)
        times[r.doc_id] += 1
        took[r.source] += words(r.text)
    want = brute_targets(size)
    largest = {s: max(words(t) for x, t in texts.values() if x == s) for s in size}
    assert max(times.values()) <= 2 and all(abs(took[s] - want[s]) <= max(0.002 * want[s], largest[s] / 2 + 1) for s in want)


def test_sharding(stages):
    before, after = stages["sharding"]
    assert sorted(map(str, after.select(*before.columns).collect())) == sorted(map(str, before.collect()))
    per = Counter()
    for r in after.collect():
        per[r["shard"]] += len((r.text or "").encode())
    assert all(r.shard_bytes == per[r["shard"]] for r in after.select("shard", "shard_bytes").distinct().collect())
