import random
import re
from collections import Counter

import pytest

from quillspark.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int"


def brute(rows, least=30, top=2000):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", small):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = {(lang, p[i : i + k]) for (lang, p), a in cands.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[lang, p[i : i + k]]}
    by = {}
    for (lang, p), a in cands.items():
        if (lang, p) in gone:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in by.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def ran(spark, rows, **options):
    df = spark.createDataFrame([(1, t, lang, "x", 2) for lang, t in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, docs, vocabulary, lang="en"):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    out = []
    for _ in range(docs):
        w = rng.choices(vocab, weights, k=rng.randint(1, 60))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w)) : 0] = ["New", "York", "City", "hall"][: rng.randint(2, 4)]
        out.append((lang, "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " - "]) for x in w)))
    return out


ROWS = corpus(1, 250, 40) + corpus(2, 150, 15, "fr") + corpus(3, 60, 8, None)


def test_against_brute_force(spark):
    got = ran(spark, ROWS)
    assert got == brute(ROWS) and {r[0] for r in got} == {"en", "fr", "und"}


def test_top_and_least(spark):
    assert ran(spark, ROWS, least=8, top=5) == brute(ROWS, least=8, top=5)


def test_divided_pivots(spark):
    assert ran(spark, ROWS, bounds=phrases.Bounds(split=50)) == brute(ROWS)


def test_counts_pass_only_where_a_pivot_is_too_large(spark):
    """Divided or not, a partition passes on frequent phrases alone."""
    texts = spark.createDataFrame(ROWS, "lang string, text string").selectExpr("coalesce(lang, 'und') lang", "text")
    for split in (1 << 18, 50):
        bounds = phrases.Bounds(split=split, cut=50)
        spread = spark.sparkContext.broadcast(phrases.ranks(phrases.word_counts(texts)))
        kinds = "lang string, home bigint, at int, fragment string, n bigint"
        dealt = texts.mapInArrow(phrases._fragmenter(spread, 4, bounds), kinds).repartition("home").sortWithinPartitions("home")
        assert (dealt.where("home < 0").count() > 0) == (split == 50)
        out = dealt.mapInArrow(phrases._miner(30, 4, bounds), "lang string, phrase string, n bigint").collect()
        assert out and all(r.n >= 30 for r in out) and len({(r.lang, r.phrase) for r in out}) == len(out)


@pytest.mark.parametrize("size", [0, 1, 12])
def test_table_that_holds_some_words(spark, monkeypatch, size):
    monkeypatch.setattr(phrases, "TABLE_WORDS", size)
    assert ran(spark, ROWS) == brute(ROWS)


def test_small_holds_and_heavy_parts(spark, monkeypatch):
    monkeypatch.setattr("quillspark.llm.common.HEAVY", 3)
    assert ran(spark, ROWS, bounds=phrases.Bounds(held=10, cut=7, counted=40, text=500)) == brute(ROWS)
    assert ran(spark, ROWS, bounds=phrases.Bounds(split=60, cut=20, counted=10)) == brute(ROWS)


def test_repetitions_overlap(spark):
    rows = [("en", "a a a a a a"), ("en", "a b a b a b a")] * 10 + [("en", "b " * 5)] * 4
    assert ran(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = "the very long text goes on and " * 20_000
    rows = [(None, None), ("en", None), ("en", ""), ("en", " \t\n"), ("en", "..."), ("de", "ünï Côdé É " * 40), ("de", "nul\x00byte x " * 40), ("en", long), ("und", "the very long, text " * 31), (None, "the very " * 31), ("e\tn", "a b " * 40), ("", "a b " * 40), ("en", "solo")]
    assert ran(spark, rows) == brute(rows)


def test_nothing_frequent(spark):
    assert ran(spark, []) == [] and ran(spark, [("en", "a b c")]) == []


def test_each_phrase_is_counted_in_one_partition(spark):
    """Only the pivot's partition sees a phrase, and its fragments hold no rarer word."""
    texts = spark.createDataFrame(ROWS, "lang string, text string").selectExpr("coalesce(lang, 'und') lang", "text")
    table = phrases.ranks(phrases.word_counts(texts))
    spread = spark.sparkContext.broadcast(table)
    kinds = "lang string, home bigint, at int, fragment string, n bigint"
    owners = {}
    place = {(lang, w): int(p) for lang, known in table.words.items() for w, p in zip(known.to_pylist(), table.places[lang])}
    for r in texts.mapInArrow(phrases._fragmenter(spread, 4, phrases.Bounds()), kinds).collect():
        w = r.fragment.split(" ")
        assert place[r.lang, w[r["at"]]] == r.home == max(place[r.lang, x] for x in w) and len(w) <= 7
        for k in range(2, 5):
            for i in range(max(0, r["at"] - k + 1), min(r["at"], len(w) - k) + 1):
                owners.setdefault((r.lang, *w[i : i + k]), set()).add(r.home)
    assert owners and all(len(x) == 1 for x in owners.values())
