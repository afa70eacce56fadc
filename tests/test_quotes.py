"""Quotation scorers and the quotation queries against brute force."""

import difflib
import random

import numpy as np
import pytest

from quillspark.operators import verify
from quillspark.plans import queries as Q

RNG = random.Random(3)
VOCAB = ["".join(RNG.choice("abcdefgx") for _ in range(RNG.randint(2, 8))) for _ in range(60)]


def sentence(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def altered(text):
    w = text.split()
    kind = RNG.randint(0, 4)
    if kind == 0:
        RNG.shuffle(w)
    elif kind == 1:
        w = w[: max(1, len(w) * 2 // 3)]
    elif kind == 2:
        w.insert(RNG.randint(0, len(w)), RNG.choice(VOCAB))
    elif kind == 3:
        w[0] = w[0] + "q"
    return " ".join(w)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 100.0 * (1 - row[-1] / max(len(a), len(b), 1))


def best(quote, known, score):
    if quote in known:
        return 100.0, known[quote]
    found = max(((score(quote, t), -n) for t, n in known.items()), default=(0, 0))
    return (found[0], -found[1]) if found[0] >= 88 else (0.0, None)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_common_subsequences_and_token_sets():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choices("abcde ", k=rng.randint(0, 40))) for _ in range(2))
        assert verify._common(a, b) == subsequence(a, b)
    assert verify._token_set("b a", "a b c") == 100.0 and verify._token_set("a", "b") == 0.0
    assert abs(verify._token_set("new york mets", "new york meats") - 200 * 13 / 27) < 1e-9


LINES = {sentence(RNG.randint(1, 9)): n for n in range(150)}
ASKED = [altered(RNG.choice(list(LINES))) for _ in range(150)] + ["x", "unknown words"]


@pytest.mark.parametrize("column,plain", [
    (verify.levenshtein_score, lev), (verify.sequence_score, lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() * 100), (verify.token_set_score, verify._token_set),
])
def test_scorers_find_what_brute_force_finds(spark, column, plain):
    known = verify.choices(spark.createDataFrame([(n, t) for t, n in LINES.items()], "n bigint, text string"))
    asked = spark.createDataFrame(list(enumerate(ASKED)), "i bigint, quote string")
    got = {r.i: (round(r.score, 6), r.n) for r in verify.best_matches(asked, known, column).collect()}
    want = {i: best(q, LINES, plain) for i, q in enumerate(ASKED)}
    assert got == {i: (round(s, 6), n) for i, (s, n) in want.items()}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Items of five to nine sentences, short and long ones among them, some as documents have them
    and some altered."""
    path = str(tmp_path_factory.mktemp("quotes"))
    said = [sentence(RNG.randint(1, 24)) + "." for _ in range(60)]
    said = [s for s in dict.fromkeys(said) if len(s) <= 200]
    spark.createDataFrame([(i, s) for i, s in enumerate(said)], "doc_id bigint, text string").write.parquet(path + "/documents.parquet")
    items = [[s.replace("a", "b", 1) if RNG.random() < 0.4 else s for s in RNG.choices(said, k=RNG.randint(5, 9))] for _ in range(12)]
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string").write.parquet(path + "/benchmark.parquet")
    return path, said, items


def test_coverage_counts_fuzzy_matches(spark, small):
    path, said, items = small
    known = {s[:-1]: i for i, s in enumerate(said)}
    want = {}
    for i, x in enumerate(items):
        hits = [best(s[:-1], known, lev)[0] for s in x]
        want[i] = (len(x), sum(h >= 88 for h in hits), sum(88 <= h < 100 for h in hits))
    got = {r.item_id: (r.checked, r.accepted, r.non_exact) for r in Q.queries()["quote_coverage_lev"](spark, path).collect()}
    assert got == want and sum(w[2] for w in want.values())


def test_all_quotable_sentences_are_corrected(spark, small):
    path, said, items = small
    known = {s[:-1]: i for i, s in enumerate(said)}
    want = {}
    for i, x in enumerate(items):
        out = []
        for s in x:
            q = s.replace("x", "y")
            if 4 <= len(q) <= 200:
                score, n = best(q[:-1], known, lev)
                out.append(f'"{said[n]}"' if n is not None and score < 100 else f'"{q}"')
        want[i] = " ".join(out)
    assert {r.item_id: r.text for r in Q.queries()["quote_correct"](spark, path).collect()} == want


def said_otherwise(i, place, text):
    """The alteration of the registered queries."""
    w = text.split()
    return [" ".join(reversed(w)), " ".join(w[: max(1, -(-len(w) * 6 // 10))]), text.replace("x", "y")][(i + place) % 3]


@pytest.mark.parametrize("name,plain", [("quote_verify_tokens", verify._token_set), ("quote_verify_sequence", lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() * 100)])
def test_quotations_of_documents(spark, small, name, plain):
    path, said, items = small
    known = {s[:-1]: i for i, s in enumerate(said)}
    want = {}
    for i, x in enumerate(items):
        for place, s in enumerate(x):
            score, n = best(" ".join(said_otherwise(i, place, s).replace(".", " ").split()), known, plain)
            want[i, place] = (round(score, 6), n, score == 100.0 and " ".join(said_otherwise(i, place, s).replace(".", " ").split()) in known)
    got = {(r.item_id, r.place): (r.score, r.n, r.exact) for r in Q.queries()[name](spark, path).collect()}
    assert got == want and len({w[1] for w in want.values()}) > 5


def edited(rng, text, least=0.0):
    """A text some single letters of which are left out, added or changed."""
    c = list(text)
    for _ in range(rng.randint(0, max(1, len(c) // 9))):
        at = rng.randrange(len(c) + 1)
        kind = rng.randint(0, 2)
        c[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("abcdefgx ")]
    return " ".join("".join(c).split())


@pytest.mark.parametrize("column,plain", [(verify.sequence_score, lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() * 100), (verify.token_set_score, verify._token_set)])
@pytest.mark.parametrize("letters", [1, 2, 9])
def test_candidates_lose_no_pair(spark, column, plain, letters):
    """Around the threshold, for long and very short words and texts, and for texts of one gram."""
    rng = random.Random(letters)
    vocab = ["".join(rng.choice("abcdefgx") for _ in range(rng.randint(1, letters))) for _ in range(40)]
    lines = list({" ".join(rng.choices(vocab, k=rng.randint(1, 14))) for _ in range(120)} | {"a", "ab", "abcd", "a" * 60, "a b " * 20 + "c", "aaaa aaaa"})
    forms = list({edited(rng, rng.choice(lines)) for _ in range(250)} | {"abcde", "a" * 55, "b a " * 20 + "c"} - {""})
    known = spark.createDataFrame([(x,) for x in lines], "canon string")
    got = {(r["_c"], r.canon) for r in verify.candidates(spark.createDataFrame([(x,) for x in forms], "_c string"), known, column).collect()}
    want = {(f, x) for f in forms for x in lines if f != x and plain(f, x) >= 88}
    assert want and want <= got


@pytest.mark.parametrize("column", [verify.sequence_score, verify.token_set_score])
def test_candidates_grow_with_the_lines(spark, column):
    """Twice the lines and forms, about twice the candidates: common words and grams join nobody."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    lines = list({" ".join(rng.choices(vocab, k=12) + ["the", "of", "and"]) for _ in range(1600)})
    counts = []
    for n in (400, 1600):
        forms = spark.createDataFrame([(edited(rng, x),) for x in lines[:n:2]], "_c string").distinct()
        counts.append(verify.candidates(forms, spark.createDataFrame([(x,) for x in lines[:n]], "canon string"), column).count())
    assert counts[0] >= 100 and counts[1] <= 6 * counts[0]


@pytest.mark.parametrize("kind,plain", [("levenshtein", lev), ("sequence", lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() * 100), ("token_set", verify._token_set)])
@pytest.mark.parametrize("letters", [1, 2, 9])
def test_scan_finds_the_best_lines(monkeypatch, kind, plain, letters):
    """All that tie for each form, lines in any order and in blocks of any size."""
    rng = random.Random(letters)
    vocab = ["".join(rng.choice("abcdefgx") for _ in range(rng.randint(1, letters))) for _ in range(40)]
    lines = list({" ".join(rng.choices(vocab, k=rng.randint(1, 14))) for _ in range(120)} | {"a", "ab", "abcd", "a" * 60, "a b " * 20 + "c"})
    forms = list({edited(rng, rng.choice(lines)) for _ in range(150)} | {"abcde", "a" * 55} - {""})
    n = [rng.randint(0, 40) for _ in lines]
    want = {}
    for f in forms:
        s = [(float("inf") if f == x else plain(f, x), -n[i], i) for i, x in enumerate(lines)]
        top = max(x[:2] for x in s)
        if top[0] >= 88:
            want[f] = {x[2] for x in s if x[:2] == top}
    for cells in (1000, 1 << 19):
        monkeypatch.setattr(verify, "_CELLS", cells)
        index, got = verify._Forms(forms, kind, 88.0), {}
        for f, line, _ in zip(*index.best(lines, np.array(n))):
            got.setdefault(index.texts[f], set()).add(int(line))
        assert want and got == want


@pytest.mark.parametrize("column", [verify.levenshtein_score, verify.sequence_score, verify.token_set_score])
def test_few_and_many_forms_find_the_same(spark, monkeypatch, column):
    """Broadcast forms and joins agree, and a scan keeps nothing of the lines but what it found."""
    lines = spark.createDataFrame([(n, t.upper()) for t, n in LINES.items()] + [(n + 500, t) for t, n in LINES.items()], "n bigint, text string")
    asked = spark.createDataFrame(list(enumerate(ASKED)) + [(999, None)], "i bigint, quote string")
    kept = []
    monkeypatch.setattr(verify, "stored", lambda df, name, stored=verify.stored: kept.append(name) or stored(df, name))
    few = verify.best_matches(asked, verify.canonical(lines), column).select("i", "n", "text", "score", "exact").collect()
    assert kept == ["asked", "best"]
    monkeypatch.setattr(verify, "FEW", 0)
    many = verify.best_matches(asked, verify.canonical(lines), column).select("i", "n", "text", "score", "exact").collect()
    assert sorted(few) == sorted(many) and len(few) == len(ASKED) + 1
