import hashlib
import re

import pyspark.sql.functions as F
import pytest

from quillspark.llm import decontam

from .conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            iw = split(t)
            k = min(13, len(iw))
            for a in range(len(iw) - k + 1 if k else 0):
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == iw[a : a + k]:
                        hit |= set(range(b, b + k))
                        found.add(str(item))
        n = len(hit)
        out[i] = (len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w))
    return out


@pytest.fixture(scope="module")
def cases(spark):
    items = [(i, words(1000 + i, 6 + 3 * i)) for i in range(12)] + [(12, "Été Über ÑANDÚ"), (13, ""), (14, None), (15, "..."), (2, words(1002, 12))]
    docs = [(i, words(i, 40) + " " + " ".join((items[i % 12][1]).split()[: 5 + i]) + "; " + words(i + 50, 30)) for i in range(40)]
    docs += [(100, "über été ÜBER ñandú Été über Ñandú"), (101, "ÉTÉ über ñandú x"), (102, None), (103, ""), (104, "Été Über ñandÚ"), (105, items[11][1].upper() * 2), (106, "Été-Über, ÑANDÚ. " * 3)]
    return docs, items, spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 700])
def test_marks_against_brute_force(make, cases, block):
    docs, items, bench = cases
    m = decontam.mark(make(docs), bench, block_bytes=block).select("doc_id", "contamination", decontam.contaminated().alias("c")).collect()
    want = brute(docs, [x for x in items if x[1] is not None])
    got = {r.doc_id: (r.contamination.n_words, r.contamination.n_hit, len(r.contamination["items"]), hashlib.sha256(",".join(r.contamination["items"]).encode()).hexdigest(), r.c) for r in m}
    assert got == want


def test_sets_are_packed():
    """Bytes held are within ten times the text, pickled too; equal windows of an item stand once."""
    import pickle

    items = [(str(i), words(i, 400)) for i in range(200)]
    size = sum(len(t) for _, t in items)
    held = decontam.WindowSet(items)
    assert held.nbytes() < 10 * size and len(pickle.dumps(held)) < 10 * size
    again = decontam.WindowSet([("a", "one two three " * 200), ("b", "one two three " * 9)])
    (hashes, places), = again.tables.values()
    assert len(hashes) == 6 and sorted(again._items(places).tolist()) == [0, 0, 0, 1, 1, 1]


def test_spans_are_removed(make, cases):
    _, _, bench = cases
    docs = make([(1, "før Été, Über ÑANDÚ. efter"), (2, None), (3, "rene ord")])
    got = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, remove="spans").collect()}
    assert got == {1: "før . efter", 2: None, 3: "rene ord"}
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_odd_rows_and_clashing_columns(odd, none, cases, spark):
    bench = cases[2]
    docs = odd.withColumns({"contamination": F.lit("old"), "items": F.lit(1), "item_id": F.lit(2)})
    assert decontam.decontaminate(docs, bench).columns == docs.columns and decontam.decontaminate(docs, bench).count() == odd.count()
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.decontaminate(odd, empty).count() == odd.count()
    assert decontam.digest(none, bench).collect() == []
