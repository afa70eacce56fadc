import datetime as dt

import pytest

from quillspark.operators import lines, prompt, route, verify
from quillspark.plans import retrieval
from quillspark.sources import keyed, readers, sinks
from quillspark.streaming.cache import TtlCache, stream_hits


@pytest.mark.parametrize("q,want", [
    ("trích 10 câu đầu", ("opening", 10, None)), ("So sánh câu 12 với câu 34", ("compare", 12, 34)), ("câu 241–260", ("range", 241, 260)), ("từ câu 1 đến câu 10", ("range", 1, 10)), ("câu số 25 là gì", ("single", 25, None)), ("mười câu", None), (None, None),
])
def test_verse_grammar(spark, q, want):
    got = spark.createDataFrame([(q,)], "q string").select(route.verse_request("q").alias("r")).collect()[0].r
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("q,want", [("", "chitchat"), ("câu 5", "poem"), ("liệt kê: 7 ý", "facts"), ("Xin chào", "chitchat"), ("đẹp không?", "chitchat"), ("2 + 3 = ?", "generic"), ("Kiều là ai", "domain"), (None, "chitchat")])
def test_intent(spark, q, want):
    assert spark.createDataFrame([(q,)], "q string").select(route.intent("q")).collect()[0][0] == want


@pytest.mark.parametrize("q,want", [("liệt kê: 99 điều", 12), ("tóm tắt", 5), ("danh sách 1", 3), ("kể chuyện", None)])
def test_list_request(spark, q, want):
    assert spark.createDataFrame([(q,)], "q string").select(route.list_request("q")).collect()[0][0] == want


def test_names_and_faq(spark):
    said = spark.createDataFrame([("Tên mình là lan anh",), ("mình là nguyễn thị thu hà",), ("xin chào",)], "t string")
    assert [r[0] for r in said.select(route.introduced_name("t")).collect()] == ["Lan Anh", "Thu Hà", None]
    facts = spark.createDataFrame([(2, ["nguyễn du"], "b", None), (1, ["Tác  giả", "ai viết"], "a", ["s"])], "place int, patterns array<string>, answer string, sources array<string>")
    q = spark.createDataFrame([(1, "TÁC giả là Nguyễn Du?"), (2, "nguyễn du"), (3, "khác")], "query_id int, question string")
    assert {r.query_id: r.answer for r in route.faq_match(q, facts).collect()} == {1: "a", 2: "b"}


def test_verse_answers(spark):
    table = spark.createDataFrame([(i, f"l{i}") for i in range(1, 21)], "n int, text string")
    asked = [(1, "opening", 3, None), (2, "range", 6, 4), (3, "single", 99, None), (4, "compare", 2, 9), (5, "opening", 500, None), (6, "range", 18, 40)]
    got = {}
    for r in lines.answers(spark.createDataFrame(asked, "query_id int, kind string, a bigint, b bigint"), table).orderBy("n").collect():
        got.setdefault(r.query_id, []).append(r.n)
    assert got == {1: [1, 2, 3], 2: [4, 5, 6], 4: [2, 9], 5: list(range(1, 21)), 6: [18, 19, 20]}
    assert not lines.ready(table) and lines.single(table, 3).collect()[0].text == "l3"


def test_quotes_and_spans(spark):
    text = 'a “bốn chữ” "four" “abc” "' + "x" * 200 + '" “' + "y" * 201 + '” "no\nline" "abc"'
    got = verify.quotes(spark.createDataFrame([(1, text)], "k int, text string"), "k").orderBy("place").collect()
    assert [r.quote for r in got][:2] == ["bốn chữ", "four"] and len(got) == 3
    assert all(text[r.start + 1 : r.end - 1] == r.quote for r in got)


def test_fuzzy_matches_against_brute_force(spark):
    import random

    rng = random.Random(0)
    known = ["".join(rng.choice("abcd ") for _ in range(rng.randint(4, 60))).strip() or "a" for _ in range(80)]
    asked = []
    for k in known[:40]:
        s = list(k)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], ["z"], [s[i], "z"]])
            s = s or ["z"]
        asked.append("".join(s))
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, quote string")
    choices = verify.choices(spark.createDataFrame(list(enumerate(known)), "n int, text string"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    canon = lambda t: " ".join(t.split())
    for r in verify.best_matches(rows, choices).collect():
        a = canon(r.quote)
        best = max((100 * (1 - distance(a, canon(k)) / max(len(a), len(canon(k)), 1)) for k in known if canon(k)), default=0) if a else 0
        assert abs(r.score - (best if best >= 88 else 0)) < 1e-6, (a, r.score, best)


def test_corrections(spark):
    fixes = [("trăm năm trong cõi người", "Trăm năm trong cõi người ta"), ("second one", "Second")]
    text = "“Trăm năm trong cõi người” then \"other\" then 'x' \"second one\""
    assert verify.corrected(text, fixes) == '"Trăm năm trong cõi người ta" then "other" then \'x\' "Second"'
    assert verify.corrected('"second one" "trăm năm trong cõi người"', fixes).startswith('"second one"') and verify.corrected(None, fixes) == ""
    known = verify.choices(spark.createDataFrame([(1, "Trăm năm trong cõi người ta"), (2, "Chữ tài chữ mệnh khéo là ghét nhau")], "n int, text string"))
    answers = spark.createDataFrame([(1, "He says “Trăm năm trong cõi ngườu ta”."), (2, "none")], "k int, text string")
    fixed, report = verify.verify_and_correct(answers, known, "k")
    assert fixed.where("k = 1").collect()[0].text == 'He says "Trăm năm trong cõi người ta".'
    assert report.collect()[0].coverage == 1.0


def test_prompts(spark):
    q = spark.createDataFrame([(1, "why?"), (2, "none")], "query_id int, query string")
    c = spark.createDataFrame([(1, 2, "two", "b"), (1, 1, "one", "a"), (1, 3, " ", "c")], "query_id int, rank int, text string, label string")
    got = {r.query_id: r.prompt for r in prompt.rag_prompts(q, c).collect()}
    assert got[1].endswith("## Excerpts\n(1) [a]\none\n\n(2) [b]\ntwo") and "Excerpts" not in got[2].partition("##")[2]
    made = {r.query_id: (r.answer, r.error) for r in prompt.generate(prompt.rag_prompts(q, c)).collect()}
    assert made[1] == ("one", None) and made[2][1] == "empty answer"


def test_dispatch(spark):
    q = spark.createDataFrame([(1, "ai viết", False), (2, " Câu 5", False), (3, "Kiều là ai", True), (4, "Kiều là ai", False)], "query_id int, question string, long_answer boolean")
    facts = spark.createDataFrame([(1, ["ai viết"], "Nguyễn Du", ["s"])], "place int, patterns array<string>, answer string, sources array<string>")
    cache = spark.createDataFrame([("kiều là ai|la=1|intent=domain", "cached")], "key string, answer string")
    got = {r.query_id: (r.path, r.answer) for r in retrieval.dispatch(q, facts, cache).collect()}
    assert got == {1: ("faq", "Nguyễn Du"), 2: ("poem", None), 3: ("cache", "cached"), 4: ("domain", None)}


def test_cache_rules():
    c = TtlCache(capacity=2, ttl=10)
    c.put("a", 1, 0), c.put("b", 2, 0)
    assert c.get("a", 5) == 1
    c.put("c", 3, 5)
    assert c.get("b", 5) is None and c.get("a", 9) == 1 and c.get("a", 10) is None


def test_streamed_cache(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + dt.timedelta(seconds=5)), ("a", t + dt.timedelta(seconds=11)), ("b", t)]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    run = stream_hits(log, ttl=10).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.key, r.hit) for r in spark.table("hits").collect()) == [("a", False), ("a", False), ("a", True), ("b", False)]


def test_files(spark, tmp_path):
    (tmp_path / "poem").mkdir()
    (tmp_path / "other").mkdir()
    (tmp_path / "poem" / "x.txt").write_text('###META### {"id": "i1", "type": "poem", "tags": ["a", "a"]}\none two three four five\n')
    (tmp_path / "other" / "y.txt").write_text("###META### not json\nsix words are in this body\n")
    (tmp_path / "other" / "z.txt").write_text('###META### {"id": "i3"}\ntoo short\n')
    files = readers.text_files(spark, str(tmp_path))
    assert sorted((r.stem, r.type) for r in files.collect()) == [("x", "poem"), ("y", "analysis"), ("z", "analysis")]
    got = {r.id: (r.parsed, r.meta.tags if r.meta else None) for r in readers.parse_chunks(files).collect()}
    assert got["i1"] == (True, ["a"]) and got["y"][0] is False and len(got) == 2
    assert len(readers.parse_chunks(files, min_words=0).collect()) == 3
    sections = readers.sections(spark.createDataFrame([("# top\n## One\nbody\n## Two",)], "text string")).collect()
    assert [(r.title, r.body) for r in sections] == [("One", "body"), ("Two", "")]
    urls = tmp_path / "urls.txt"
    urls.write_text("# c\n\n http://a \n")
    assert [r.url for r in readers.url_list(spark, str(urls)).collect()] == ["http://a"]
    page = readers.fetched(readers.url_list(spark, str(urls)), get=lambda u: "<p>x").collect()[0]
    assert page.html == "<p>x" and page.error is None
    pdf = spark.createDataFrame([("p", bytearray(b"x"))], "path string, content binary")
    tiers = [("bad", lambda b: "short"), ("broken", lambda b: 1 / 0), ("good", lambda b: "long enough " * 9)]
    assert readers.pdf_text(pdf, tiers).collect()[0].tier == "good"


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, 1), (2, "c", 2), (3, "d", 1)], "k int, v string, t int")
    got = {r.k: (r.v, r.w, r.t) for r in sinks.upsert(old, new, "k", "t").collect()}
    assert got == {1: ("a", "x", None), 2: ("c", None, 2), 3: ("d", None, 1)}
    path = str(tmp_path / "t")
    keyed.append_absent(old, path, "k")
    keyed.append_absent(spark.createDataFrame([(2, "z", "z"), (4, "e", "e")], "k int, v string, w string"), path, "k")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 4]


def test_answers_of_all_paths(spark):
    from quillspark.operators import embed
    from quillspark.plans import answers

    schema = "query_id bigint, question string, long_answer boolean"
    asked = ["Chào", "2 + 2 = ?", "câu số 3 là gì", "trích 2 câu đầu", "so sánh câu 1 với câu 2", "câu số 9999", "so sánh câu 1 với câu 9999", "Ai viết", "Ai là tác giả", "who saw the river", "Trích nguyên văn lời nói"]
    q = spark.createDataFrame([(i, t, i == 8) for i, t in enumerate(asked)], schema)
    facts = spark.createDataFrame([(1, ["ai viết"], "By hand.", ["s"])], "place int, patterns array<string>, answer string, sources array<string>")
    cache = spark.createDataFrame([("ai là tác giả|la=1|intent=domain", "Cached.")], "key string, answer string")
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(1, 121)], "n int, text string")
    docs = embed.with_vectors(spark.createDataFrame([(1, "the river runs by"), (2, 'he said "nothing of it" and "none at all"')], "doc_id bigint, text string"))
    got = {r.query_id: (r.path, r.answer) for r in answers.answer_all(q, facts, cache, lines, docs, make=lambda: lambda texts: [f'<{t}> "no such line" "nor this one"' for t in texts]).collect()}
    assert len(got) == len(asked)
    assert got[2] == ("poem", "   3: line 3") and got[3] == ("poem", "   1: line 1\n   2: line 2")
    assert got[4][0] == "poem" and "   1: line 1\n   2: line 2" in got[4][1] and "Compare" in got[4][1]
    assert "which of these" in got[5][1] and "which of these" in got[6][1]
    assert got[7] == ("faq", "By hand.") and got[8] == ("cache", "Cached.")
    assert got[0][0] == "chitchat" and got[1][0] == "generic" and got[9][0] == "domain" and "the river runs by" in got[9][1]
    assert got[10][1].endswith("please check them.") and not got[9][1].endswith("please check them.")
    few = lines.where("n < 50")
    assert {r.query_id: r.answer for r in answers.answer_all(q, facts, cache, few, docs).collect()}[2] == answers.NOT_READY
