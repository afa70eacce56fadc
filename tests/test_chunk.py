import pytest

from quillspark.operators import chunk, tags, validate


def test_windows(spark):
    docs = spark.createDataFrame([(n, "\n\n".join(f" l{i} " for i in range(1, n + 1))) for n in (1, 3, 4, 5, 7)] + [(0, None)], "k int, text string")
    got = {}
    for r in chunk.line_windows(docs, "k").orderBy("k", "block").collect():
        got.setdefault(r.k, []).append((r.line_start, r.line_end))
    assert got == {1: [(1, 1)], 3: [(1, 3)], 4: [(1, 4), (4, 4)], 5: [(1, 4), (4, 5)], 7: [(1, 4), (4, 7), (7, 7)]}


def words(n, end="."):
    return " ".join(["w"] * n) + end


def sizes(text):
    return [len(b[0].split()) for b in chunk.pack_prose(text, 10)]


def test_packing_rules():
    assert sizes(words(4) + "\n\n" + words(5)) == [9]
    assert sizes(words(6) + "\n\n" + words(25)) == [6, 25]  # a long paragraph behind a short one stays whole
    assert sizes(words(6) + " " + words(6) + "\n\n" + words(3)) == [6, 6, 3]  # a long one first is cut at sentences
    assert sizes(words(30)) == [30]
    assert sizes("") == [] and sizes(None) == [] and sizes(" \n ") == []


def test_spans_point_at_blocks():
    text = words(4) + "\n\n" + words(5) + "\n\n" + words(12) + " " + words(3)
    for part, a, b in chunk.pack_prose(text, 10):
        assert a < 0 or text[a:b] == part
    assert chunk.relaxed_span("A  b\nC d", "b c") == (3, 6) and chunk.relaxed_span("x", "y") == (-1, -1)


def test_numbers_are_taken_out(spark):
    raw = "1\n1. Trăm năm 2\n\n\n12) xx  y\n3"
    got = chunk.sanitise_numbers(spark.createDataFrame([(raw,)], "text string")).collect()[0].text
    assert got == "Trăm năm\n\nxx y\n"


def test_line_table_and_motifs(spark):
    raw = spark.createDataFrame(list(enumerate(["I", "a", "a", "b", "II", "b", "c"])), "pos int, line string")
    lines = chunk.numbered_lines(raw)
    assert [(r.n, r.text) for r in lines.orderBy("n").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    ranges = spark.createDataFrame([(3, 2, "y"), (1, 2, "x"), (2, 3, "y")], "a int, b int, motif string")
    m = chunk.motifs_of(lines, ranges)
    assert {r.n: r.motifs for r in m.collect()} == {1: ["x"], 2: ["x", "y"], 3: ["y"]}
    assert [(r.start, r.end, r.text, r.motifs) for r in chunk.couplets(m).orderBy("start").collect()] == [(1, 2, "a\nb", ["x", "y"]), (3, 3, "c", ["y"])]


@pytest.mark.parametrize("text,want", [("Thúy Kiều gặp TỪ HẢI", ["char:thuy_kieu", "char:tu_hai"]), ("hoa và liễu", ["device:uoc_le"]), ("hoa", []), ("ẩn dụ", ["device:an_du"]), (None, [])])
def test_literary_tags(spark, text, want):
    got = tags.with_tags(spark.createDataFrame([(text, "poem")], "text string, type string")).collect()[0].tags
    assert got == sorted([*want, "type:poem"])


def test_validation(spark):
    ddl = "id string, source string, source_id string, type string, tags array<string>, line_start int, line_end int, char_start int, char_end int"
    rows = [("a_L0001-0004_x", "s", "i", "poem", [], 1, 4, None, None), ("aL1", "s", "i", "poem", [], 5, 4, None, None), ("b", "s", "i", "bio", [], None, None, -1, -1), ("", "s", None, "x", None, None, None, 0, 1), ("c", "s", "i", "bio", [], None, None, 0, 1)]
    got = validate.checked(spark.createDataFrame(rows, ddl)).collect()
    assert [r.verdict for r in got] == ["ok", "poem", "prose", "basic", "ok"]
    assert got[1].reason == "line_end < line_start; id is not of the poem pattern" and got[3].reason == "no id; no source_id; unknown type; tags is not a list"
    assert validate.report(spark.createDataFrame(rows, ddl)).collect()[0].asDict() == {"files": 5, "ok": 2, "poem_ok": 1, "prose_ok": 1, "basic_err": 1, "poem_err": 1, "prose_err": 1}
