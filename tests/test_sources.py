"""Readers, sinks and settings that need files, tools or an environment."""

import json
import subprocess

import pytest

from quillspark.config import Settings
from quillspark.operators import validate
from quillspark.sources import readers, sinks

PDF = b"%PDF-1.4 not really"
LONG = "a text that is long enough to pass the gate of quality"


def test_settings(spark):
    assert Settings.read(env={}) == Settings()
    env = {"QUILLSPARK_TOP_K": " 7 ", "QUILLSPARK_LONG_ANSWER": "Yes", "QUILLSPARK_RERANK": "none"}
    assert Settings.read(env=env) == Settings(top_k=7, long_answer=True, rerank="none")
    spark.conf.set("spark.quillspark.top_k", "3")
    try:
        assert Settings.read(spark, env).top_k == 3
    finally:
        spark.conf.unset("spark.quillspark.top_k")


def test_pdf_tiers_call_tools_in_turn(monkeypatch):
    calls = []

    def run(command, **options):
        calls.append((command[0], options["input"]))
        if command[0] == "ocrmypdf":
            return subprocess.CompletedProcess(command, 0, stdout=b"layered")
        return subprocess.CompletedProcess(command, 0, stdout=("  " if options["input"] == PDF else LONG).encode())

    monkeypatch.setattr(subprocess, "run", run)
    tiers = dict(readers.PDF_TIERS)
    assert list(tiers) == ["pdftotext", "pdfium", "ocrmypdf", "page_images"]
    assert tiers["pdftotext"](PDF).strip() == "" and tiers["ocrmypdf"](PDF) == LONG
    assert calls == [("pdftotext", PDF), ("ocrmypdf", PDF), ("pdftotext", b"layered")]
    for name in ("pdfium", "page_images"):
        with pytest.raises(ImportError):
            tiers[name](PDF)


def test_pdf_without_tools_gives_no_text(spark):
    files = spark.createDataFrame([("p", bytearray(PDF))], "path string, content binary")
    r = readers.pdf_text(files).collect()[0]
    assert (r.text or "") == "" and r.tier is None


def test_corpus_order_ids_and_include(spark):
    para = " ".join(["word"] * 18)
    files = spark.createDataFrame([("x/b.md", "poem", "b", para), ("x/b.txt", "poem", "b", f"short\n\n{para} one\n \n{para} two"), ("x/c.txt", "bio", "c", para), ("x/d.txt", "ana", "d", para)], "path string, type string, stem string, text string")
    got = readers.corpus(files, ("poem", "bio")).orderBy("type", "place", "idx").collect()
    assert [r.id for r in got] == ["bio::c::0", "poem::b::0", "poem::b::1", "poem::b::0"] and got[1].text.endswith("one") and got[3].text == para


def test_versions_are_never_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "k int")
    sinks.new_version(rows, str(tmp_path), "a")
    with pytest.raises(Exception, match="exist"):
        sinks.new_version(rows, str(tmp_path), "a")


def test_exit_codes(spark):
    schema = "id string, source string, source_id string, type string, tags array<string>, line_start int, line_end int, char_start int, char_end int"
    good = ("b_0001_x", "s", "i", "bio", [], None, None, 0, 5)
    assert validate.exit_code(spark.createDataFrame([good], schema)) == 0
    assert validate.exit_code(spark.createDataFrame([good, ("", *good[1:])], schema)) == 1
    assert validate.exit_code(spark.createDataFrame([], schema)) == 0


def test_jobs(spark, tmp_path, capsys):
    from quillspark import jobs

    chunks = tmp_path / "chunks" / "bio"
    chunks.mkdir(parents=True)
    (chunks / "a.txt").write_text('###META### {"id": "a_0001_x", "source": "s", "source_id": "i", "type": "bio", "tags": [], "char_start": 0, "char_end": 4}\nsome text\n')
    assert jobs.main(["validate", str(tmp_path / "chunks")]) == 0
    (chunks / "b.txt").write_text("###META### {broken\nsome text\n")
    assert jobs.main(["validate", str(tmp_path / "chunks")]) == 1
    shown = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (shown["files"], shown["ok"], shown["prose_err"]) == (2, 1, 1) and shown["errors"][0]["reason"] == "header cannot be parsed"
    (tmp_path / "p.html").write_text("<title>T</title><body><article>" + "a long enough article " * 9 + "</article></body>")
    for _ in range(2):  # what is there isn't written again
        assert jobs.main(["pages", "--html", str(tmp_path / "p.html"), "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_generation_options_and_retried_writes(spark):
    from quillspark.config import generation_options
    from quillspark.operators import prompt

    rows = spark.createDataFrame([("a",)], "prompt string")
    got = prompt.generate(rows, lambda: lambda texts, **o: [f"{t} {o['max_tokens']} {o['temperature']}" for t in texts], options=generation_options(True)).collect()[0]
    assert got.answer == "a 1400 0.6" and generation_options(False)["max_tokens"] == 600
    tries = []

    def write(df):
        tries.append(df.count())
        if len(tries) < 3:
            raise OSError("busy")

    sinks.retried_write(rows, write, sleep=lambda s: None)
    assert tries == [1, 1, 1]
