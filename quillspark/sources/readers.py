"""Sources: pages, text folders, chunk files, Markdown sections, JSON arrays and lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import CHUNKING
from quillspark.functions import text as T
from quillspark.functions.html import extract
from quillspark.operators import chunk
from quillspark.schemas import META_DDL

META = "###META###"
# Types by the first folder of a path.
TYPE_BY_FOLDER = ("poem", "analysis", "summary", "bio")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): lines that aren't blank or comments."""
    return spark.read.text(path).select(T.strip_ends(F.col("value")).alias("url")).where("url <> '' and not startswith(url, '#')")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def http_get(url: str, timeout: float = 25.0) -> str:
    """The page's text, by a desktop browser's name; an error status raises."""
    from urllib.request import Request, urlopen

    agent = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome Safari"
    with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def fetched(urls: DataFrame, get: Callable[[str], str] = http_get) -> DataFrame:
    """urls (url) with ``html`` and ``error``: a page that cannot be had is a row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for u in part["url"]:
                try:
                    rows.append((u, get(u), None))
                except Exception as e:
                    rows.append((u, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string")


def articles(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Pages with title, markdown, plain text and a file ``name`` from URL and its hash."""
    out = extract(pages, html)
    return out.withColumn("name", F.concat(T.url_basename(url), F.lit("-"), T.url_hash(url)))


def text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, type, stem, text) of all files below ``path``; the type is the first folder's."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    root = path.rstrip("/").split("/")[-1]
    folder = F.regexp_extract(where, f"/{root}/([^/]+)/", 1)
    kind = F.when(folder.isin(*TYPE_BY_FOLDER), folder).otherwise("analysis")
    name = F.element_at(F.split(where, "/"), -1)
    return raw.select(where.alias("path"), kind.alias("type"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("value").alias("text"))


def corpus(files: DataFrame, include: tuple[str, ...] = TYPE_BY_FOLDER, *, least: int = CHUNKING.min_paragraph_words) -> DataFrame:
    """files (path, type, stem, text) of the included types to (id, type, source, idx, text, place).

    One document for each paragraph, with the id ``type::stem::idx``; ``place`` orders a type's
    ``.txt`` files before its ``.md`` files, then by path.  A stem that is in both gives the ids of
    both, as its files are documents of their own."""
    chosen = of_type(files, *include).withColumn("place", F.struct(F.endswith("path", F.lit(".md")).cast("int").alias("kind"), "path"))
    keyed = chosen.withColumn("_key", F.struct("type", "stem", "place"))
    rows = chunk.paragraphs(keyed, "_key", least=least)
    ident = F.concat_ws("::", "_key.type", "_key.stem", F.col("idx").cast("string"))
    return rows.select(ident.alias("id"), "_key.type", F.col("_key.stem").alias("source"), "idx", "text", "_key.place")


def parse_chunks(raw: DataFrame, *, min_words: int = CHUNKING.min_chunk_words) -> DataFrame:
    """raw (stem, text) of chunk files to (id, text, meta, parsed).

    A file must begin with a header line; one that isn't JSON counts as empty.  Bodies that are
    empty or under ``min_words`` are dropped; the id falls back to the stem; tags are distinct."""
    head = T.strip_ends(F.expr(f"substring(substring_index(text, '\\n', 1), {len(META) + 1})"))
    body = T.strip_ends(F.expr("case when instr(text, '\\n') > 0 then substring(text, instr(text, '\\n') + 1) else '' end"))
    rows = raw.where(F.startswith("text", F.lit(META))).withColumns({"meta": F.from_json(head, META_DDL, {"mode": "PERMISSIVE"}), "_json": head.rlike(r"^\{.*\}$"), "text": body})
    rows = rows.withColumn("parsed", F.col("meta").isNotNull() & F.col("_json")).withColumn("meta", F.col("meta").withField("tags", F.array_distinct("meta.tags")))
    return rows.where((F.col("text") != "") & (T.word_count("text") >= min_words)).select(F.coalesce(F.when(F.col("meta.id") != "", F.col("meta.id")), F.col("stem")).alias("id"), "text", "meta", "parsed")


def poem_lines(raw: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """raw (pos, line) cleaned: no leading numbers, single spaces, lines with letters only.
    ``fallback`` is used when that gives nothing."""
    out = raw.select("pos", T.clean_line(T.strip_verse_number("line")).alias("line")).where(T.looks_like_verse("line"))
    return poem_lines(fallback) if fallback is not None and not out.limit(1).count() else out


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str, *, seed: int | None = None, key: str | None = None) -> DataFrame:
    """Rows of a JSON-lines file; with a seed, in an order that follows hashes of ``key``."""
    rows = spark.read.schema(schema).json(path)
    return rows if seed is None else rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)))


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(…, place, title, body): second-level sections of Markdown; preambles are dropped."""
    parts = F.filter(F.transform(F.split(F.col(text), r"(?m)^##\s+"), T.strip_ends), lambda p: (p != "") & ~F.startswith(p, F.lit("# ")))
    rows = docs.select(*[c for c in docs.columns if c != text], F.posexplode(parts).alias("place", "p"))
    body = F.expr("case when instr(p, '\\n') > 0 then substring(p, instr(p, '\\n') + 1) else '' end")
    return rows.withColumn("title", T.strip_ends(F.substring_index("p", "\n", 1))).withColumn("body", T.strip_ends(body)).drop("p")


def _piped(*command: str) -> Callable[[bytes], str]:
    """Text that a command-line tool gives for a file on its standard input."""

    def run(content: bytes) -> str:
        import subprocess

        return subprocess.run(command, input=content, capture_output=True, check=True, timeout=600).stdout.decode("utf-8", "ignore")

    return run


def _pdfium(content: bytes) -> str:
    import pypdfium2

    return "\n".join(page.get_textpage().get_text_range() for page in pypdfium2.PdfDocument(content))


def _recognised(content: bytes) -> str:
    """A text layer put on by a recogniser, read back by the first tier."""
    import subprocess

    layered = subprocess.run(("ocrmypdf", "--force-ocr", "-", "-"), input=content, capture_output=True, check=True, timeout=3600).stdout
    return _piped("pdftotext", "-layout", "-", "-")(layered)


def _page_images(content: bytes) -> str:
    import pypdfium2
    import pytesseract

    return "\n".join(pytesseract.image_to_string(page.render(scale=3).to_pil()) for page in pypdfium2.PdfDocument(content))


#: Tools that give a PDF's text, the quickest first; one that isn't installed fails and is passed over.
PDF_TIERS = [("pdftotext", _piped("pdftotext", "-layout", "-", "-")), ("pdfium", _pdfium), ("ocrmypdf", _recognised), ("page_images", _page_images)]


def pdf_text(files: DataFrame, tiers: list[tuple[str, Callable[[bytes], str | None]]] | None = None) -> DataFrame:
    """files (path, content) with (text, tier): the first tier whose text passes the quality gate;
    the last tier's text is taken if it isn't empty.  Tiers that fail or are not installed give null."""

    tiers = PDF_TIERS if tiers is None else tiers

    def gate(t: str | None) -> bool:
        return bool(t) and len(t.strip()) >= 40 and t.count("�") <= 0.01 * len(t)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                found = ("", None)
                for k, (name, call) in enumerate(tiers):
                    try:
                        t = call(content)
                    except Exception:
                        t = None
                    if gate(t) or (t and k == len(tiers) - 1):
                        found = (t, name)
                        break
                rows.append((path, *found))
            yield pd.DataFrame(rows, columns=["path", "text", "tier"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, tier string")


def of_type(chunks: DataFrame, *types: str, column: str | Column = "type") -> DataFrame:
    """Chunks of some types; on a table partitioned by type only those are read."""
    return chunks.where((F.col(column) if isinstance(column, str) else column).isin(*types))
