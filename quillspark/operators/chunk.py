"""Chunkers: texts to blocks of lines or words."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import CHUNKING
from quillspark.functions import text as T
from quillspark.operators.intervals import join_ranges


def lines_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line): trimmed lines that aren't blank, numbered from 1."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), T.strip_ends), lambda x: x != "")
    return docs.select(key, F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def line_windows(docs: DataFrame, key: str, text: str = "text", *, size: int = CHUNKING.poem_lines, overlap: int = CHUNKING.poem_overlap) -> DataFrame:
    """(key, block, line_start, line_end, text): windows of ``size`` lines that share ``overlap``.

    Windows begin at every ``size - overlap``-th line while lines are left, so the last may lie
    within the one before.  All stays within the row: no shuffle."""
    step = max(1, size - overlap)
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), T.strip_ends), lambda x: x != "")
    rows = docs.select(key, lines.alias("_l")).where(F.size("_l") > 0)
    starts = F.sequence(F.lit(0), F.size("_l") - 1, F.lit(step))
    blocks = F.transform(starts, lambda i: F.struct((i + 1).alias("line_start"), F.least(i + size, F.size("_l")).alias("line_end"), F.array_join(F.slice("_l", i + 1, F.lit(size)), "\n").alias("text")))
    return rows.select(key, F.posexplode(blocks).alias("block", "b")).select(key, "block", "b.line_start", "b.line_end", "b.text")


_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.?!…:;])\s+")


class _Packer:
    """Greedy packing under a word limit, with the span of each block."""

    def __init__(self, text: str, limit: int):
        self.text, self.limit, self.cursor, self.blocks = text, limit, 0, []

    def find(self, part: str) -> int:
        return self.text.find(part, self.cursor)

    def emit(self, block: str, start: int) -> None:
        end = start + len(block) if start >= 0 else -1
        self.blocks.append((block, start if start >= 0 else -1, end))
        self.cursor = end if end >= 0 else self.cursor

    def pack(self, parts, glue: str, on_large):
        """Yields (block, start) on overflow and (block, start, True) at the end.  ``on_large`` takes a part that alone is over the
        limit while the buffer is empty."""
        held, words, start = [], 0, -1
        for part in parts:
            n = len(part.split())
            if words + n <= self.limit:
                if not held:
                    start = self.find(part)
                if part:
                    held.append(part)
                words += n
            elif held:
                yield glue.join(held), start
                held, words, start = [part], n, self.find(part)
            else:
                on_large(part)
        if held:
            yield glue.join(held), start, True

    def sentences(self, paragraph: str) -> None:
        for block in self.pack(_SENTENCE.split(paragraph), " ", lambda s: self.emit(s, self.find(s))):
            self.emit(block[0], block[1])

    def run(self) -> list[tuple[str, int, int]]:
        paragraphs = [p.strip() for p in _PARAGRAPH.split(self.text) if p.strip()]
        for block in self.pack(paragraphs, "\n\n", self.sentences):
            if len(block) == 3:  # the rest keeps the place where its first paragraph was found
                self.emit(block[0], block[1])
            else:
                self.emit(block[0], self.text.find(block[0], max(block[1], 0)))
        return self.blocks


def pack_prose(text: str | None, limit: int = CHUNKING.prose_words) -> list[tuple[str, int, int]]:
    """(text, char_start, char_end) blocks of at most ``limit`` words; -1 where a block isn't found
    as it stands.  Paragraphs are packed; a paragraph that is over the limit alone is packed by
    sentences if nothing waits before it, else it becomes a block; so does such a sentence."""
    return _Packer(text, limit).run() if text and not text.isspace() else []


def prose_chunks(docs: DataFrame, key: str, text: str = "text", *, limit: int = CHUNKING.prose_words) -> DataFrame:
    """(key, block, text, char_start, char_end, n_words): see :func:`pack_prose`.

    A document's blocks depend on each other, documents don't: packed in Arrow batches where the
    rows are, without a shuffle."""

    def run(batches):
        for batch in batches:
            keys, blocks, rows = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, (part, start, end) in enumerate(pack_prose(t, limit)):
                    keys.append(i)
                    blocks.append(k)
                    rows.append((part, start, end, len(part.split())))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(blocks, pa.int32()), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int32()) for c in cols[1:])],
                [key, "block", "text", "char_start", "char_end", "n_words"],
            )

    rows = docs.select(key, F.col(text).alias("_t"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, block int, text string, char_start int, char_end int, n_words int")


def relaxed_span(text: str, part: str, start: int = 0) -> tuple[int, int]:
    """Where ``part`` stands in ``text``, whatever its white space and letter case; (-1, -1) if nowhere."""
    words = part.split()
    if not words:
        return -1, -1
    m = re.compile(r"\s+".join(map(re.escape, words)), re.IGNORECASE).search(text, start)
    return m.span() if m else (-1, -1)


def chunk_id(source_id: str, content: str, *, poem: bool):
    """Ids of chunk rows: place and the first six hash digits of the content."""
    head = T.sha1_head(content, 6)
    if poem:
        return F.concat(F.col(source_id), F.format_string("_L%04d-%04d_", F.col("line_start"), F.col("line_end")), head)
    return F.concat(F.col(source_id), F.format_string("_%04d_", F.col("block")), head)


def couplets(lines: DataFrame) -> DataFrame:
    """lines (n, text, motifs) to (start, end, text, motifs): consecutive pairs, the last may be single."""
    first = lambda a: F.array_distinct(F.flatten(a))
    pairs = lines.groupBy(F.floor((F.col("n") - 1) / 2).alias("pair")).agg(F.min("n").alias("start"), F.max("n").alias("end"), F.sort_array(F.collect_list(F.struct("n", "text", "motifs"))).alias("l"))
    return pairs.select("start", "end", F.array_join(F.transform("l", lambda x: x.text), "\n").alias("text"), first(F.transform("l", lambda x: x.motifs)).alias("motifs"))


def couplet_documents(pairs: DataFrame, source: str = "poem") -> DataFrame:
    return pairs.select(F.format_string("poem::%04d-%04d", "start", "end").alias("doc_id"), "text", F.struct(F.lit(source).alias("source"), F.lit("poem").alias("type"), F.col("start").alias("line_start"), F.col("end").alias("line_end"), "motifs").alias("metadata"))


def paragraphs(docs: DataFrame, key: str, text: str = "text", *, least: int = CHUNKING.min_paragraph_words) -> DataFrame:
    """(key, idx, text): squeezed paragraphs of at least ``least`` words, numbered after that filter."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)\n\s*\n"), T.squeeze), lambda p: F.size(F.split(p, " ")) >= least)
    return docs.select(key, F.posexplode(parts).alias("idx", "text"))


def sanitise_numbers(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with digits, numbered lines' numbers and lines of digits only taken out of the text."""
    t = F.replace(T.nfc(F.coalesce(F.col(text), F.lit(""))), F.lit(T.NBSP), F.lit(" "))
    lines = F.split(T.rx(t, r"\r\n?", "\n"), "\n")
    lines = F.filter(F.transform(lines, T.strip_ends), lambda s: ~s.rlike(r"^\p{Nd}+$"))
    strip = lambda s: T.strip_ends(T.rx(T.rx(T.rx(s, r"^\p{Nd}+[.\-:)]*(?U)\s*", ""), r"\p{Nd}+", ""), r"(?U)\s{2,}", " "))
    joined = F.array_join(F.transform(lines, strip), "\n")
    return docs.withColumn(text, F.concat(T.strip_ends(T.rx(joined, r"\n{3,}", "\n\n")), F.lit("\n")))


def numbered_lines(raw: DataFrame, order: str = "pos", text: str = "line") -> DataFrame:
    """raw (pos, line) to (n, text): roman section marks and repeats of the line before are left
    out, the rest are numbered.

    Numbers run over the whole text, so this is for one work's lines; the window is one task."""
    one = Window.orderBy(order)
    kept = raw.where(~F.trim(text).isin("I", "II", "III", "IV")).withColumn("_before", F.lag(text).over(one)).where(F.col("_before").isNull() | (F.col("_before") != F.col(text)))
    return kept.select(F.row_number().over(one).alias("n"), F.col(text).alias("text"))


def motifs_of(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """lines (n, …) with ``motifs``: those of the ranges (a, b, motif) around n, in order of the ranges.

    Lines meet ranges by bins as wide as the range, see :func:`quillspark.operators.intervals.join_ranges`."""
    real = ranges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.trim("motif").alias("motif")).where("motif <> ''")
    per = join_ranges(lines.select("n").distinct(), real).groupBy("n").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("a", "b", "motif"))), lambda x: x.motif)).alias("motifs"))
    return lines.join(per, "n", "left").withColumn("motifs", F.coalesce("motifs", F.array().cast("array<string>")))
