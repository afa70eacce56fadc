"""Benchmark decontamination.

A broadcast hash set holds the benchmark's word windows.  Every document's token windows are
looked up in one scan without a shuffle, each hit is verified word by word, and the document gets
its hit spans.  Contaminated documents or only the hit spans can then be removed.

The set is packed into a few arrays of some 25 bytes a word and is broadcast only within a bound;
a larger benchmark is taken in blocks, one set at a time, with the marks written in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textvec as tv
from quillspark.llm.common import dropped, written

WINDOW = 13
#: Benchmark text of one block, some of which is in one item at least.
BLOCK_BYTES = 8 << 20


class WindowSet:
    """The windows of some benchmark items.

    An item of fewer than ``size`` words, but not none, is one window; an item without words (a
    null or empty text too) has none.  Held are the items' words, each followed by a space, where
    words start, and for every length of window its hashes in order with the words they begin at.
    """

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.size = size
        self.names = [name for name, _ in items]
        raw, starts, firsts, n_words = [], [], [0], 0
        found: dict[int, tuple[list, list]] = {}
        n_bytes = 0
        for w in tv.pieces(pa.array([t or "" for _, t in items], pa.large_string())) if items else ():
            begin = np.cumsum(w.length + 1) - (w.length + 1)
            packed = np.full(int((w.length + 1).sum()), 32, np.uint8)
            inner = np.arange(int(w.length.sum())) - np.repeat(np.cumsum(w.length) - w.length, w.length)
            packed[np.repeat(begin, w.length) + inner] = w.data[np.repeat(w.start, w.length) + inner]
            n = np.diff(w.ptr)
            rest = tv.left(w)
            for k in np.unique(np.minimum(n, size)).tolist():
                if k:
                    at = np.flatnonzero((np.repeat(np.minimum(n, size), n) == k) & (rest >= k))
                    hashes, places = found.setdefault(k, ([], []))
                    hashes.append(tv.windows(w, k)[at])
                    places.append((at + n_words).astype(np.uint32))
            raw.append(packed)
            starts.append((begin + n_bytes).astype(np.uint32))
            firsts += (w.ptr[1:] + n_words).tolist()
            n_words, n_bytes = n_words + len(w.hash), n_bytes + len(packed)
        self.raw = np.concatenate(raw).tobytes() if raw else b""
        self.starts = np.append(np.concatenate(starts) if starts else np.zeros(0, np.uint32), np.uint32(n_bytes))
        self.firsts = np.array(firsts, np.uint32)
        self.tables = {k: self._table(k, np.concatenate(h), np.concatenate(p)) for k, (h, p) in found.items()}

    def _table(self, k: int, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order and places; of equal windows in one item the first is kept."""
        order = np.lexsort((places, self._items(places), hashes))
        hashes, places = hashes[order], places[order]
        item = self._items(places)
        keep = np.ones(len(hashes), bool)
        last = 0
        for i in np.flatnonzero((hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])).tolist():
            if i and not keep[i]:  # a run of equal ones goes back to its first
                first = last
            else:
                first = i
            if self.window(int(places[i + 1]), k) == self.window(int(places[first]), k):
                keep[i + 1], last = False, first
        return hashes[keep], places[keep]

    def _items(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, places, "right") - 1

    def window(self, place: int, k: int) -> bytes:
        return self.raw[self.starts[place] : self.starts[place + k] - 1]

    def nbytes(self) -> int:
        """Bytes held, names aside."""
        return len(self.raw) + self.starts.nbytes + self.firsts.nbytes + sum(h.nbytes + p.nbytes for h, p in self.tables.values())

    def scan(self, w: tv.Words, filters: dict[int, tv.Bits]) -> list[tuple[int, int, int, str]]:
        """(row, first word, words, item) of each verified occurrence."""
        out = []
        remaining = tv.left(w) if self.tables else None
        rows = w.row_of() if self.tables else None
        for k, (members, places) in self.tables.items():
            hashes = tv.windows(w, k)
            at = filters[k].maybe(hashes)
            at = at[remaining[at] >= k]
            low, high = (np.searchsorted(members, hashes[at], side) for side in ("left", "right"))
            for i, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                text = b" ".join(w.bytes_of(j) for j in range(i, i + k))
                same = [p for p in places[a:b].tolist() if self.window(p, k) == text]
                out += [(int(rows[i]), i, k, self.names[x]) for x in self._items(np.array(same, np.uint32)).tolist()] if same else []
        return out

    def filters(self) -> dict[int, tv.Bits]:
        """Bit tables of a fixed size that let few other hashes by; made anew in each worker."""
        return {k: tv.Bits(h) for k, (h, _) in self.tables.items()}


def _item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Distinct items in blocks of about ``block_bytes`` or less; one block is on the driver at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("words")).where(F.col("words").isNotNull() & F.col("item").isNotNull()).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("words") + 32), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    if blocks > 1:
        rows = written(rows, "items")
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b)
        found = [(r.item, r.words) for r in part.collect()]
        if found:
            yield found
    if blocks > 1:
        dropped(rows)


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``contamination``.

    Fields: ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``items`` (ids of the
    items with occurring windows, sorted as strings) and ``spans`` (``start``, ``end`` of each
    maximal run of hit words, in bytes of the UTF-8 text).  A null or empty text has no words;
    items with a null id or text are left out; repeated items count once; an empty benchmark hits
    nothing.  A column named ``contamination`` in ``docs`` is replaced, all others are kept.

    A benchmark beyond ``block_bytes`` of text costs a scan of the documents for each block, with
    the marked documents written in between; only one block's windows are held at a time.
    """
    names = [c for c in docs.columns if c != "contamination"]
    out = docs.select(*names).withColumn("contamination", F.lit(None).cast(_STATE))
    blocks = _item_blocks(benchmark, item_id, item_text, block_bytes)
    spread, before = None, None
    for k, items in enumerate(blocks):
        if spread is not None:  # what the last block marked is written before the next one is held
            after = written(out, "marks")
            spread.destroy()
            if before is not None:
                dropped(before)
            out = before = after
        spread = docs.sparkSession.sparkContext.broadcast(WindowSet(items, window))
        out = out.mapInArrow(_scanner(spread, text, k == 0), out.schema)
    if spread is None:
        spread = docs.sparkSession.sparkContext.broadcast(WindowSet([], window))
        out = out.mapInArrow(_scanner(spread, text, True), out.schema)
    return out


_STATE = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])


def _scanner(spread, text: str, first: bool):
    def run(batches):
        windows = spread.value
        filters = windows.filters()
        for batch in batches:
            names = batch.schema.names
            before = [None] * batch.num_rows if first else batch.column(names.index("contamination")).to_pylist()
            states = []
            for w in tv.pieces(batch.column(names.index(text))):
                hits: dict[int, list] = {}
                for row, i, k, item in windows.scan(w, filters):
                    hits.setdefault(row, []).append((i, i + k, item))
                n = np.diff(w.ptr)
                for row in range(w.rows):
                    was = before[w.first + row]
                    if row not in hits:
                        states.append(was or {"n_words": int(n[row]), "n_hit": 0, "items": [], "spans": []})
                        continue
                    a, b = w.ptr[row : row + 2]
                    hit = np.zeros(b - a + 2, np.int8)
                    covered = np.zeros(b - a, bool)
                    for lo, hi, _ in hits[row]:
                        covered[lo - a : hi - a] = True
                    zero = w.offsets[row]
                    if was:
                        begin = w.start[a:b] - zero
                        for s in was["spans"]:
                            covered[np.searchsorted(begin, s["start"]) : np.searchsorted(begin, s["end"])] = True
                    hit[1:-1] = covered
                    up, down = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
                    spans = [{"start": int(w.start[a + x] - zero), "end": int(w.start[a + y - 1] + w.length[a + y - 1] - zero)} for x, y in zip(up, down)]
                    items = sorted({x[2] for x in hits[row]} | set(was["items"] if was else ()))
                    states.append({"n_words": int(n[row]), "n_hit": int(covered.sum()), "items": items, "spans": spans})
            columns = [batch.column(i) for i, c in enumerate(names) if c != "contamination"]
            kept = [c for c in names if c != "contamination"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(states, _ARROW)], [*kept, "contamination"])

    return run


def contaminated(state: str = "contamination", share: int = 20):
    """At least one in ``share`` words is hit."""
    return (F.col(f"{state}.n_hit") > 0) & (F.lit(share) * F.col(f"{state}.n_hit") >= F.col(f"{state}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """Remove contaminated documents, or only the hit spans (``remove="spans"``) from all texts.

    Columns are those of ``docs``, but a column named ``contamination`` holds the marks; rows
    without words always stay.
    """
    marked = mark(docs, benchmark, text=text, **options)
    if remove == "documents":
        return marked.where(~F.coalesce(contaminated(), F.lit(False))).select(*docs.columns)
    if remove != "spans":
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    raw = F.col(text).cast("binary")
    spans = F.col("contamination.spans")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s.end))
    ends = F.concat(F.transform(spans, lambda s: s.start), F.array(F.octet_length(F.col(text)).cast("bigint")))
    parts = F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(raw, a.cast("int") + 1, (b - a).cast("int")), "UTF-8"))
    kept = F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(F.col(text))
    return marked.withColumn(text, kept).select(*docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with the digest columns of its marks."""
    state = F.col("contamination")
    return mark(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", state.n_words.alias("n_words"), state.n_hit.alias("n_hit"), F.size(state["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(state["items"], ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
