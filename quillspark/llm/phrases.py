"""Phrase collocations: frequent n-grams mined by pivot, scored, and thinned by longer ones.

Words are ordered from the most to the least frequent of their language.  The pivot of an n-gram is
its rarest word, where that first stands.  Each occurrence of a word sends one fragment to the word's
partition: the words around it as far as they are no rarer than it, three to a side at most, so that
every n-gram reaches exactly one partition and common words have short fragments.  Equal fragments are
added up before they are sent; a partition reads its fragments pivot by pivot, cuts them into the
n-grams that hold the pivot there, counts them and lets the infrequent ones go.

The table of ranks is broadcast, and only decides where an n-gram is counted: fragments are text, so
counts are exact whatever the table holds.  Words that cannot be frequent end fragments.  Where more
words are frequent than a broadcast may hold, the table has the most frequent of them and all other
words follow in the order of their hash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import textvec as tv
from quillspark.llm.common import Scratch, heavy_keys, joined_on, written

#: Least count of a phrase, words of the longest, phrases kept of each language, share in percent of
#: its count that a longer phrase needs to displace one.
LEAST, LONGEST, TOP, SHARE = 30, 4, 2000, 80
#: Words and bytes of the broadcast table of ranks.
TABLE_WORDS, TABLE_BYTES = 1_000_000, 32 << 20


@dataclass(frozen=True)
class Bounds:
    """What a task holds: occurrences of a pivot from which its fragments are divided among partitions,
    fragments held to add up equal ones, fragments cut at once, phrases of one pivot, bytes of text."""

    split: int = 1 << 18
    held: int = 150_000
    cut: int = 30_000
    counted: int = 500_000
    text: int = 1 << 20


#: Added to the pivot's place in a fragment of which only phrases that begin before it are counted.
_BEFORE = 16

_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in ".,;:!?"]] = 2
_KIND[10:14] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.int64(1) << 62


@dataclass
class Words:
    """Words of some texts: their bytes one after the other, where each begins, and its piece."""

    data: np.ndarray
    offsets: np.ndarray
    piece: np.ndarray

    def __len__(self) -> int:
        return len(self.piece)

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_string(), len(self), [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.data)])


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Texts in small letters, split at marks and line ends into pieces, at blanks and tabs into words."""
    raw = _LOWER[data[offsets[0] : offsets[-1]]]
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets - offsets[0]] = True
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    finish[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(finish) + 1 - start
    piece = np.searchsorted(np.flatnonzero((kind == 2) | edge[:-1]), start, "right")
    return Words(raw[inside], np.append(0, np.cumsum(length)), piece)


def _texts(column: pa.Array, limit: int):
    data, offsets = tv.buffers(column)
    for lo, hi in tv.cuts(offsets, limit):
        w = words(data, offsets[lo : hi + 1])
        if len(w):
            yield w


def _by_language(batch: pa.RecordBatch):
    langs = batch.column(0)
    for lang in pc.unique(langs).to_pylist():
        yield lang, batch.filter(pc.equal(langs, lang)).column(1)


def _word_counter(batches):
    """(lang, word, f) of each few megabytes of text."""
    for batch in batches:
        for lang, texts in _by_language(batch):
            for w in _texts(texts, Bounds.text):
                found = pc.value_counts(w.array())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found.field(0).cast(pa.string()), found.field(1)], ["lang", "word", "f"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f): occurrences of every word of texts (lang, text)."""
    return texts.mapInArrow(_word_counter, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


@dataclass
class Ranks:
    """Words of each language with their global places, the most frequent of all first, and counts;
    ``complete`` if every word that may be frequent is there."""

    words: dict[str, pa.Array]
    places: dict[str, np.ndarray]
    counts: np.ndarray
    complete: bool

    def of(self, lang: str, found: pa.Array) -> np.ndarray:
        """Ranks of words; ``_BLANK`` for those that end fragments."""
        known = self.words.get(lang)
        if known is None:
            at, missing = np.zeros(len(found), np.int64), np.ones(len(found), bool)
        else:
            place = pc.index_in(found, value_set=known)
            missing = place.is_null().to_numpy(zero_copy_only=False)
            at = self.places[lang][pc.fill_null(place, 0).to_numpy()]
        at[missing] = _BLANK
        if not self.complete and missing.any():
            rare = pc.dictionary_encode(found.filter(pa.array(missing)))
            hashes = np.array([(1 << 40) + (zlib.crc32(x.encode()) << 20 | zlib.adler32(x.encode()) & 0xFFFFF) for x in rare.dictionary.to_pylist()], np.int64)
            at[missing] = hashes[rare.indices.to_numpy()]
        return at


def ranks(counts: DataFrame, least: int = LEAST) -> Ranks:
    """The table of ranks over word counts (lang, word, f), bounded in words and bytes.

    If it can't hold all words of ``least`` occurrences, a histogram of counts tells from which count
    on it can."""
    often = counts.where(F.col("f") >= least)
    step = F.floor(F.log2("f") * 8).cast("int")
    sizes = sorted(((r["s"], r["n"], r["b"]) for r in often.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word") + F.octet_length("lang") + 16).alias("b")).collect()), reverse=True)  # a row for each eighth of a doubling
    n = b = taken = 0
    for _, more, size in sizes:
        if n + more > TABLE_WORDS or b + size > TABLE_BYTES:
            break
        n, b, taken = n + more, b + size, taken + 1
    complete = taken == len(sizes)
    if not complete:
        often = often.where(step >= sizes[taken - 1][0]) if taken else often.where(F.lit(False))
    t = often.select("lang", "word", "f").toArrow().combine_chunks()  # of bounded size
    t = t.sort_by([("f", "descending"), ("lang", "ascending"), ("word", "ascending")])
    place, f = np.arange(len(t), dtype=np.int64), t.column("f").to_numpy().astype(np.int64)
    known, places = {}, {}
    for lang in pc.unique(t.column("lang")).to_pylist():
        mine = pc.equal(t.column("lang"), lang)
        known[lang] = t.column("word").filter(mine).combine_chunks().cast(pa.large_string())
        places[lang] = place[mine.to_numpy()]
    return Ranks(known, places, f, complete)


def _extent(rank: np.ndarray, piece: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before each are more common than it, and how many behind no rarer, without a
    gap, within its piece and the longest phrase."""
    n = len(rank)
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    on, after = np.ones(n, bool), np.ones(n, bool)
    for k in range(1, min(longest, n)):
        on[:k], after[n - k :] = False, False
        on[k:] &= (rank[:-k] < rank[k:]) & (piece[:-k] == piece[k:])
        after[: n - k] &= (rank[k:] <= rank[: n - k]) & (piece[k:] == piece[: n - k])
        left += on
        right += after
    return left, right


def _fragments(w: Words, rank: np.ndarray, counts: np.ndarray, longest: int, bounds: Bounds):
    """Tables (home, at, fragment): one row for each word that has no rarer neighbour on some side.

    ``home`` tells the pivot's partition, its rank.  A divided pivot has parts, by the word before it
    for phrases that begin before it, by the word behind it for those that begin with it; so its
    fragments go to two parts, and still every phrase to one.  Homes of parts are negative."""
    left, right = _extent(rank, w.piece, longest)
    every = np.flatnonzero((rank < _BLANK) & (left + right > 0))
    for lo in range(0, len(every), bounds.cut):
        at = every[lo : lo + bounds.cut]
        first, last = at - left[at], at + right[at]
        a, b = int(first.min()), int(last.max()) + 1
        offsets = w.offsets[a : b + 1] - w.offsets[a]
        length = np.diff(offsets)
        # Words with one blank behind each; a fragment is a stretch of these bytes.
        spaced = np.full(int(offsets[-1]) + b - a, 32, np.uint8)
        spaced[np.arange(int(offsets[-1])) + np.repeat(np.arange(b - a), length)] = w.data[w.offsets[a] : w.offsets[b]]
        begin = offsets[:-1] + np.arange(b - a)
        pivot, place = rank[at], left[at].astype(np.int32)
        parts = np.ones(len(at), np.int64)
        known = pivot < len(counts)
        parts[known] = -(-counts[pivot[known]] // bounds.split)
        whole = np.flatnonzero(parts == 1)
        some = np.flatnonzero(parts > 1)
        one, two = some[left[at[some]] > 0], some[right[at[some]] > 0]
        part = lambda of, by, side: -1 - ((pivot[of] * 1_000_003 + rank[by] * 7919 % 1_000_003 % parts[of]) * 2 + side)
        home = np.concatenate([pivot[whole], part(one, at[one] - 1, 0), part(two, at[two] + 1, 1)])
        begins = np.concatenate([first[whole], first[one], at[two]]) - a
        ends = np.concatenate([last[whole], last[one], last[two]]) - a
        place = np.concatenate([place[whole], place[one] + _BEFORE, np.zeros(len(two), np.int32)])
        yield pa.table([pa.array(home), pa.array(place), _stretches(spaced, begin[begins], begin[ends] + length[ends])], names=["home", "at", "fragment"])


def _stretches(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[begin:end] of each pair, as texts."""
    size = end - begin
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(data[at])])


def _added(tables: list[pa.Table], names: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(names, use_threads=False).aggregate([("n", "sum")]).rename_columns([*names, "n"])


def _fragmenter(spread, longest: int, bounds: Bounds):
    """Fragments with the number of their occurrences, equal ones of a task added up while few are held."""
    names = ["home", "at", "fragment"]

    def rows(lang: str, t: pa.Table):
        t = t.append_column("lang", pa.array([lang] * len(t), pa.string())).select(["lang", *names, "n"])
        yield from t.set_column(3, "fragment", t.column("fragment").cast(pa.string())).to_batches(max_chunksize=20_000)

    def run(batches):
        table, held = spread.value, {}
        for batch in batches:
            for lang, texts in _by_language(batch):
                for w in _texts(texts, bounds.text):
                    for t in _fragments(w, table.of(lang, w.array()), table.counts, longest, bounds):
                        held.setdefault(lang, []).append(t.append_column("n", pa.array(np.ones(len(t), np.int64))))
                        if sum(len(x) for tables in held.values() for x in tables) > bounds.held:
                            held = {x: [_added(tables, names)] for x, tables in held.items()}
                            for x in [x for x in held if len(held[x][0]) > bounds.held // 8]:
                                yield from rows(x, held.pop(x)[0])
        for lang, tables in held.items():
            yield from rows(lang, _added(tables, names))

    return run


def _cut(t: pa.Table, longest: int) -> pa.Table:
    """(lang, phrase, n) of the phrases of two words and more that hold their fragment's pivot."""
    text = t.column("fragment").combine_chunks().cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    blank = np.flatnonzero(data == 32)
    begin = np.sort(np.append(offsets[:-1], blank + 1))
    end = np.sort(np.append(offsets[1:], blank))
    base = np.searchsorted(begin, offsets[:-1])
    size = np.diff(np.append(base, len(begin)))
    at = np.asarray(t.column("at"), np.int64)
    least = np.where(at >= _BEFORE, 1, 0)
    at = at % _BEFORE
    row, first, count = [], [], []
    for k in range(2, longest + 1):
        for d in range(k):
            ok = np.flatnonzero((at >= d) & (d >= least) & (at - d + k <= size))
            row.append(ok)
            first.append((base + at - d)[ok])
            count.append(np.full(len(ok), k))
    row, first, count = np.concatenate(row), np.concatenate(first), np.concatenate(count)
    phrase = _stretches(data, begin[first], end[first + count - 1])
    lang = t.column("lang").combine_chunks().dictionary_encode()
    code = pa.array(np.asarray(lang.indices)[row])
    out = _added([pa.table([code, phrase, pa.array(np.asarray(t.column("n"))[row])], names=["code", "phrase", "n"])], ["code", "phrase"])
    return pa.table([lang.dictionary.take(out.column("code").combine_chunks()), out.column("phrase").cast(pa.string()), out.column("n")], names=["lang", "phrase", "n"])


def _miner(least: int, longest: int, bounds: Bounds):
    """Counts (lang, phrase, n) of fragments sorted by home: those of ``least`` or more.

    A few homes, or a stretch of one, are cut at once.  Where one home has more phrases than a task
    holds, all their counts are passed on, to be added up by phrase."""
    names = ["lang", "phrase"]

    def often(t: pa.Table):
        yield from t.filter(pc.greater_equal(t.column("n"), least)).to_batches()

    def run(batches):
        going, counts, passed = None, [], False  # the home whose fragments are cut in several goes

        def cut(t: pa.Table):
            nonlocal going, counts, passed
            home = np.asarray(t.column("home"))
            if going is not None and home[0] != going:
                yield from done()
            begin = int(np.searchsorted(home, going, "right")) if going is not None else 0
            end = int(np.searchsorted(home, home[-1]))
            if going is None or end >= begin:
                if begin:
                    counts.append(_cut(t.slice(0, begin), longest))
                    yield from done()
                if end > begin:
                    yield from often(_added([_cut(t.slice(begin, end - begin), longest)], names))
                going, begin = int(home[-1]), end
                counts.append(_cut(t.slice(begin), longest))
            else:
                counts.append(_cut(t, longest))
            if sum(len(x) for x in counts) > bounds.counted:
                counts = [_added(counts, names)]
                if len(counts[0]) > bounds.counted // 2:
                    passed = True
                    yield from counts[0].to_batches()
                    counts = []

        def done():
            nonlocal going, counts, passed
            if counts:
                total = _added(counts, names)
                yield from total.to_batches() if passed else often(total)
            going, counts, passed = None, [], False

        for batch in batches:
            for lo in range(0, batch.num_rows, bounds.cut):
                yield from cut(pa.Table.from_batches([batch.slice(lo, bounds.cut)]))
        yield from done()

    return run


def frequent(texts: DataFrame, table: Ranks, least: int = LEAST, longest: int = LONGEST, bounds: Bounds = Bounds()) -> DataFrame:
    """(lang, phrase, f) of phrases of 2 to ``longest`` words with ``least`` occurrences or more.

    A pivot's partition counts its phrases and lets those go that stay below ``least``; pivots of more
    than ``bounds.split`` occurrences are divided among partitions by their neighbours."""
    spread = texts.sparkSession.sparkContext.broadcast(table)
    fragments = texts.mapInArrow(_fragmenter(spread, longest, bounds), "lang string, home bigint, at int, fragment string, n bigint")
    mined = fragments.repartition("home").sortWithinPartitions("home").mapInArrow(_miner(least, longest, bounds), "lang string, phrase string, n bigint")
    return mined.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _key(lang: str | Column, phrase: str | Column) -> Column:
    """One column for both: a phrase holds no line end."""
    return F.concat(lang, F.lit("\n"), phrase)


def scored(phrases: DataFrame, unigrams: DataFrame) -> DataFrame:
    """phrases (lang, phrase, f) with a, l, r, score of their lowest-scoring cut, ties to the first.

    ``unigrams`` (lang, phrase, f) holds the frequent words.  Both parts of a frequent phrase are
    frequent, so each is found; parts that many phrases begin or end with meet a broadcast."""
    known = phrases.select("lang", "phrase", "f").unionByName(unigrams).select(_key("lang", "phrase").alias("key"), "f")
    w = F.split("phrase", " ", -1)
    cut = phrases.select("lang", "phrase", F.col("f").alias("a"), w.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    part = lambda lo, n: _key("lang", F.array_join(F.slice("w", lo, n), " "))
    cut = written(cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("one"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("two")), "cuts")
    for side, name in (("one", "l"), ("two", "r")):
        heavy = heavy_keys(cut.groupBy(side).agg(F.count("*").alias("n")), side)
        cut = joined_on(cut, known.select(F.col("key").alias(side), F.col("f").alias(name)), side, heavy)
    score = F.expr("cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))").cast("bigint")
    low = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return low.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def displaced(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer phrase that holds a phrase."""
    w = F.col("w")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda s: F.array_join(F.slice(w, s, k), " "))))
    longer = phrases.select("lang", "f", F.split("phrase", " ", -1).alias("w")).where(F.size("w") > 2)
    return longer.select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, bounds: Bounds = Bounds()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    Texts are split at ``.,;:!?`` and line ends into pieces, these at blanks and tabs into words; only
    A to Z are made small.  Null texts are empty, a null language is ``und``.  Repeated documents count
    each time; other columns aren't read; a table without a frequent phrase gives an empty result.
    A very long text is split by itself and needs memory of some times its own size."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        counts = written(word_counts(texts), "words")
        total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
        often = written(frequent(texts, ranks(counts, least), least, longest, bounds), "phrases")
        unigrams = counts.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f")
        scores = scored(often, unigrams)
        left = scores.join(displaced(often), ["lang", "phrase"], "left").where(F.coalesce(F.lit(100).cast("decimal(38,0)") * F.col("most") < F.lit(share) * F.col("a"), F.lit(True)))
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        chosen = left.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)
        return scratch.keep(written(chosen.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations"))
