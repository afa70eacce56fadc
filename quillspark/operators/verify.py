"""Verification of quotations against known lines, and their correction."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.functions import text as T
from quillspark.session import stored

THRESHOLD = 88.0
_QUOTE = "\"([^\"\\n]{4,200})\"|“([^”\\n]{4,200})”"


def quotes(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, quote, start, end): straight or curly quotations of 4 to 200 characters on one
    line, in order; spans count code points and include the marks."""
    whole = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({_QUOTE})"), F.lit(1))
    rows = answers.select(key, F.col(text).alias("_t"), F.posexplode(whole).alias("place", "_q"))
    # A match's start: everything before it is a sequence of earlier matches and what parts them.
    order = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    gaps = F.transform(F.split(F.col("_t"), f"(?:{_QUOTE})"), F.length)
    before = F.aggregate(F.slice(gaps, F.lit(1), F.col("place") + 1), F.lit(0), lambda a, x: a + x)
    start = before + F.coalesce(F.sum(F.length("_q")).over(order), F.lit(0))
    out = rows.withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.length("_q")).cast("int"))
    return out.select(key, "place", F.expr("substring(_q, 2, length(_q) - 2)").alias("quote"), "start", "end")


def canonical(lines: DataFrame, n: str = "n", text: str = "text") -> DataFrame:
    """(canon, n, text) of all lines; empty forms are left out."""
    # Exploded, so that the form is not computed again for a filter that is pushed below it.
    form = F.explode(F.filter(F.array(T.canon(text)), lambda x: x != "")).alias("canon")
    return lines.select(form, F.col(n).alias("n"), F.col(text).alias("text"))


def _first(rows: DataFrame) -> DataFrame:
    return rows.groupBy("canon").agg(F.min(F.struct("n", "text")).alias("m")).select("canon", "m.n", "m.text")


def choices(lines: DataFrame, n: str = "n", text: str = "text") -> DataFrame:
    """(canon, n, text): each canonical form once, where it comes first; empty forms are left out."""
    return _first(canonical(lines, n, text))


def levenshtein_score(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(F.lit(100.0) * (1 - F.levenshtein(a, b) / longest))


@F.pandas_udf(DoubleType())
def sequence_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() * 100 for x, y in zip(a, b)])


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by a bit for each character of ``a``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    rest = whole
    for c in b:
        met = rest & at.get(c, 0)
        rest = (rest + met | rest - met) & whole
    return len(a) - rest.bit_count()


def _token_set(a: str, b: str) -> float:
    """The best likeness, by common subsequences, among the shared words and each side's
    shared-plus-own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, [both, " ".join(sorted(s - (x & y)))])) for s in (x, y))
    if both and (one == both or two == both):
        return 100.0
    like = lambda p, q: 200.0 * _common(p, q) / max(1, len(p) + len(q))
    return max([like(one, two), *([like(both, one), like(both, two)] if both else [])])


@F.pandas_udf(DoubleType())
def token_set_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_token_set(x, y) for x, y in zip(a, b)])


def _edits(length: Column, share: float) -> Column:
    """The most edits between a line of that length and any form at least ``share`` like it."""
    return F.floor(length * ((1 - share) / share) + 1e-9).cast("int")


def _cut(length: Column, k: Column, parts: Column) -> Column:
    return F.floor(k * length / parts).cast("int")


def _segments(known: DataFrame, share: float) -> DataFrame:
    """(key, l): each line's id by hashes of (length, k, piece), in one piece more than edits are allowed."""
    n = F.length("canon")
    rows = known.select("canon", n.alias("length"), F.posexplode(F.sequence(F.lit(0), _edits(n, share))).alias("p", "k"))
    parts = _edits(F.col("length"), share) + 1
    start = _cut(F.col("length"), F.col("k"), parts)
    piece = F.substring("canon", start + 1, _cut(F.col("length"), F.col("k") + 1, parts) - start)
    return rows.select(F.xxhash64("length", "k", piece).alias("key"), F.xxhash64("canon").alias("l"))


def _probes(forms: DataFrame, share: float) -> DataFrame:
    """(key, f): each form's id by where a piece of a fitting line of each length may stand in it.

    Some piece stands unchanged with at most k edits before it and at most the rest behind it, so
    piece k is shifted by at most k places seen from either end."""
    n = F.length("_c")
    rows = forms.withColumn("length", F.explode(F.sequence(F.ceil(n * share - 1e-9).cast("int"), F.floor(n / share + 1e-9).cast("int"))))
    edits = _edits(F.col("length"), share)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), edits)))
    k, more = F.col("k"), n - F.col("length")
    low, high = F.greatest(-k, more - (edits - k)), F.least(k, more + (edits - k))
    rows = rows.where(low <= high).withColumn("shift", F.explode(F.sequence(low, high)))
    start = _cut(F.col("length"), F.col("k"), edits + 1)
    size = _cut(F.col("length"), F.col("k") + 1, edits + 1) - start
    rows = rows.withColumns({"at": start + F.col("shift"), "size": size}).where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= n))
    piece = F.substring("_c", F.col("at") + 1, F.col("size"))
    return rows.select(F.xxhash64("length", "k", piece).alias("key"), F.xxhash64("_c").alias("f"))


def _piece_pairs(forms: DataFrame, known: DataFrame, share: float) -> DataFrame:
    """Pairs of Levenshtein likeness ``share`` or more, and others.  A known line is cut into one
    piece more than the edits allowed, so one piece stands unchanged, and hardly moved, in any form
    that is like it: forms and lines are equi-joined on length, piece number and piece.  Ids and
    hashes are joined, texts are fetched for what meets."""
    met = _probes(forms, share).join(_segments(known, share), "key").select("f", "l").distinct()
    return _texts_of(met, forms.select(F.xxhash64("_c").alias("id"), "_c"), known.select(F.xxhash64("canon").alias("id"), "canon"))


def _within(a: Column, b: Column, share: float) -> Column:
    """Whether the edits are few enough for matching characters of ``share`` of both lengths: what
    doesn't match is inserted or deleted, and the Levenshtein distance is no more than that."""
    most = F.floor((1 - share) * (F.length(a) + F.length(b)) + 1e-6).cast("int")
    return F.call_function("levenshtein", a, b, most) >= 0


#: Grams in which two sides of a candidate pair must agree beyond the one that a prefix guarantees.
MORE = 5
#: Characters of canonical forms; a gram is three of them, or two.
_CHARS = " 0123456789abcdefghijklmnopqrstuvwxyz"
_PLACE = np.zeros(128, np.int64)
_PLACE[[ord(c) for c in _CHARS]] = np.arange(len(_CHARS))
_RUN = 1 << 20


def _least_grams(n, m, share: float, size: int, words=0):
    """Grams that a form of n and a line of m characters share at least, if matching characters are
    ``share`` of both: what doesn't match is deleted, which ends ``size`` grams each, or inserted,
    which ends one less.  With a number of words, grams across blanks don't count."""
    apart = (1 - share) * (n + m)
    whole = n + size - 1 if isinstance(words, int) else n + (2 - size) * words + (size - 2)
    return whole - (2 * size - 1) / 2 * apart - (n - m) / 2


def _gram_rows(share: float, size: int, by_word: bool, order=None):
    """A function of Arrow batches (id, text): its grams (key, df 1) to be counted, or with ``order``
    (places of grams, rarest first) its rarest grams (id, n, words, key, at), as many as a partner must
    meet at least ``1 + MORE`` of, or all.

    Every occurrence of a gram in a text has a key of its own."""

    def run(batches):
        for batch in batches:
            ids, keys, n_, k_, at_ = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = text.count(" ") + 1 if by_word else 0
                padded = np.frombuffer((f" {text} " if by_word else " " * (size - 1) + text + " " * (size - 1)).encode(), np.uint8)
                if len(padded) < size:
                    continue
                c = _PLACE[padded]
                gram = c[: len(c) - size + 1].copy()
                for j in range(1, size):
                    gram = gram * len(_CHARS) + c[j : len(c) - size + 1 + j]
                place = np.arange(len(gram))
                if by_word and size == 3:
                    inner = c[1:-1] != 0  # a blank in the middle parts two words
                    gram, place = gram[inner], place[inner]
                n = len(text)
                if order is None:
                    keys.append(gram)
                    continue
                least = _least_grams(n, n * share / (2 - share), share, size, np.int64(k) if by_word else 0)
                run_of = np.lexsort((place, gram))
                g = gram[run_of]
                start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
                nth = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
                rare = np.lexsort((nth, g, order[g]))[: max(0, len(g) - int(max(1, np.floor(least + 1e-9))) + 1) + MORE]
                ids.append(np.full(len(rare), i))
                keys.append(g[rare] * _RUN + nth[rare])
                n_.append(np.full(len(rare), n))
                k_.append(np.full(len(rare), k))
                once = np.repeat(np.diff(np.append(start, len(g))) == 1, np.diff(np.append(start, len(g))))
                at_.append(np.where(once, place[run_of], -1)[rare])
            if order is None:
                found, count = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count)], ["gram", "df"])
            elif ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in ((ids, np.int64), (n_, np.int32), (k_, np.int32), (keys, np.int64), (at_, np.int32))], ["id", "n", "words", "key", "at"])

    return run


def _short_words(words: Column, n: Column, share: float) -> Column:
    """Whether a text's words are so short that its grams of three guarantee nothing."""
    return _least_grams(n, n * (share / (2 - share)), share, 3, words) < 1


def _gram_pairs(forms: DataFrame, lines: DataFrame, share: float, by_word: bool, size: int = 3) -> DataFrame:
    """(f, l): ids of forms and lines (id, text) whose rarest grams agree as they must if matching
    characters are ``share`` of both.

    Grams are ordered by the number of lines' grams like them: there are at most 37 to the power of
    ``size``, so their order is broadcast.  Rare grams come first, so a text sends a part of its grams,
    and each meets few lines; lengths, the number of grams that agree and, for texts in one order, the
    places of a gram bound what is left."""
    counted = lines.mapInArrow(_gram_rows(share, size, by_word), "gram bigint, df bigint").groupBy("gram").agg(F.sum("df").alias("df"))
    df = np.zeros(len(_CHARS) ** size, np.int64)
    for r in counted.collect():  # 50,653 grams at most
        df[r["gram"]] = r["df"]
    order = np.argsort(np.argsort(df, kind="stable"), kind="stable")
    shape = "id bigint, n int, words int, key bigint, at int"
    a = forms.mapInArrow(_gram_rows(share, size, by_word, order), shape)
    b = lines.mapInArrow(_gram_rows(share, size, by_word, order), shape).select(F.col("id").alias("l"), F.col("n").alias("m"), F.col("words").alias("v"), "key", F.col("at").alias("to"))
    n, m = F.col("n"), F.col("m")
    fits = (2 * F.least(n, m) >= share * (n + m) - 1e-6)
    if not by_word:
        # A gram that both have once has hardly moved.
        fits &= (F.col("at") < 0) | (F.col("to") < 0) | (F.abs(F.col("at") - F.col("to")) <= (1 - share) * (n + m) + 1e-6)
    met = a.join(b, "key").where(fits).groupBy(F.col("id").alias("f"), "l").agg(F.count("*").alias("agree"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("words").alias("w"), F.first("v").alias("v"))
    least = F.greatest(_least_grams(n, m, share, size, F.col("w")), _least_grams(m, n, share, size, F.col("v"))) if by_word else _least_grams(n, m, share, size)
    return met.where(F.col("agree") >= F.greatest(F.lit(1), F.least(F.lit(1 + MORE), F.floor(least + 1e-6)))).select("f", "l")


def _texts_of(pairs: DataFrame, forms: DataFrame, lines: DataFrame) -> DataFrame:
    return pairs.join(forms.select(F.col("id").alias("f"), "_c"), "f").join(lines.select(F.col("id").alias("l"), "canon"), "l").select("_c", "canon")


def _sequence_pairs(forms: DataFrame, known: DataFrame, share: float) -> DataFrame:
    """Pairs of sequence-matcher ratio ``share`` or more, and others: grams of three that agree in
    number and place."""
    a, b = forms.select(F.xxhash64("_c").alias("id"), "_c"), known.select(F.xxhash64("canon").alias("id"), "canon")
    met = _gram_pairs(a.select("id", "_c"), b.select("id", "canon"), share, False)
    return _texts_of(met, a, b).where(_within(F.col("_c"), F.col("canon"), share)).distinct()


def _rare_words(rows: DataFrame, df: DataFrame, share: float) -> DataFrame:
    """(id, word): each text's rarest words, so many that the others are too little to be all that it
    shares with a text that holds nearly all of it."""
    each = rows.select("id", F.explode("w").alias("word")).join(df, "word", "left")
    sorted_ = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("s"))  # the words of one text
    weight = lambda s: F.aggregate(s, F.lit(0), lambda t, x: t + F.length(x["word"]) + 1)
    most = (weight(F.col("s")) - 1) * (share / (2 - share)) + 1 - 1e-6
    # A word is kept while it and all commoner ones could be all that is shared.
    step = F.aggregate("s", F.struct(weight(F.col("s")).cast("double").alias("left"), F.array().cast("array<string>").alias("kept")), lambda t, x: F.struct((t["left"] - F.length(x["word"]) - 1).alias("left"), F.when(t["left"] >= F.col("most"), F.concat(t["kept"], F.array(x["word"]))).otherwise(t["kept"]).alias("kept")))
    return sorted_.withColumn("most", most).select("id", F.explode(step["kept"]).alias("word"))


def _token_pairs(forms: DataFrame, known: DataFrame, share: float) -> DataFrame:
    """Pairs of token-set likeness ``share`` or more, and others: those whose shared words are nearly
    all of one side, met by that side's rarest words, and those whose words are alike as a whole, met
    by grams within words."""
    a = stored(forms.select(F.xxhash64("_c").alias("id"), "_c", F.array_distinct(F.split("_c", " ")).alias("w")), "forms")
    b = stored(known.select(F.xxhash64("canon").alias("id"), "canon", F.array_distinct(F.split("canon", " ")).alias("w")), "lines")
    df = stored(b.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "df")
    every = lambda rows, to: rows.select(F.col("id").alias(to), F.explode("w").alias("word"))
    one = _rare_words(a, df, share).withColumnRenamed("id", "f").join(every(b, "l"), "word").select("f", "l")
    two = _rare_words(b, df, share).withColumnRenamed("id", "l").join(every(a, "f"), "word").select("f", "l")
    length = lambda w: F.aggregate(w, F.lit(-1), lambda t, x: t + F.length(x) + 1)
    both = F.array_intersect("x", "y")
    met = one.union(two).distinct().join(a.select(F.col("id").alias("f"), "_c", F.col("w").alias("x")), "f").join(b.select(F.col("id").alias("l"), "canon", F.col("w").alias("y")), "l")
    part = met.withColumn("both", length(both)).where(2 * F.col("both") >= (share - 1e-9) * (F.col("both") + F.least(length("x"), length("y")))).select("_c", "canon")
    text = lambda rows: rows.select("id", F.array_join("w", " ").alias("text"))
    short = lambda rows: rows.where(_short_words(F.size("w"), length("w"), share))
    alike = _gram_pairs(text(a), text(b), share, True).union(_gram_pairs(text(short(a)), text(short(b)), share, True, 2)).distinct()
    shared = F.array_sort(F.array_intersect("x", "y"))
    side = lambda own, other: F.array_join(F.concat(shared, F.array_sort(F.array_except(own, other))), " ")
    whole = alike.join(a.select(F.col("id").alias("f"), "_c", F.col("w").alias("x")), "f").join(b.select(F.col("id").alias("l"), "canon", F.col("w").alias("y")), "l")
    whole = whole.where(_within(side("x", "y"), side("y", "x"), share)).select("_c", "canon")
    return part.union(whole).distinct()


def candidates(forms: DataFrame, known: DataFrame, score=levenshtein_score, threshold: float = THRESHOLD) -> DataFrame:
    """(_c, canon): pairs of forms (_c) and lines (canon) that are scored, all of ``threshold`` or more
    among them."""
    return {sequence_score: _sequence_pairs, token_set_score: _token_pairs}.get(score, _piece_pairs)(forms, known, threshold / 100)


#: Forms, and characters of them, that are broadcast; more meet the lines in joins.
FEW, FEW_CHARS = 20_000, 4_000_000
#: Pairs of a line and a form whose bounds are held at once; bins of hashed pairs of characters.
_CELLS, _BINS = 1 << 19, 256


def _distance(a: str, b: str) -> int:
    """Levenshtein distance, by a bit for each character of ``a`` (not empty)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, far = whole, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = eq | down
        eq |= ((eq & up) + up) ^ up
        more, less = down | ~(eq | up) & whole, up & eq
        far += bool(more & top) - bool(less & top)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(x | more)) & whole, more & x & whole
    return far


def _levenshtein(a: str, b: str) -> float:
    return 100.0 * (1 - _distance(a, b) / max(len(a), len(b)))


def _sequence(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio() * 100


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, hashed pairs of characters, length) of texts, as counts; pairs are those of a text
    between two blanks, so the order of words doesn't matter to them."""
    n = np.array([len(t) for t in texts], np.int64)
    if not texts:
        return np.zeros((0, len(_CHARS)), np.int16), np.zeros((0, _BINS), np.int16), n
    c = _PLACE[np.frombuffer((" " + " ".join(texts) + " ").encode(), np.uint8)]
    row = np.append(np.repeat(np.arange(len(texts)), n + 1), len(texts) - 1)  # each text with the blank before it
    kind = np.int16 if n.max() < 1 << 14 else np.int32
    one = np.bincount(row * len(_CHARS) + c, minlength=len(texts) * len(_CHARS)).reshape(len(texts), -1)
    one[:, 0] -= 1 + (np.arange(len(texts)) == len(texts) - 1)
    pair = (c[:-1] * len(_CHARS) + c[1:]) % _BINS
    two = np.bincount(row[:-1] * _BINS + pair, minlength=len(texts) * _BINS).reshape(len(texts), -1)
    return one.astype(kind), two.astype(kind), n


class _Forms:
    """Forms that are broadcast, shortest first, and the bounds and scores of lines against them.

    What doesn't match between a form of n and a line of m characters is at most (1 - share) (n + m)
    characters, so their counts of characters, and of pairs of characters, agree in a least number."""

    def __init__(self, forms: list[str], score: str, threshold: float):
        self.texts = sorted(forms, key=lambda f: (len(f), f))
        self.place = {f: i for i, f in enumerate(self.texts)}
        self.kind, self.threshold, self.share = score, threshold, threshold / 100
        self.score = {"levenshtein": _levenshtein, "sequence": _sequence, "token_set": _token_set}[score]
        self.words = None
        if score == "token_set":
            sets = [list(dict.fromkeys(f.split())) for f in self.texts]
            self.bag_texts = [" ".join(x) for x in sets]
            by_length = sorted(range(len(sets)), key=lambda i: len(self.bag_texts[i]))
            self.texts, sets, self.bag_texts = ([x[i] for i in by_length] for x in (self.texts, sets, self.bag_texts))
            self.place = {f: i for i, f in enumerate(self.texts)}
            self.words = {w: i for i, w in enumerate(sorted({w for x in sets for w in x}))}
            pairs = np.array(sorted((self.words[w], i) for i, x in enumerate(sets) for w in x), np.int64).reshape(-1, 2)
            self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1))
            self.holds, self.size = pairs[:, 1], np.array([len(w) + 1 for w in sorted(self.words)], np.int64)
        else:
            self.bag_texts = self.texts
        self.one, self.two, self.n = _bags(self.bag_texts)

    def _alike(self, one, two, m):
        """(line, form): pairs of lines of about one length that may be alike as a whole."""
        low, high = (self.share, 1 / self.share) if self.kind == "levenshtein" else (self.share / (2 - self.share), (2 - self.share) / self.share)
        a, b = np.searchsorted(self.n, m.min() * low - 1e-6), np.searchsorted(self.n, m.max() * high + 1e-6, "right")
        if a >= b:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n, both = self.n[a:b], np.zeros((len(m), b - a), np.promote_types(one.dtype, self.one.dtype))
        for c in range(one.shape[1]):
            x, y = one[:, c], self.one[a:b, c]
            if x.any() and y.any():
                both += np.minimum(x[:, None], y[None])
        longest, total = np.maximum(m[:, None], n), m[:, None] + n
        need = self.share * longest if self.kind == "levenshtein" else self.share * total / 2
        line, form = np.nonzero(both >= need - 1e-6)
        form += a
        n, m = self.n[form], m[line]
        if self.kind == "levenshtein":  # an edit ends two pairs of the longer side
            least = np.maximum(n, m) + 1 - 2 * np.floor((1 - self.share) * np.maximum(n, m) + 1e-6)
        else:  # a deletion ends two and makes one; an insertion likewise
            least = (n + m) / 2 + 1 - 1.5 * (1 - self.share) * (n + m)
        keep = np.zeros(len(line), bool)
        for at in range(0, len(line), 4096):
            s = slice(at, at + 4096)
            keep[s] = np.minimum(two[line[s]], self.two[form[s]]).sum(axis=1) >= least[s] - 1e-6
        return line[keep], form[keep]

    def _parts(self, sets, m, best):
        """(line, form, score): lines and forms whose shared words are nearly all of one side."""
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        word = np.array([i for x in sets for i in x], np.int64)
        count = self.first[word + 1] - self.first[word]
        at = np.repeat(self.first[word] - np.cumsum(count) + count, count) + np.arange(count.sum())
        cells = np.repeat(row, count) * len(self.n) + self.holds[at]
        both = np.bincount(cells, np.repeat(self.size[word], count), len(sets) * len(self.n)).reshape(len(sets), -1) - 1
        less = np.minimum(m[:, None], self.n)
        line, form = np.nonzero(both * (2 - self.share) >= self.share * less - 1e-6)
        b = both[line, form]
        score = 200.0 * b / (b + less[line, form])
        good = (score >= self.threshold) & (score >= best[form])
        return line[good], form[good], score[good]

    def best(self, texts: list[str], order: np.ndarray):
        """(form, line, score) of the best of these lines for each form: the highest score, the least
        ``order``, all that tie; equal texts come before all others."""
        found, best = [], np.zeros(len(self.texts))
        equal = [(self.place[t], i, np.inf) for i, t in enumerate(texts) if t in self.place]
        bag = texts if self.words is None else [" ".join(dict.fromkeys(t.split())) for t in texts]
        size = np.array([len(t) for t in bag], np.int64)
        by_length = np.argsort(size, kind="stable")
        step = max(1, _CELLS // max(1, len(self.texts)))
        for at in range(0, len(texts), step):
            rows = by_length[at : at + step]
            if self.words is not None:
                sets = [[j for w in bag[i].split() if (j := self.words.get(w)) is not None] for i in rows]
                line, form, score = self._parts(sets, size[rows], best)
                np.maximum.at(best, form, score)
                found.append((form, rows[line], score))
            one, two, m = _bags([bag[i] for i in rows])
            pairs = []
            for i, j in zip(*(x.tolist() for x in self._alike(one, two, m))):
                a, b = self.texts[j], texts[rows[i]]
                # Words that are all of one side were scored; matching blocks are a common subsequence,
                # whose length costs far less.
                if best[j] == 100.0 and self.words is not None or self.kind == "sequence" and 2 * _common(a, b) < self.share * (len(a) + len(b)) - 1e-6:
                    continue
                if (score := self.score(a, b)) >= self.threshold:
                    pairs.append((j, rows[i], score))
            for f, _, s in pairs:
                best[f] = max(best[f], s)
            if pairs:
                found.append(tuple(np.array(x) for x in zip(*pairs)))
        if equal:
            found.append(tuple(np.array(x) for x in zip(*equal)))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        form, line, score = (np.concatenate([x[i] for x in found]) for i in range(3))
        by = np.lexsort((order[line], -score, form))
        form, line, score = form[by], line[by], score[by]
        start = np.append(True, form[1:] != form[:-1]) if len(form) else np.zeros(0, bool)
        top = np.maximum.accumulate(np.where(start, np.arange(len(form)), 0))
        ties = (score == score[top]) & (order[line] == order[line[top]])
        return form[ties], line[ties], score[ties]


def _scanned(forms: list[str], known: DataFrame, score: str, threshold: float) -> DataFrame:
    """(_c, exact, score, n, text) of the best line for each of a bounded number of forms.

    The forms are broadcast and each batch of lines sends on its best ones alone, so that lines need no
    shuffle, however many they are."""
    spread = known.sparkSession.sparkContext.broadcast(_Forms(forms, score, threshold))

    def run(batches):
        f = spread.value
        for batch in batches:
            canon, order = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            form, line, score = f.best(canon, order) if canon else ([], [], np.zeros(0))
            line = pa.array(line, pa.int64())
            exact = np.isinf(score)
            yield pa.RecordBatch.from_arrays([pa.array([f.texts[i] for i in form], pa.string()), pa.array(exact), pa.array(np.where(exact, 100.0, score)), *(batch.column(i).take(line) for i in (1, 2, 0))], ["_c", "exact", "score", "n", "text", "canon"])

    rows = known.select("canon", F.col("n").cast("bigint").alias("n"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "_c string, exact boolean, score double, n bigint, text string, canon string")
    first = found.groupBy("_c", "exact", "score", "n", "canon").agg(F.min("text").alias("text"))  # of equal lines
    best = first.groupBy("_c").agg(F.max(F.struct("exact", "score", (-F.col("n")).alias("m"), "text")).alias("b"))
    return best.select("_c", "b.exact", "b.score", (-F.col("b.m")).cast(known.schema["n"].dataType).alias("n"), "b.text")


def best_matches(asked: DataFrame, known: DataFrame, score=levenshtein_score, threshold: float = THRESHOLD) -> DataFrame:
    """asked (…, quote) with score, n, text and exact of the best known line (canon, n, text); lines
    may repeat a canonical form, the first counts.

    Up to ``FEW`` different forms are broadcast, and one scan of the lines finds the best of each.  More
    meet the lines in joins: equal canonical forms by an equi-join; for what is left, each scorer has
    candidate pairs of its own that hold all of ``threshold`` or more, and only such pairs are scored.
    A scorer that isn't of this module sees the Levenshtein pairs.  Quotes without a line of
    ``threshold`` or more have a null line and score 0."""
    rows = stored(asked.withColumn("_c", T.canon("quote")), "asked")
    forms = rows.select("_c").where("_c <> ''").distinct()
    name = {levenshtein_score: "levenshtein", sequence_score: "sequence", token_set_score: "token_set"}.get(score)
    few, chars = forms.agg(F.count("*"), F.coalesce(F.sum(F.length("_c")), F.lit(0))).first()
    if name is not None and few <= FEW and chars <= FEW_CHARS:
        best = stored(_scanned(forms.toArrow().column("_c").to_pylist(), known, name, threshold), "best")  # of bounded size
        found = rows.join(best, "_c", "left").withColumns({"exact": F.coalesce("exact", F.lit(False)), "score": F.coalesce("score", F.lit(0.0))})
        return found.select(*asked.columns, "n", "text", "score", "exact")
    known = stored(_first(known), "known")
    exact = rows.join(known.withColumnRenamed("canon", "_k"), F.col("_c") == F.col("_k"), "left").drop("_k")
    done = exact.where("n is not null").withColumns({"score": F.lit(100.0), "exact": F.lit(True)})
    open_ = exact.where("n is null").drop("n", "text")
    forms = open_.select("_c").where("_c <> ''").distinct()
    # Pairs are few bytes and much work: adaptive execution would leave them to a task or two.
    pairs = candidates(forms, known, score, threshold).repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scored = pairs.withColumn("score", score(F.col("_c"), F.col("canon"))).where(F.col("score") >= threshold).join(known, "canon")
    best = scored.groupBy("_c").agg(F.max(F.struct("score", (-F.col("n")).alias("m"), "text")).alias("b")).select("_c", "b.score", (-F.col("b.m")).alias("n"), "b.text")
    rest = open_.join(best, "_c", "left").withColumn("exact", F.lit(False)).withColumn("score", F.coalesce("score", F.lit(0.0)))
    return done.unionByName(rest).drop("_c")


#: Lines of a work that every unmatched quotation is compared with.
MOST_LINES = 20_000


def with_nearest(checks: DataFrame, known: DataFrame) -> DataFrame:
    """Checks where a quotation without a match gets its nearest line (canon, n, text) and that line's
    likeness, however low; an empty quotation stays without one.

    For the lines of one work, of which there are at most ``MOST_LINES``: they are one broadcast row,
    and each unmatched quotation is compared with all of them."""
    if known.count() > MOST_LINES:
        raise ValueError(f"more than {MOST_LINES} lines are not compared with every quotation")
    lines = known.agg(F.collect_list(F.struct("canon", "n", "text")).alias("_lines"))  # one row of bounded size
    best = F.array_max(F.transform("_lines", lambda x: F.struct(levenshtein_score(F.col("_c"), x["canon"]).alias("score"), (-x["n"]).alias("m"), x["text"].alias("text"))))
    open_ = checks.where("n is null").withColumn("_c", T.canon("quote")).crossJoin(F.broadcast(lines)).withColumn("_b", F.when(F.col("_c") != "", best))
    filled = open_.withColumns({"score": F.coalesce("_b.score", F.lit(0.0)), "n": (-F.col("_b.m")), "text": F.col("_b.text")})
    return checks.where("n is not null").unionByName(filled.select(*checks.columns))


def verified(checks: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, checked, accepted, non_exact, coverage) of checks (key, score, exact)."""
    good = F.col("score") >= threshold
    out = checks.groupBy(key).agg(F.count("*").alias("checked"), F.count_if(good).alias("accepted"), F.count_if(good & ~F.col("exact")).alias("non_exact"))
    return out.withColumn("coverage", F.round(F.col("accepted") / F.greatest(F.lit(1), F.col("checked")), 3))


_SPANS = re.compile(_QUOTE)


def _key(text: str) -> str:
    import unicodedata

    base = "".join(c for c in unicodedata.normalize("NFD", text.strip().lower()) if not unicodedata.combining(c)).replace("đ", "d")
    return " ".join(re.sub(r"[^0-9a-z\s]", " ", base).split())


def corrected(text: str | None, fixes: list[tuple[str, str]] | None) -> str:
    """Quotations replaced by ``fixes`` (old, new) in order of appearance: the next fix is used, and
    passed, only where its old text stands.  All quotation marks become straight."""
    text, queue = text or "", list(fixes or [])
    if not queue:
        return text

    def put(m: re.Match) -> str:
        inner = m.group(1) if m.group(1) is not None else m.group(2)
        if queue and _key(inner) == _key(queue[0][0]):
            inner = queue.pop(0)[1]
        return f'"{inner}"'

    return _SPANS.sub(put, text)


def apply_fixes(answers: DataFrame, fixes: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``answers`` with corrected texts; fixes (key, place, old, new)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([corrected(t, [(f["old"], f["new"]) for f in (x if x is not None else [])]) for t, x in zip(texts, lists)])

    gathered = fixes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "old", "new"))).alias("_fixes"))
    return answers.join(gathered, key, "left").withColumn(text, run(text, "_fixes")).drop("_fixes")


def correct(answers: DataFrame, known: DataFrame, key: str, text: str = "text", score=levenshtein_score) -> DataFrame:
    """Answers whose quotations are replaced by the lines that they are nearly like."""
    checks = best_matches(quotes(answers, key, text), known, score)
    fixes = checks.where((F.col("score") >= THRESHOLD) & ~F.col("exact")).select(key, "place", F.col("quote").alias("old"), F.col("text").alias("new"))
    return apply_fixes(answers, fixes, key, text)


def verify_and_correct(answers: DataFrame, known: DataFrame, key: str, text: str = "text", score=levenshtein_score) -> tuple[DataFrame, DataFrame]:
    """Corrected answers, and their verification after the correction."""
    fixed = correct(answers, known, key, text, score)
    return fixed, verified(best_matches(quotes(fixed, key, text), known, score), key)


def with_warning(answers: DataFrame, bad: str, poem_only: str, text: str = "text", warning: str = "Some quotations could not be matched with the source; please check them.") -> DataFrame:
    """Appends a warning where only verse was asked for and two quotations or more are bad."""
    return answers.withColumn(text, F.when(F.col(poem_only) & (F.col(bad) >= 2), F.concat(F.col(text), F.lit("\n\n" + warning))).otherwise(F.col(text)))
