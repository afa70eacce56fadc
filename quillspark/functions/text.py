"""Scalar text functions as Column expressions.

All stay in the JVM but NFC normalisation, which Spark has no function for: :func:`nfc` is an
Arrow UDF and only the functions named for it use it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NBSP = " "
#: Unicode-aware, case-insensitive matching in Java regular expressions.
FLAGS = "(?iuU)"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rx(text: Column, pattern: str, put: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(put))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkd_base(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return text.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@lru_cache
def _folds() -> tuple[str, str]:
    """Characters that decompose into one base character and marks, and their bases: built from
    the Unicode database, all planes up to U+FFFF."""
    pairs = []
    for k in range(0xC0, 0xFFFF):
        c = chr(k)
        if 0xAC00 <= k <= 0xD7A3 or 0xD800 <= k <= 0xDFFF:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def strip_accents(text: Column | str) -> Column:
    """Base characters without marks; letters that don't decompose, as the barred d, stay."""
    return rx(F.translate(col(text), *_folds()), r"\p{Mn}", "")


@lru_cache
def _ascii_folds() -> tuple[str, str]:
    """Of :func:`_folds` the lower-case letters and digits with an ASCII base, and the barred d."""
    pairs = [(c, b) for c, b in zip(*_folds()) if b.isascii() and b.isalnum() and not b.isupper()]
    return "".join(p[0] for p in pairs) + "đ", "".join(p[1] for p in pairs) + "d"


def plain(text: str) -> str:
    """:func:`strip_accents` of a constant."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def strip_diacritics(text: Column | str) -> Column:
    """:func:`strip_accents`, and the barred d as d."""
    return F.translate(strip_accents(text), "đĐ", "dD")


def squeeze(text: Column | str) -> Column:
    """Single spaces for Unicode white space, none at the ends; null is empty."""
    return F.trim(rx(F.coalesce(col(text), F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def canon(text: Column | str) -> Column:
    """Lower-cased ASCII letters and digits between single spaces, without diacritics.

    Whatever has no ASCII base becomes a space, so a short table of folds does."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.trim(rx(rx(F.translate(low, *_ascii_folds()), r"\p{Mn}+", ""), r"[^0-9a-z]+", " "))


def question_key(text: Column | str) -> Column:
    """Lower-cased and squeezed, as for FAQ and cache look-ups."""
    return F.lower(squeeze(text))


def cache_key(text: Column | str, long_answer: Column, intent: Column | str) -> Column:
    return F.concat(F.lower(strip_ends(F.coalesce(col(text), F.lit("")))), F.when(long_answer, F.lit("|la=1|intent=")).otherwise(F.lit("|la=0|intent=")), col(intent))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of word characters and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"((?U)[\w'À-ỹ]+)"), F.lit(1))


def terms(text: Column | str) -> Column:
    """Index terms: letters, digits, underscore and apostrophe, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}_']+"), lambda t: t != "")


def word_count(text: Column | str) -> Column:
    return let(squeeze(text), lambda clean: F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " "))))


def strip_trailing_blanks(text: Column) -> Column:
    return rx(text, r"[ \t]+\n", "\n")


def limit_newlines(text: Column) -> Column:
    return rx(text, r"\n{3,}", "\n\n")


def strip_ends(text: Column) -> Column:
    return rx(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_markdown(text: Column | str) -> Column:
    return strip_ends(strip_trailing_blanks(limit_newlines(nfc(col(text)))))


def normalise_prose(text: Column | str, *, line_ends: bool = False) -> Column:
    """NFC, plain spaces, no blanks at line ends, at most one blank line; optionally CRLF to LF."""
    out = F.replace(nfc(col(text)), F.lit(NBSP), F.lit(" "))
    if line_ends:
        out = rx(out, r"\r\n?", "\n")
    return strip_ends(limit_newlines(strip_trailing_blanks(out)))


def normalise_poem(text: Column | str) -> Column:
    """Line structure stays; blanks at line ends go."""
    return strip_ends(rx(rx(F.replace(nfc(col(text)), F.lit(NBSP), F.lit(" ")), r"\r\n?", "\n"), r"(?m)[ \t]+$", ""))


def strip_links(markdown: Column | str) -> Column:
    return rx(col(markdown), r"\[(.*?)\]\((.*?)\)", "$1")


def sha1_head(text: Column | str, digits: int) -> Column:
    return F.substring(F.sha1(col(text).cast("binary")), 1, digits)


def url_hash(url: Column | str) -> Column:
    return sha1_head(url, 8)


def content_id(text: Column | str) -> Column:
    return sha1_head(text, 12)


def slug(text: Column | str) -> Column:
    """A file-name form of the text, 120 characters at most; ``source`` for nothing."""
    plain = rx(nfkd_base(col(text)), r"(?U)[^a-zA-Z0-9\-_.\s]", "")
    out = F.substring(F.lower(rx(strip_ends(plain), r"(?U)\s+", "-")), 1, 120)
    return F.when(out == "", F.lit("source")).otherwise(out)


def _plain_slug(text: Column) -> Column:
    """:func:`slug` for text that is ASCII already or loses what isn't."""
    out = F.substring(F.lower(rx(strip_ends(rx(strip_accents(text), r"[^a-zA-Z0-9\-_.\s]", "")), r"\s+", "-")), 1, 120)
    return F.when(out == "", F.lit("source")).otherwise(out)


def url_basename(url: Column | str) -> Column:
    """Host without ``www.``, path and query of a URL joined into a file name."""
    u = col(url)
    host = F.replace(F.coalesce(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")), F.lit("www."), F.lit(""))
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    path = F.replace(rx(path, r"^/+|/+$", ""), F.lit("/"), F.lit("-"))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit(" ")))
    named = F.transform(pairs, lambda p: F.concat(_plain_slug(F.coalesce(decode(F.substring_index(p, "=", 1)), F.lit(""))), F.lit("-"), _plain_slug(F.coalesce(decode(F.when(F.contains(p, F.lit("=")), F.regexp_extract(p, "=(.*)$", 1)).otherwise("")), F.lit("")))))
    query_part = F.substring(F.array_join(named, "-"), 1, 120)
    parts = F.filter(F.array(_plain_slug(host), F.when(path != "", _plain_slug(path)).otherwise(""), query_part), lambda x: x != "")
    out = F.array_join(parts, "-")
    return F.when(out == "", F.lit("source")).otherwise(out)


def quality_bad(text: Column | str) -> Column:
    """Empty, under 40 trimmed characters, or over 1 % replacement characters."""
    t = F.coalesce(col(text), F.lit(""))
    lost = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    return (F.length(strip_ends(t)) < 40) | (lost > F.length(t) * 0.01)


def strip_verse_number(text: Column | str) -> Column:
    return strip_ends(rx(col(text), r"(?U)^\s*\d{1,4}\s*[:.)]\s*", ""))


def clean_line(text: Column | str) -> Column:
    return squeeze(F.replace(col(text), F.lit(NBSP), F.lit(" ")))


def looks_like_verse(text: Column | str) -> Column:
    return F.coalesce(col(text).rlike(r"[A-Za-zÀ-ỹ]"), F.lit(False))


def source_label(source: Column | str) -> Column:
    """``src:L1-4`` for lines of a poem, ``src:10-99`` for characters, ``src#chunk3`` for chunks, else
    ``src``; from the columns type, line_start, line_end, char_start, char_end and chunk_index."""
    s = F.coalesce(F.when(col(source) != "", col(source)), F.lit("unknown"))
    lines = (F.col("type") == "poem") & (F.col("line_start") > 0) & (F.col("line_end") > 0)
    return F.coalesce(
        F.when(lines, F.concat(s, F.lit(":L"), F.col("line_start"), F.lit("-"), F.col("line_end"))), F.concat(s, F.lit(":"), F.col("char_start"), F.lit("-"), F.col("char_end")),
        F.concat(s, F.lit("#chunk"), F.col("chunk_index")), s,
    )


def cite_tag(source: Column | str) -> Column:
    """The label in brackets."""
    return F.concat(F.lit("["), source_label(source), F.lit("]"))


def finish_answer(text: Column | str) -> Column:
    """Without lines that name sources, blank runs collapsed."""
    lines = F.filter(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x: ~x.rlike(r"(?iuU)^\s*(source|sources|nguồn)\s*:"))
    return strip_ends(limit_newlines(F.array_join(lines, "\n")))
