"""Routing of questions: columns over a batch, no per-question code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.patterns import first_found

# The grammar of verse requests, in order of precedence.
_OPENING = r"(?U)(?:trích\s*)?(\d+)\s*câu\s*đầu\b"
_COMPARE = r"(?U)so\s*sánh\s*câu\s*(\d+)\s*(?:với|vs|và)\s*câu\s*(\d+)"
_DASH = r"(?U)câu\s*(\d+)\s*[-–]\s*(\d+)"
_FROM_TO = r"(?U)từ\s*câu\s*(\d+)\s*đến\s*câu\s*(\d+)"
_SINGLE = r"(?U)(?:câu(?:\s*số)?)\s*(\d+)(?:\s*(?:là\s*gì|gì|đọc|cho|trích))?\b"
# What asks for a list, short talk, and triggers of close reading.
_LIST_PREFIXES = ("liệt kê:", "liet ke:", "bullet:", "tldr:", "tóm tắt:", "tom tat:")
_LIST_WORDS = (
    r"\bliệt\s*kê\b", r"\btóm\s*tắt\b", r"\btổng\s*hợp\b", r"\bdanh\s*sách\b", r"\bgạch\s*đầu\s*dòng\b", r"\bđiểm\s*chính\b", r"\bkey\s*takeaways?\b", r"\bbullet(s)?\b", r"\bnêu\s+(\d+)\s+ý\b", r"\b(\d+)\s*ý\s*chính\b",
)
_GREETINGS = ("hi", "hello", "xin chào", "chào", "chào bạn")
_QUESTION_ENDS = ("không?", "ko?")
_ARITHMETIC = r"(?U)^\s*\d+\s*[+\-*x]\s*\d+\s*=\s*\??\s*$"
POEM_ONLY = ("trích", "câu thơ", "nguyên văn", "dẫn", "lục bát", "nhịp", "vần", "điệp", "đối", "Lầu Ngưng Bích", "Đoạn trường")
CLOSE_READING = ("trữ tình ngoại đề", "điểm nhìn", "ẩn dụ", "nhịp điệu", "mapping", "bản đồ ý niệm", "close reading")
# How people introduce themselves.
_NAME = r"(?iuU)(?:tên\s*(?:của\s*tôi|mình)?\s*là|tôi\s*là|mình\s*là|tớ\s*là|em\s*là|anh\s*là|chị\s*là)\s+([A-Za-zÀ-ỹĐđ'’\-\s]{2,40})"


def _low(q: Column) -> Column:
    return F.lower(F.coalesce(q, F.lit("")))


def _number(q: Column, pattern: str, group: int) -> Column:
    return F.try_to_number(F.regexp_extract(q, pattern, group), F.lit("999999999999999999")).cast("bigint")


def verse_request(question: Column | str) -> Column:
    """struct(kind, a, b): opening(a), compare(a, b), range(a, b) or single(a); null for no verse."""
    q = _low(T.col(question))

    def is_(pattern: str, kind: str, two: bool) -> Column:
        return F.when(q.rlike(pattern), F.struct(F.lit(kind).alias("kind"), _number(q, pattern, 1).alias("a"), (_number(q, pattern, 2) if two else F.lit(None).cast("bigint")).alias("b")))

    return F.coalesce(is_(_OPENING, "opening", False), is_(_COMPARE, "compare", True), is_(_DASH, "range", True), is_(_FROM_TO, "range", True), is_(_SINGLE, "single", False))


def list_request(question: Column | str) -> Column:
    """How many items are asked for, 3 to 12 and 5 by default; null if none are."""
    q = T.strip_ends(_low(T.col(question)))
    asks = F.lit(False)
    for p in _LIST_PREFIXES:
        asks = asks | F.startswith(q, F.lit(p))
    for p in _LIST_WORDS:
        asks = asks | q.rlike("(?U)" + p)
    n = F.coalesce(F.when(q.rlike(r"(?U)\b\d{1,2}\b"), F.regexp_extract(q, r"(?U)\b(\d{1,2})\b", 1).cast("int")), F.lit(5))
    return F.when(asks, F.greatest(F.lit(3), F.least(n, F.lit(12))))


def intent(question: Column | str) -> Column:
    """chitchat, poem, facts, generic or domain."""
    q = T.strip_ends(_low(T.col(question)))
    short = q.isin(*_GREETINGS)
    for e in _QUESTION_ENDS:
        short = short | (F.endswith(q, F.lit(e)) & (F.length(q) <= 20))
    return F.when(q == "", "chitchat").when(verse_request(q).isNotNull(), "poem").when(list_request(q).isNotNull(), "facts").when(short, "chitchat").when(q.rlike(_ARITHMETIC), "generic").otherwise("domain")


def has_any(question: Column | str, triggers: tuple[str, ...]) -> Column:
    q = _low(T.col(question))
    out = F.lit(False)
    for t in triggers:
        out = out | F.contains(q, F.lit(t.lower()))
    return out


def faq_match(questions: DataFrame, facts: DataFrame, *, query_id: str = "query_id", question: str = "question") -> DataFrame:
    """(query_id, place, answer, sources) of the first fact, by ``place``, any of whose patterns the
    question contains.

    facts (place, patterns, answer, sources) of any number: an automaton of the patterns reads each
    question once.  A null or empty question contains only the empty pattern."""
    patterns = facts.select("place", F.explode("patterns").alias("p")).where("p is not null").select("place", T.question_key("p").alias("p"))
    q = questions.select(F.col(query_id).alias("id"), F.coalesce(T.question_key(question), F.lit("")).alias("text"))
    first = facts.groupBy("place").agg(F.min(F.struct("answer", "sources")).alias("f"))
    return first_found(q, patterns).join(first, "place").select(F.col("id").alias("query_id"), "place", "f.*")


def introduced_name(message: Column | str) -> Column:
    """The name in a self-introduction: up to three words, of more the last two, capitalised; null
    if there is none."""
    found = F.regexp_extract(F.coalesce(T.col(message), F.lit("")), _NAME, 1)
    words = F.filter(F.split(T.squeeze(found), " "), lambda w: w != "")
    return F.when(F.size(words) > 0, F.initcap(F.array_join(F.when(F.size(words) > 3, F.slice(words, -2, 2)).otherwise(words), " ")))


def profiles(messages: DataFrame, *, session: str = "session_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(session_id, name): the last name each session's messages give."""
    named = messages.withColumn("name", introduced_name(text)).where("name is not null")
    return named.groupBy(session).agg(F.max_by("name", order).alias("name"))


def rendered_profile(name: Column | str) -> Column:
    """A profile's line for prompts; null without a name."""
    return F.concat(F.lit("Name: "), T.col(name))
