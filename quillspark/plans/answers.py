"""Answers to a batch of questions by all paths: FAQ, cache, small talk, verse requests, retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import lines as L
from quillspark.operators import prompt, route, textindex, verify
from quillspark.operators.embed import Hashing, Provider
from quillspark.plans import retrieval
from quillspark.session import stored

NOT_READY = "The line table isn't ready."


def _verses(asked: DataFrame, lines: DataFrame, make) -> DataFrame:
    """(query_id, answer, error) of verse requests: lines as they stand for opening, range and single,
    a generated comparison of two lines, and a question back where no such line is there."""
    r = stored(asked.withColumn("r", route.verse_request("question")).select("query_id", "question", "r.*"), "verses")
    if not L.ready(lines):
        return r.select("query_id", F.lit(NOT_READY).alias("answer"), F.lit(None).cast("string").alias("error"))
    found = L.displayed(L.answers(r, lines))
    whole = r.join(found, "query_id", "left").withColumn("n", F.size(F.split("answer", "\n")))
    missing = F.col("answer").isNull() | ((F.col("kind") == "compare") & (F.col("n") < F.when(F.col("a") == F.col("b"), 1).otherwise(2)))
    plain = whole.where(~missing & (F.col("kind") != "compare")).select("query_id", "answer", F.lit(None).cast("string").alias("error"))
    compared = prompt.task_prompts(whole.where(~missing & (F.col("kind") == "compare")).withColumn("query", F.concat_ws("\n", "question", "answer")), "compare")
    unclear = prompt.task_prompts(whole.where(missing).withColumnRenamed("question", "query"), "disambiguation")
    made = prompt.generate(compared.unionByName(unclear), make).select("query_id", "answer", "error")
    return plain.unionByName(made)


def answer_all(
    questions: DataFrame, facts: DataFrame, cache: DataFrame, lines: DataFrame, docs: DataFrame, *, make: Callable[[], Callable[[list[str]], list[str]]] = lambda: prompt.extractive,
    embedder: Callable[[], Provider] = Hashing, k: int = 5, index: textindex.TextIndex | None = None,
) -> DataFrame:
    """questions (query_id, question, long_answer) to (query_id, path, answer, error), one row each.

    Paths are those of :func:`retrieval.dispatch`; list requests are answered as domain questions.
    Domain answers' quotations are checked against the lines, and answers to verse-only questions
    with two bad ones get a warning.  Every path is one plan over all its questions."""
    routed = stored(retrieval.dispatch(questions, facts, cache).join(questions.select("query_id", "long_answer"), "query_id"), "routed")
    none = F.lit(None).cast("string")
    ready = routed.where(F.col("path").isin("faq", "cache")).select("query_id", "answer", none.alias("error"))
    asked = lambda *paths: routed.where(F.col("path").isin(*paths)).withColumn("query", F.col("question"))
    talk = prompt.generate(prompt.task_prompts(asked("chitchat"), "chitchat"), make).select("query_id", "answer", "error")
    generic = prompt.generate(prompt.task_prompts(asked("generic"), "generic_short"), make).select("query_id", "answer", "error")
    verses = _verses(routed.where("path = 'poem'").select("query_id", "question"), lines, make)
    domain = asked("domain", "facts")
    found = retrieval.retrieve(domain.select("query_id", "query", "long_answer"), docs, k, embedder=embedder, long_answer="long_answer", index=index)
    said = stored(prompt.generate(found.prompts, make).select("query_id", "answer", "error"), "said").join(domain.select("query_id", "question"), "query_id")
    known = verify.choices(lines)
    checks = verify.verified(verify.best_matches(verify.quotes(said, "query_id", "answer"), known), "query_id")
    judged = said.join(checks.select("query_id", (F.col("checked") - F.col("accepted") + F.col("non_exact")).alias("bad")), "query_id", "left").withColumns({"bad": F.coalesce("bad", F.lit(0)), "verse": route.has_any("question", route.POEM_ONLY)})
    answered = verify.with_warning(judged, "bad", "verse", text="answer").select("query_id", "answer", "error")
    every = ready.unionByName(talk).unionByName(generic).unionByName(verses).unionByName(answered)
    return routed.select("query_id", "path").join(every, "query_id", "left")
