"""Prompts from questions, contexts and history; generation behind a provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

SHORT_HISTORY, FULL_HISTORY = 4, 8
#: Our own wording of the tasks.
TASKS = {
    "rag_short": "Answer the question from the numbered excerpts only. Cite excerpts by their tags. Say so if they do not suffice.",
    "rag_long": "Write a structured essay on the question from the numbered excerpts only: thesis, arguments with cited evidence, conclusion. Say so if they do not suffice.",
    "chitchat": "Reply to this remark briefly and kindly.",
    "generic_short": "Answer briefly.",
    "generic_medium": "Answer in a few paragraphs.",
    "generic_deep": "Answer at length: background, details, limits.",
    "disambiguation": "Ask which of these readings is meant.",
    "compare": "Compare these two lines: words, images, sound, sense. Quote them exactly.",
    "review": "Review what the excerpts say about the question, with citations.",
    "claims": "List claims on the question, each with its evidence from the excerpts.",
    "counter": "Give arguments and counter-arguments on the question, each with an excerpt.",
    "quote_check": "Check every quotation in this text against the excerpts.",
    "outline": "Outline an answer with one excerpt or two under each point.",
    "argument": "Argue the question like a scholar: points with reasons, each quoting an excerpt exactly; then a conclusion.",
    "summary": "Sum up the excerpts on the question in their own order, without judgement.",
    "biography": "Tell the life asked about from the excerpts, with dates where they give them.",
    "device": "Explain the device asked about: what it is, where the excerpts show it, what it does there.",
}


def excerpts_allowed(task: str, n: int | None = None) -> int:
    """How many excerpts a prompt takes; ``n`` counts citations, pairs or points, of
    which two pairs and three points are usual."""
    return {"review": max(n or 0, 12), "claims": 8, "counter": 3 * (2 if n is None else n), "outline": 2 * (3 if n is None else n)}.get(task, 12)


def history(turns: DataFrame, n: int, *, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, history): each conversation's last ``n`` turns as blocks, oldest first; every role but
    user counts as the assistant's."""
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc(role), F.desc(text))
    kept = turns.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n)
    block = F.concat(F.when(F.col(role) == "user", "[USER]\n").otherwise("[ASSISTANT]\n"), F.coalesce(F.col(text), F.lit("")))
    parts = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("o"), block.alias("b")))).alias("p"))
    return parts.select(key, F.array_join(F.transform("p", lambda x: x.b), "\n\n").alias("history"))


def excerpts(contexts: DataFrame, most: int = 12, *, text: str = "text", label: str = "label") -> DataFrame:
    """(query_id, excerpts): texts that aren't empty among the first ``most`` ranks, each under its
    rank and tag."""
    body = T.strip_ends(F.coalesce(F.col(text), F.lit("")))
    block = F.concat(F.lit("("), F.col("rank").cast("string"), F.lit(") ["), F.col(label), F.lit("]\n"), body)
    kept = contexts.where((F.col("rank") <= most) & (body != ""))
    parts = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("p"))
    return parts.select("query_id", F.array_join(F.transform("p", lambda x: x.b), "\n\n").alias("excerpts"))


def prompt(task: str, question: Column, excerpts_: Column | None = None, history_: Column | None = None) -> Column:
    """Task, history, question and excerpts in sections; empty sections are left out."""

    def section(name: str, body: Column | None) -> Column:
        return F.lit(None).cast("string") if body is None else F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), body))

    return F.array_join(F.array_compact(F.array(F.lit(TASKS[task]), section("History", history_), section("Question", question), section("Excerpts", excerpts_))), "\n\n")


def rag_prompts(questions: DataFrame, contexts: DataFrame, *, long_answer: bool = False, histories: DataFrame | None = None, query: str = "query") -> DataFrame:
    """(query_id, prompt) for a batch of questions; a question without contexts still gets one."""
    task = "rag_long" if long_answer else "rag_short"
    got = questions.join(excerpts(contexts, excerpts_allowed(task)), "query_id", "left")
    got = got.join(histories, "query_id", "left") if histories is not None else got.withColumn("history", F.lit(""))
    return got.select("query_id", prompt(task, F.col(query), F.col("excerpts"), F.col("history")).alias("prompt"))


def task_prompts(questions: DataFrame, task: str, contexts: DataFrame | None = None, *, n: int | None = None, query: str = "query", histories: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt) of any task for a batch: small talk, the generic depths, disambiguation and
    comparison without excerpts; review, claims, counter-arguments, quotation check, outline,
    argument, summary, biography and device with as many as :func:`excerpts_allowed` gives."""
    got = questions
    got = got.join(excerpts(contexts, excerpts_allowed(task, n)), "query_id", "left") if contexts is not None else got.withColumn("excerpts", F.lit(""))
    got = got.join(histories, "query_id", "left") if histories is not None else got.withColumn("history", F.lit(""))
    return got.select("query_id", prompt(task, F.col(query), F.col("excerpts"), F.col("history")).alias("prompt"))


def with_sources(answers: DataFrame, sources: DataFrame, *, visible: bool = True, text: str = "answer") -> DataFrame:
    """Answers with their sources' labels (query_id, label, first_rank) listed below, if they are to
    be seen; an answer without sources stays."""
    if not visible:
        return answers
    listed = sources.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_rank", "label"))), lambda x: F.concat(F.lit("- "), x.label)), "\n").alias("_listed"))
    joined = answers.join(listed, "query_id", "left")
    return joined.withColumn(text, F.when(F.col("_listed").isNotNull(), F.concat(F.col(text), F.lit("\n\nSources\n"), F.col("_listed"))).otherwise(F.col(text))).drop("_listed")


def extractive(texts: list[str]) -> list[str]:
    """The local default generator: the first excerpt's body."""
    return [t.partition("## Excerpts\n")[2].partition("]\n")[2].partition("\n\n")[0] for t in texts]


def _answers(call: Callable[[list[str]], list[str]], prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt: all at once, and one by one where that fails."""
    try:
        found = call(prompts)
        if len(found) != len(prompts):
            raise ValueError(f"{len(found)} answers to {len(prompts)} prompts")
        return [(x, None if x and x.strip() else "empty answer") for x in found]
    except Exception as e:
        return [(None, f"{type(e).__name__}: {e}"[:400])] if len(prompts) == 1 else [_answers(call, [p])[0] for p in prompts]


def generate(prompts: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]] = lambda: extractive, *, text: str = "prompt", batch: int = 32, options: dict | None = None) -> DataFrame:
    """``prompts`` with ``answer`` and ``error``: the generator is made once in each worker and takes
    ``batch`` prompts at a time, one at a time where that fails, and ``options`` as keywords if there
    are any; a failed or empty answer is an error, not a failed job."""

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = partial(make(), **options) if options else make()
        for part in parts:
            rows = []
            for at in range(0, len(part), batch):
                rows += _answers(call, part.iloc[at : at + batch].tolist())
            yield pd.DataFrame(rows, columns=["answer", "error"])

    return prompts.withColumn("_g", run(text)).withColumns({"answer": T.finish_answer("_g.answer"), "error": F.col("_g.error")}).drop("_g")


def map_reduce(contexts: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], *, text: str = "text") -> DataFrame:
    """(query_id, answer): a note on each context, then one answer from each query's notes in order."""
    notes = generate(contexts, make, text=text)
    joined = notes.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "answer"))).alias("n"))
    merged = joined.select("query_id", F.array_join(F.transform("n", lambda x: x.answer), "\n\n").alias("prompt"))
    return generate(merged, make).select("query_id", "answer", "error")


def sft_text(records: DataFrame) -> DataFrame:
    """Training records (system, instruction, context, output) as prompt and response."""
    body = F.concat_ws("\n\n", F.when(F.col("system") != "", F.col("system")), F.col("instruction"), F.when(F.col("context") != "", F.col("context")))
    return records.select("*", body.alias("prompt"), T.strip_ends(F.coalesce("output", F.lit(""))).alias("response"))
