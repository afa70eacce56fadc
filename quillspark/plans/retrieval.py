"""Retrieval of contexts for batches of questions: variants, hybrid search, relaxation, dedupe,
confidence gate, re-ranking, prompts.  Every step is a plan over all questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import top_k
from quillspark.operators import fuse, prompt, rerank, route, search, textindex
from quillspark.operators.embed import QUERY, Provider, with_vectors
from quillspark.session import stored


@dataclass
class Result:
    hits: DataFrame
    contexts: DataFrame
    prompts: DataFrame


def hybrid_search(queries: DataFrame, docs: DataFrame, k: int, *, where: Column | None = None, always: bool = False, index: textindex.TextIndex | None = None) -> DataFrame:
    """queries (query_id, query, vector) over docs (doc_id, text, vector, …): blank queries find
    nothing; both sides look max(k, 6) deep.  Words are looked up in the ``index`` of the same texts, if
    one is given; with a filter all texts that pass it are read, since it changes what words weigh."""
    k = top_k(k)
    asked = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    pool = docs if where is None else docs.where(where)
    deep = max(k, 6)
    v = search.vector_topk(asked, pool, deep)
    t = search.text_topk(asked, pool, deep) if index is None or where is not None else textindex.topk(asked, index, deep)
    return fuse.hybrid(v, t, k, always=always)


def _found(probe: DataFrame, docs: DataFrame, k: int, name: str, *, where: Column | None = None, relaxed: bool, index: textindex.TextIndex | None = None) -> DataFrame:
    """Hits of all probes (vid, query, vector, query_id, variant), written once."""
    asked = probe.select(F.col("vid").alias("query_id"), "query", "vector")
    hits = hybrid_search(asked, docs, k, where=where, index=index).withColumnRenamed("query_id", "vid")
    return stored(hits.join(probe.select("vid", "query_id", "variant"), "vid").drop("vid").withColumn("relaxed", F.lit(relaxed)), name)


def _counts(asked: DataFrame, strict: DataFrame, relaxed: DataFrame | None) -> DataFrame:
    out = asked.select("query_id", "variant")
    for name, hits in (("hits", strict), ("hits_relaxed", relaxed)):
        if hits is None:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
        else:
            out = out.join(hits.groupBy("query_id", "variant").agg(F.count("*").alias(name)), ["query_id", "variant"], "left").fillna(0, [name])
    return out


def retrieve(queries: DataFrame, docs: DataFrame, k: int = 5, *, embedder: Callable[[], Provider] | None = None, where: Column | None = None, entities: dict | None = None, prefer: str | None = None, long_answer: bool | str = False, mode: str = "lexical", index: textindex.TextIndex | None = None) -> Result:
    """Contexts and prompts for queries (query_id, query[, vector]).

    Every variant of a query is searched as itself: with an ``embedder`` its own text is embedded,
    as a query; without one its vector is the question's for the question and none for others, which
    then find by words alone.  ``long_answer`` holds for all questions or names a boolean column of
    theirs; either way everything is searched once.  An ``index`` of the documents' texts serves the
    searches without a filter.  All variants are searched with the filter at once; those of queries
    for which that gives too little are searched again without it.  The relaxation rules then keep
    what a search that stops early would have collected."""
    k = top_k(k)
    asked = fuse.variants(queries, entities=entities).withColumnRenamed("text", "_variant").drop("query").withColumnRenamed("_variant", "query")
    if embedder is not None:
        asked = with_vectors(asked.drop("vector"), embedder, text="query", prefix=QUERY)
    else:
        asked = asked.withColumn("vector", F.when(F.col("variant") == 0, F.col("vector")))
    probe = stored(asked.select("query_id", "variant", "query", "vector").withColumn("vid", F.monotonically_increasing_id()), "probes")
    strict = _found(probe, docs, max(k, 10), "strict", where=where, relaxed=False, index=index)
    relaxed = None
    if where is not None:
        few = fuse.relax(_counts(probe, strict, None), k, filtered=False).where("kept").groupBy("query_id").agg(F.sum("hits").alias("n")).where(F.col("n") < k)
        relaxed = _found(probe.join(few.select("query_id"), "query_id", "left_semi"), docs, max(k, 12), "relaxed", relaxed=True, index=index)
    every = strict if relaxed is None else strict.unionByName(relaxed)
    kept = fuse.relax(_counts(probe, strict, relaxed), k, filtered=where is not None).where("kept").select("query_id", "variant", "stage")
    staged = every.withColumn("relaxed_", F.col("relaxed")).join(kept.withColumn("relaxed_", F.col("stage") == 3), ["query_id", "variant", "relaxed_"]).drop("relaxed_")
    marked = fuse.annotate(staged).join(docs.drop("vector"), "doc_id")
    if prefer is not None:
        marked = fuse.type_boost(marked, kind=prefer)
    single = stored(fuse.dedupe(marked, "doc_id", ["stage", "variant", "rank"]), "hits")
    blocked = fuse.low_confidence(single, k).where("blocked").select("query_id")
    good = single.join(blocked, "query_id", "left_anti").join(queries.select("query_id", "query"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "stage", "variant", "rank", "doc_id")
    ordered = good.withColumn("rank", F.row_number().over(order))
    deep = rerank.rerank(ordered, max(2 * k, 12), mode).withColumn("rank", F.col("new_rank")).drop("new_rank")
    if isinstance(long_answer, bool):
        wants = queries.withColumn("_long", F.lit(long_answer))
    else:
        wants = queries.withColumn("_long", F.coalesce(F.col(long_answer), F.lit(False)))
        deep = stored(deep, "deep")  # read for short and for long answers
    contexts, prompts = [], []
    for long in (False, True) if isinstance(long_answer, str) else (long_answer,):
        side = wants.where(F.col("_long") == long).drop("_long")
        taken = deep.where(F.col("rank") <= rerank.contexts_taken(k, long)).join(side.select("query_id"), "query_id", "left_semi")
        contexts.append(taken)
        prompts.append(prompt.rag_prompts(side, taken.withColumn("label", F.col("doc_id").cast("string")), long_answer=long))
    return Result(single, reduce(DataFrame.unionByName, contexts), reduce(DataFrame.unionByName, prompts))


def dispatch(questions: DataFrame, facts: DataFrame, cache: DataFrame) -> DataFrame:
    """questions (query_id, question, long_answer) with (intent, answer, path).

    FAQ answers first, then the route, then cached answers (key, answer); the rest are left for
    the path of their intent with a null answer."""
    from quillspark.functions.text import cache_key

    faq = route.faq_match(questions, facts).select("query_id", F.col("answer").alias("faq_answer"))
    q = questions.join(faq, "query_id", "left").withColumn("intent", F.when(F.col("faq_answer").isNotNull(), "faq").otherwise(route.intent("question")))
    q = q.withColumn("key", cache_key("question", F.coalesce("long_answer", F.lit(False)), "intent"))
    q = q.join(cache.select("key", F.col("answer").alias("cached")), "key", "left")
    path = F.when(F.col("faq_answer").isNotNull(), "faq").when(F.col("cached").isNotNull(), "cache").otherwise(F.col("intent"))
    return q.select("query_id", "question", "intent", F.coalesce("faq_answer", "cached").alias("answer"), path.alias("path"))
