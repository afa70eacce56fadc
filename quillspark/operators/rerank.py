"""Re-ranking strategies behind one dispatcher."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import RANKING, top_k
from quillspark.functions.text import let, tokens


def _top(hits: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "rank", "doc_id")
    return hits.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def by_score(hits: DataFrame, k: int) -> DataFrame:
    return _top(hits.withColumn("re_score", F.coalesce(F.col("score"), F.lit(0.0))), "re_score", k)


def lexical(hits: DataFrame, k: int, query: str = "query", text: str = "text") -> DataFrame:
    """0.6 times the share of the text's tokens that the query has, with repeats and over at least
    three tokens, plus 0.4 times the score."""
    share = let(F.array_distinct(tokens(query)), lambda q: let(tokens(text), lambda said: F.size(F.filter(said, lambda t: F.array_contains(q, t))) / F.greatest(F.lit(RANKING.least_tokens), F.size(said))))
    out = hits.withColumn("_share", share)
    out = out.withColumn("re_score", F.round(RANKING.lexical_weight * F.col("_share") + RANKING.score_weight * F.coalesce(F.col("score"), F.lit(0.0)), 12))
    return _top(out.drop("_share"), "re_score", k)


def modelled(make: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[..., DataFrame]:
    """A strategy that scores (query, text) pairs with a model made once in each worker."""

    def run(hits: DataFrame, k: int, query: str = "query", text: str = "text") -> DataFrame:
        @F.pandas_udf("double")
        def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = make()
            for q, t in parts:
                yield pd.Series(model(q.fillna("").tolist(), t.fillna("").tolist()), dtype="float64")

        return _top(hits.withColumn("re_score", score(query, text)), "re_score", k)

    return run


class Hosted:
    """A hosted re-ranker as a model: ``send`` posts a question with its documents and gives the parsed
    answer, whose results name a document by ``index`` and score it; unnamed documents score 0."""

    def __init__(self, send: Callable[[dict], dict], model: str):
        self.send, self.model = send, model

    def __call__(self, queries: list[str], texts: list[str]) -> list[float]:
        scores = [0.0] * len(texts)
        for query in dict.fromkeys(queries):  # a batch has few questions, each with its documents
            own = [i for i, q in enumerate(queries) if q == query]
            answer = self.send({"model": self.model, "query": query, "documents": [texts[i] for i in own], "top_n": len(own)})
            for r in answer.get("results", answer.get("data", [])):
                scores[own[int(r["index"])]] = float(r.get("relevance_score", r.get("score", 0.0)))
        return scores


#: Modes; ``cross_encoder``, ``cohere``, ``jina`` and ``bge`` are there once a provider is registered.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"none": by_score, "off": by_score, "disabled": by_score, "lexical": lexical}
ALIASES = {"ce": "cross_encoder"}


def register(name: str, make: Callable) -> None:
    """Adds a model-backed mode if its provider can be made here; else the mode stays lexical."""
    try:
        make()
    except Exception:
        return
    STRATEGIES[name] = modelled(make)


def rerank(hits: DataFrame, k: int, mode: str = "lexical") -> DataFrame:
    """The best ``k`` hits of each query; an unknown mode is lexical."""
    mode = (mode or "").strip().lower()
    return STRATEGIES.get(ALIASES.get(mode, mode), lexical)(hits, top_k(k))


def depth(n: int, k: int) -> int:
    """How many hits are re-ranked."""
    return min(n, max(2 * k, 12))


def contexts_taken(k: int, long_answer: bool) -> int:
    return max(k, 6 if long_answer else k)
