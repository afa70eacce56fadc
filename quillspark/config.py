"""Constants of the retrieval engine, in one place and overridable per call."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Chunking:
    prose_words: int = 220
    poem_lines: int = 4
    poem_overlap: int = 1
    min_chunk_words: int = 5
    min_paragraph_words: int = 18


@dataclass(frozen=True)
class Ranking:
    """Fusion, penalties, thresholds and depths of the ranked retrieval."""

    rrf_constant: int = 60
    variant_penalty: float = 0.06
    relaxed_penalty: float = 0.12
    rank_penalty: float = 0.01
    poem_bonus: float = 0.5
    low_confidence: float = 0.002
    lexical_weight: float = 0.6
    score_weight: float = 0.4
    least_tokens: int = 3
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


@dataclass(frozen=True)
class Generation:
    """Sampling temperature and token budgets for short and long answers."""

    temperature_short: float = 0.55
    temperature_long: float = 0.6
    top_p: float = 0.9
    top_k: int = 40
    tokens_short: int = 600
    tokens_long: int = 1400


@dataclass(frozen=True)
class Settings:
    """What a deployment sets; each field is read from ``spark.quillspark.<field>``, else from the
    environment's ``QUILLSPARK_<FIELD>``, else its default stands."""

    top_k: int = 10
    rerank: str = "lexical"
    long_answer: bool = False
    show_sources: bool = True
    cache_capacity: int = 256
    cache_ttl: int = 7200

    @classmethod
    def read(cls, spark=None, env: Mapping[str, str] = os.environ) -> Settings:
        found = {}
        for field in fields(cls):
            value = spark.conf.get(f"spark.quillspark.{field.name}", None) if spark is not None else None
            value = env.get(f"QUILLSPARK_{field.name.upper()}") if value is None else value
            if value is not None:
                kind = type(field.default)
                found[field.name] = value.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(value.strip())
        return cls(**found)


def top_k(value: object, default: int = 10) -> int:
    """A usable k: ``default`` for what isn't a number, 1 for what isn't positive."""
    try:
        k = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        k = default
    return max(1, k)


def generation_options(long_answer: bool) -> dict:
    """What a generator is asked for: sampling and the token budget of short or long answers."""
    g = GENERATION
    return {"temperature": g.temperature_long if long_answer else g.temperature_short, "top_p": g.top_p, "top_k": g.top_k, "max_tokens": max(1, g.tokens_long if long_answer else g.tokens_short)}


CHUNKING, RANKING, GENERATION = Chunking(), Ranking(), Generation()
#: Bytes of a small side up to which a broadcast is asked for.
BROADCAST_BYTES = 64 << 20
