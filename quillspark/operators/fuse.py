"""Fusion, annotation, deduplication and relaxation of ranked lists, for batches of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import RANKING, top_k
from quillspark.functions import text as T

# Entities of the corpus and the names they go by.
ENTITIES = {
    "thúy kiều": ("thúy kiều", "thuý kiều", "thuy kieu", "kiều", "thụy kiều"),
    "thúy vân": ("thúy vân", "thuý vân", "thuy van", "vân"),
    "kim trọng": ("kim trọng", "kim trong", "kim-trọng"),
    "từ hải": ("từ hải", "tu hai", "từ-hải"),
    "hoạn thư": ("hoạn thư", "hoan thu"),
    "giác duyên": ("giác duyên", "giac duyen"),
}
# What is asked about an entity.
ENTITY_QUESTIONS = ("nhân vật {name}", "tiểu sử {name}", "{name} trong truyện kiều", "vai trò của {name}", "{first} của truyện kiều")


def rrf(lists: list[DataFrame], *, constant: int = RANKING.rrf_constant, cut: int | None = None) -> DataFrame:
    """lists of (query_id, doc_id, score, rank) to (query_id, doc_id, rrf, list_no, first_rank, score, scores).

    Sum of 1 / (constant + rank) over the lists, of which ``cut`` keeps the first ranks only.  The
    first list's score stands for the document; ``scores`` has each list's, the last one counts.
    One aggregation: sums are combined before the shuffle."""
    one = [d.select("query_id", "doc_id", "score", "rank", F.lit(i).alias("list_no")) for i, d in enumerate(lists)]
    every = reduce(DataFrame.unionByName, one)
    if cut is not None:
        every = every.where(F.col("rank") <= cut)
    first = F.min(F.struct("list_no", "rank", "score"))
    by_list = [F.max(F.when(F.col("list_no") == i, F.col("score"))).alias(f"s{i}") for i in range(len(lists))]
    fused = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), 12).alias("rrf"), first.alias("f"), *by_list)
    return fused.select("query_id", "doc_id", "rrf", "f.list_no", F.col("f.rank").alias("first_rank"), "f.score", F.array(*[f"s{i}" for i in range(len(lists))]).alias("scores"))


def fused_order(fused: DataFrame) -> DataFrame:
    """Ranks by fused score; ties keep the order of lists, then of ranks within them."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "list_no", "first_rank")
    return fused.withColumn("rank", F.row_number().over(order))


def hybrid(vector: DataFrame, text: DataFrame, k: int, *, always: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): both sides fused where the text side found anything, else
    the vector side with its own scores."""
    fused = fused_order(rrf([vector, text])).select("query_id", "doc_id", F.col("rrf").alias("score"), "rank")
    if not always:
        found = text.select("query_id").distinct()
        fused = fused.join(found, "query_id", "left_semi").unionByName(vector.join(found, "query_id", "left_anti").select("query_id", "doc_id", "score", "rank"))
    return fused.where(F.col("rank") <= k)


def type_boost(hits: DataFrame, *, bonus: float = RANKING.poem_bonus, kind: str = "poem", rerank: bool = False) -> DataFrame:
    """Adds ``bonus`` to the score of one type; ``rerank`` also sets ranks anew."""
    out = hits.withColumn("score", F.col("score") + F.when(F.coalesce(F.col("type") == kind, F.lit(False)), bonus).otherwise(0.0))
    if rerank:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "doc_id")))
    return out


def annotate(hits: DataFrame) -> DataFrame:
    """hits with variant (0-based), relaxed and rank (from 1): ``raw_score`` keeps the score, from
    which penalties for variant, relaxed filters and rank are taken."""
    penalty = RANKING.variant_penalty * F.col("variant") + F.when(F.col("relaxed"), RANKING.relaxed_penalty).otherwise(0.0)
    return hits.withColumn("raw_score", F.col("score")).withColumn("score", F.col("score") - penalty - RANKING.rank_penalty * (F.col("rank") - 1))


def dedupe_key(doc_id: Column, meta_ids: list[Column], text: Column, position: Column) -> Column:
    """Document id and the first metadata id that isn't empty; else the head of the unaccented
    text; else the position."""
    some = lambda c: F.when(c.cast("string") != "", c.cast("string"))
    named = F.concat_ws("::", some(doc_id), F.coalesce(*[some(m) for m in meta_ids]) if meta_ids else F.lit(None).cast("string"))
    return F.coalesce(some(named), some(F.substring(T.strip_accents(F.coalesce(text, F.lit(""))), 1, 160)), position.cast("string"))


def dedupe(hits: DataFrame, key: str, order: list[str | Column], by: str | None = "query_id") -> DataFrame:
    """The first hit of each key in order of collection, not the best one."""
    w = Window.partitionBy(*([by, key] if by else [key])).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def relax(counts: DataFrame, k: int, *, filtered: bool = True) -> DataFrame:
    """counts (query_id, variant, hits, hits_relaxed) to (query_id, variant, stage, hits, kept).

    All searches are scored in one job; this says which a search that stops early would have made:
    stage 1 the query itself; stage 2 its variants, if that found under max(2, k), until
    max(3k, 25) are collected; stage 3 all variants without filters, if under k are collected,
    until max(4k, 32) are."""
    k = top_k(k)
    order = Window.partitionBy("query_id").orderBy("variant")
    before = F.coalesce(F.sum("hits").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.max(F.when(F.col("variant") == 0, F.col("hits"))).over(Window.partitionBy("query_id"))
    more = base < max(2, k)
    # The first variant is always searched; later ones while the limit isn't reached after it.
    first = counts.withColumns({"_before": before, "_more": more})
    kept = (F.col("variant") == 0) | (F.col("_more") & ((F.col("variant") == 1) | (F.col("_before") < max(3 * k, 25))))
    first = first.withColumn("kept", kept)
    collected = F.sum(F.when(F.col("kept"), F.col("hits")).otherwise(0)).over(Window.partitionBy("query_id"))
    first = first.withColumn("_collected", collected)
    relaxed_before = F.coalesce(F.sum("hits_relaxed").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_collected")
    third = first.withColumn("_rb", relaxed_before)
    kept3 = F.lit(filtered) & (F.col("_collected") < k) & ((F.col("variant") == 0) | (F.col("_rb") < max(4 * k, 32)))
    one = first.select("query_id", "variant", F.when(F.col("variant") == 0, 1).otherwise(2).alias("stage"), "hits", "kept")
    return one.unionByName(third.select("query_id", "variant", F.lit(3).alias("stage"), F.col("hits_relaxed").alias("hits"), kept3.alias("kept")))


def low_confidence(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, n, mean_raw, blocked): whether under ``k`` hits whose best ``k`` have a raw mean
    below the threshold."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "doc_id")
    top = hits.withColumn("_r", F.row_number().over(best))
    sums = top.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("_r") <= max(1, k), F.col("raw_score"))).alias("mean_raw"))
    return sums.withColumn("blocked", (F.col("mean_raw") < RANKING.low_confidence) & (F.col("n") < k))


def variants(queries: DataFrame, query: str = "query", entities: dict[str, tuple[str, ...]] | None = None, questions: tuple[str, ...] = ENTITY_QUESTIONS) -> DataFrame:
    """(…, variant, text): the query, its unaccented form, and for each entity it names the entity's
    names and questions; case-insensitively distinct, in that order."""
    entities = ENTITIES if entities is None else entities
    base = T.squeeze(query)
    plain = T.strip_accents(base)
    low, plain_low = F.lower(base), F.lower(plain)
    parts = [F.array(base), F.when(plain_low != low, F.array(plain)).otherwise(F.array())]
    for name, aliases in entities.items():
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) for a in aliases]) | F.contains(plain_low, F.lit(T.plain(name)))
        names = [F.lit(x) for a in (name, *aliases) for x in (a, T.plain(a))]
        asked = [F.lit(q.format(name=name, first=name.split()[0])) for q in questions]
        parts.append(F.when(hit, F.array(*names, *asked)).otherwise(F.array()))
    every = F.filter(F.concat(*[p.cast("array<string>") for p in parts]), lambda x: x != "")
    firsts = T.let(every, lambda e: T.let(F.transform(e, F.lower), lambda low_e: F.filter(e, lambda x, i: F.array_position(low_e, F.element_at(low_e, i + 1)) == i + 1)))
    return queries.select(*queries.columns, F.posexplode(firsts).alias("variant", "text"))


def sources(contexts: DataFrame, label: str = "label") -> DataFrame:
    """(query_id, label, first_rank): distinct labels of all contexts in order of rank."""
    return contexts.groupBy("query_id", label).agg(F.min("rank").alias("first_rank"))


def evidence(contexts: DataFrame, n: int) -> DataFrame:
    return contexts.where(F.col("rank") <= max(1, n))
