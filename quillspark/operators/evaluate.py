"""Evaluation of answers and rankings, and building of training records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases by which an answer refuses.
REFUSALS = ("chưa đủ căn cứ", "ngoài phạm vi")


def containment(answer: Column | str, expects: Column | str) -> Column:
    """Share of the expected strings that the answer contains, letter case aside; 0 for none."""
    a = F.lower(F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit("")))
    e = F.col(expects) if isinstance(expects, str) else expects
    e = F.coalesce(e, F.array().cast("array<string>"))
    return F.size(F.filter(e, lambda x: F.contains(a, F.lower(x)))) / F.greatest(F.lit(1), F.size(e))


def golden_mean(rows: DataFrame, answer: str = "answer", expects: str = "expects") -> DataFrame:
    return rows.agg(F.round(F.avg(containment(answer, expects)), 3).alias("golden_avg"))


def refusal_rate(rows: DataFrame, answer: str = "answer", phrases: tuple[str, ...] = REFUSALS) -> DataFrame:
    a = F.lower(F.coalesce(F.col(answer), F.lit("")))
    refused = F.lit(False)
    for p in phrases:
        refused = refused | F.contains(a, F.lit(p))
    return rows.agg(F.round(F.avg(refused.cast("int")), 3).alias("refusal_rate"))


def hit_at(rankings: DataFrame, gold: DataFrame, k: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """rankings (query_id, doc_id, rank) and gold (query_id, doc_id): the share of gold's queries
    with a gold document among the first ``k``; where ``gold`` holds ranked documents only, ``queries``
    (query_id) are those that count.  A semi-join: nothing is gathered per query."""
    found = rankings.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    return (gold if queries is None else queries).select("query_id").distinct().join(found, "query_id", "left").agg(F.lit(k).alias("k"), F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("hit_rate"))


def snippets(rankings: DataFrame, docs: DataFrame, n: int = 320, text: str = "text") -> DataFrame:
    """Ranked rows with the head of their text on one line, for reading."""
    return rankings.join(docs, "doc_id").withColumn("snippet", F.substring(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "), 1, n))


#: Requested tags that meet all chunks at once, and pairs of a chunk and a request that are held.
ASKED_TAGS, PAIRS = 100_000, 1 << 20


def _picker(spread, blocks: int):
    """Each request's best chunks of a task, (request, place, score)."""

    def run(batches):
        asked = spread.value  # tag: numbers of the requests that want it
        most = max(max(map(len, asked.values())), 1)
        request, place, score = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            places, lists = np.asarray(batch.column(0), np.int64), batch.column(1).to_pylist()
            step = max(1, PAIRS // (most * max(1, max((len(x) for x in lists if x), default=1))))
            for lo in range(0, len(lists), step):
                found = [(i, asked[t]) for i in range(lo, min(lo + step, len(lists))) for t in set(lists[i] or ()) if t in asked]
                if not found:
                    continue
                row = np.repeat([i for i, _ in found], [len(x) for _, x in found])
                pair, n = np.unique(np.stack([np.concatenate([x for _, x in found]), row]), axis=1, return_counts=True)
                request, place, score = np.append(request, pair[0]), np.append(place, places[pair[1]]), np.append(score, n)
                order = np.lexsort((place, -score, request))
                first = np.searchsorted(request[order], request[order])
                order = order[np.arange(len(order)) - first < blocks]
                request, place, score = request[order], place[order], score[order]
        if len(request):
            yield pa.RecordBatch.from_arrays([pa.array(request), pa.array(place), pa.array(score)], ["request", "place", "score"])

    return run


def pick_contexts(requests: DataFrame, chunks: DataFrame, *, blocks: int = 2, most: int = 900) -> DataFrame:
    """(request_id, context): texts of the ``blocks`` chunks that share most required tags, ties going
    to the lesser place.

    requests (request_id, required_tags) with ids of their own, chunks (place, tags, text) with numbers
    of their own.  Requests are broadcast in blocks of bounded tags; a task keeps each request's best
    chunks, so ``blocks`` rows for a request and task are shuffled, and the texts come in once the
    winners are known.  No overlap or no required tags give an empty context; a longer one than
    ``most`` is cut and marked."""
    spark = requests.sparkSession
    asked = requests.select("request_id", F.explode(F.array_distinct("required_tags")).alias("tag")).where("tag is not null")
    many = max(1, -(-2 * asked.count() // ASKED_TAGS))
    tagged, best = chunks.select(F.col("place").cast("bigint").alias("place"), "tags"), None
    numbered = "request_id " + requests.schema["request_id"].dataType.simpleString() + ", request bigint"
    for block in range(many):
        part = asked if many == 1 else asked.where(F.pmod(F.xxhash64("request_id"), F.lit(many)) == block)
        rows = part.collect()  # one block
        if not rows:
            continue
        ids = list(dict.fromkeys(r["request_id"] for r in rows))
        number, wanted = {x: i for i, x in enumerate(ids)}, {}
        for r in rows:
            wanted.setdefault(r["tag"], set()).add(number[r["request_id"]])
        spread = spark.sparkContext.broadcast({t: np.array(sorted(x), np.int64) for t, x in wanted.items()})
        found = tagged.mapInArrow(_picker(spread, blocks), "request bigint, place bigint, score bigint").join(F.broadcast(spark.createDataFrame(list(number.items()), numbered)), "request").drop("request")
        best = found if best is None else best.unionByName(found)
    if best is None:
        return requests.select("request_id", F.lit("").alias("context"))
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "place"))).where(F.col("nth") <= blocks)
    texts = best.join(chunks.select(F.col("place").cast("bigint").alias("place"), "text"), "place").groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x.text), "\n\n---\n\n")
    cut = F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most), F.lit("…"))).otherwise(joined)
    return requests.select("request_id").join(texts.select("request_id", cut.alias("context")), "request_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


#: Our own templates of training records: instruction, required tags, seed of the output.
TEMPLATES = [
    ("Explain how the heroine's fate and talent are set against each other.", ["char:thuy_kieu", "theme:tai_menh"], ""),
    ("Describe how the two sisters are portrayed and what the difference foretells.", ["char:thuy_van", "char:thuy_kieu"], ""),
    ("Show how landscape carries feeling in the passage.", ["device:ta_canh_ngu_tinh"], ""),
    ("Name the allusions in the passage and what each adds.", ["device:dien_co"], ""),
    ("Discuss the conventional images of the passage.", ["device:uoc_le"], ""),
    ("Read the scene in which love is handed on to the sister.", ["section:trao_duyen"], ""),
    ("Characterise the hero by his words and deeds.", ["char:tu_hai", "section:chi_khi_anh_hung"], ""),
    ("Discuss reward and revenge in the judgement scene.", ["section:bao_an_bao_oan"], ""),
    ("Say what the poem's compassion rests on.", ["theme:nhan_dao", "theme:so_phan"], ""),
]


def template_table(spark: SparkSession) -> DataFrame:
    """(request_id, instruction, required_tags, output_seed) of the templates."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "request_id bigint, instruction string, required_tags array<string>, output_seed string")


def sft_records(templates: DataFrame, contexts: DataFrame, system: str) -> DataFrame:
    """templates (request_id, instruction, required_tags, output_seed) joined with their contexts."""
    return templates.join(contexts, "request_id").select(F.lit(system).alias("system"), "instruction", "context", F.trim(F.coalesce("output_seed", F.lit(""))).alias("output"), F.col("required_tags").alias("tags"))


def fill_outputs(records: DataFrame, bank: list[tuple[str, str]], instruction: str = "instruction", output: str = "output") -> DataFrame:
    """Empty outputs filled by the first (pattern, output) of the bank that the instruction matches.

    The bank is a short list written by hand: one expression, no join."""
    text = F.coalesce(F.col(instruction), F.lit(""))
    found = [F.when(text.rlike("(?iuU)" + pattern), F.lit(put)) for pattern, put in bank]
    return records.withColumn(output, F.coalesce(F.when(F.col(output) != "", F.col(output)), *found, F.col(output)))


def with_negatives(records: DataFrame, negatives: DataFrame) -> DataFrame:
    """Records and refusal examples."""
    return records.unionByName(negatives)
