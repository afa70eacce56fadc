"""Bounded, repeatable samples of rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import crc_mod


def _one_each(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each id: of texts that share an id, that of the least hash, then the least."""
    least = rows.groupBy("doc_id", *keys).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    return least.select("doc_id", "m.text", *keys)


def _marks(labels: DataFrame, label: str, limit: int, mod: int, held_out: int) -> DataFrame:
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(crc_mod(F.col("doc_id"), mod) != held_out)
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    return marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, mod: int, held_out: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents outside the held-out ids.

    Ids whose crc32 modulo ``mod`` is ``held_out`` never enter.  Repeated labels of one id count
    as one, their largest; null ids and labels other than 0 and 1 are left out.  Which ids enter
    follows their hash, so reruns agree.  Of documents that repeat an id one enters, chosen by hash.
    """
    return _one_each(_texts(docs).join(F.broadcast(_marks(labels, label, limit, mod, held_out)), "doc_id"), "label")


def mixed_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, unlabelled: int, mod: int, held_out: int) -> DataFrame:
    """The labelled sample and at most ``unlabelled`` other documents with a null label.

    The others are all documents, labelled ones too, whose labels are then never read; they are
    chosen by the hash of their ids.
    """
    marks = _marks(labels, label, limit, mod, held_out)
    rows = max(docs.count(), 1)
    # About twice as many ids as wanted lie below the bound; repeated ids only make them fewer.
    bound = min(2 * (limit + unlabelled) / rows, 1.0) * 2.0**64 - 2.0**63
    place = F.xxhash64(F.lit("unlabelled"), F.col("doc_id"))
    others = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (place.cast("double") <= bound)).distinct()
    others = others.join(F.broadcast(marks.select("doc_id")), "doc_id", "left_anti").orderBy(place, "doc_id").limit(unlabelled)
    chosen = marks.union(others.select("doc_id", F.lit(None).cast("int")))
    return _one_each(_texts(docs).join(F.broadcast(chosen), "doc_id"), "label")
