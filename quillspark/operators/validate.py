"""Validation of chunk headers: rules as columns, the report as one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("poem", "analysis", "summary", "bio")


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in rules]))


def basic_errors() -> Column:
    return _reasons(
        (_blank("id"), "no id"), (_blank("source"), "no source"), (_blank("source_id"), "no source_id"), (~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "unknown type"), (F.col("tags").isNull(), "tags is not a list"),
    )


def poem_errors() -> Column:
    return _reasons(
        (F.col("line_start").isNull(), "line_start is not an integer"), (F.col("line_end").isNull(), "line_end is not an integer"), (F.col("line_start") < 1, "line_start < 1"),
        (F.col("line_end") < F.col("line_start"), "line_end < line_start"), (F.contains("id", F.lit("L")) & ~F.col("id").rlike(r"_L\d{4}-\d{4}_"), "id is not of the poem pattern"),
    )


def prose_errors() -> Column:
    return _reasons(
        (F.col("char_start").isNull(), "char_start is not an integer"), (F.col("char_end").isNull(), "char_end is not an integer"), (F.col("char_start") < 0, "char_start < 0"), (F.col("char_end") <= F.col("char_start"), "char_end <= char_start"),
    )


def checked(chunks: DataFrame) -> DataFrame:
    """Headers with ``verdict`` (ok, basic, poem, prose) and ``reason``.

    Basic rules come first; a header that breaks one isn't looked at further.  A header that
    could not be parsed (``parsed`` false, if that column is there) is a prose error."""
    basic = F.size(basic_errors()) > 0
    typed = F.when(F.col("type") == "poem", poem_errors()).otherwise(prose_errors())
    verdict = F.when(basic, "basic").when(F.size(typed) == 0, "ok").when(F.col("type") == "poem", "poem").otherwise("prose")
    reason = F.array_join(F.when(basic, basic_errors()).otherwise(typed), "; ")
    if "parsed" in chunks.columns:
        verdict = F.when(~F.col("parsed"), "prose").otherwise(verdict)
        reason = F.when(~F.col("parsed"), "header cannot be parsed").otherwise(reason)
    return chunks.withColumn("verdict", verdict).withColumn("reason", reason)


def report(chunks: DataFrame) -> DataFrame:
    """One row: files, ok, poem_ok, prose_ok and errors by kind."""
    v, poem = F.col("verdict"), F.col("type") == "poem"
    return checked(chunks).agg(
        F.count("*").alias("files"), F.count_if(v == "ok").alias("ok"), F.count_if((v == "ok") & poem).alias("poem_ok"), F.count_if((v == "ok") & ~poem).alias("prose_ok"),
        F.count_if(v == "basic").alias("basic_err"), F.count_if(v == "poem").alias("poem_err"), F.count_if(v == "prose").alias("prose_err"),
    )


def shown_errors(chunks: DataFrame, limit: int = 40) -> DataFrame:
    """The first errors by id, for a report."""
    return checked(chunks).where("verdict <> 'ok'").orderBy("id", "reason").limit(limit).select("id", "verdict", "reason")


def exit_code(chunks: DataFrame) -> int:
    """1 where any header breaks a rule, else 0."""
    return int(checked(chunks).where("verdict <> 'ok'").limit(1).count() > 0)
