"""Sinks: write-if-absent, upsert, partitioned chunk tables, text and JSON-lines exports."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.embed import retried


def absent(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New rows whose key the target hasn't; of rows that repeat a key, one."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of both; where a key is in both, the new row's columns that aren't null win.

    Of new rows that repeat a key the one latest by ``order`` counts."""
    if order:
        last = Window.partitionBy(key).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: [F.col(f"{a}.{c}") for a, d in (("n", new), ("o", old)) if c in d.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[F.coalesce(*pick(c)).alias(c) for c in columns])


def retried_write(rows: DataFrame, write: Callable[[DataFrame], None], *, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> None:
    """``write(rows)``, tried again with growing pauses; for stores that refuse a bulk write at times."""
    retried(lambda: write(rows), attempts=attempts, sleep=sleep)


def chunk_table(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet partitioned by type, so a type filter prunes files."""
    chunks.write.mode("overwrite").partitionBy("type").parquet(path)


def chunk_text(chunks: DataFrame, header: list[str], text: str = "text") -> DataFrame:
    """(value): chunks in their text form, a header line and the body."""
    return chunks.select(F.concat(F.lit("###META### "), F.to_json(F.struct(*header)), F.lit("\n"), T.strip_ends(F.col(text)), F.lit("\n")).alias("value"))


def markdown(pages: DataFrame) -> DataFrame:
    """(name, md, txt): Markdown with its source noted, and plain text without links."""
    return pages.select("name", F.concat(F.lit("<!-- source: "), F.col("url"), F.lit(" -->\n\n"), F.col("markdown")).alias("md"), T.strip_links("markdown").alias("txt"))


def text(rows: DataFrame, path: str, column: str = "text") -> None:
    """Normalised texts, each closed by a line end."""
    rows.select(T.normalise_prose(column, line_ends=True).alias("value")).write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def new_version(rows: DataFrame, root: str, version: str) -> str:
    """Writes beside earlier versions, never in place."""
    path = f"{root.rstrip('/')}/version={version}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Corpora with different columns, one below the other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
