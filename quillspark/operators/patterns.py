"""Many patterns in many texts: an Aho-Corasick automaton that reads each text once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of patterns that one automaton holds; more are searched in blocks, a scan each.
BLOCK_CHARS = 4 << 20


def _automaton(patterns: list[tuple[str, int]]):
    import ahocorasick

    out, least = ahocorasick.Automaton(), {}
    for p, place in patterns:
        least[p] = min(place, least.get(p, place))
    for p, place in least.items():
        out.add_word(p, place)
    out.make_automaton()
    return out


def _scanner(spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = spread.value
        found, best = _automaton(patterns), min(place for _, place in patterns)
        for batch in batches:
            keep, places = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                least = None
                for _, place in found.iter(text):
                    if least is None or place < least:
                        least = place
                        if least == best:
                            break
                if least is not None:
                    keep.append(i)
                    places.append(least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(places, pa.int64())], ["id", "place"])

    return run


def _blocks(patterns: DataFrame) -> Iterator[list[tuple[str, int]]]:
    """Patterns in blocks of bounded characters, one of which is on the driver at a time."""
    sizes = patterns.agg(F.sum(F.length("p") + 1)).first()[0] or 0
    n = max(1, -(-2 * sizes // BLOCK_CHARS)) if sizes > BLOCK_CHARS else 1
    for i in range(n):
        part = patterns if n == 1 else patterns.where(F.pmod(F.xxhash64("p"), F.lit(n)) == i)
        rows = [(r["p"], r["place"]) for r in part.collect()]
        if rows:
            yield rows


def first_found(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, place): for each of texts (id, text) with any of the patterns (p, place) in it, the least
    place of those.

    An empty pattern is in every text; null texts and patterns are in none.  Rows that repeat an id
    are texts of their own.  With several blocks of patterns texts are read once for each."""
    rows = texts.where("text is not null").select("id", "text")
    real = patterns.where("p is not null and place is not null").select("p", F.col("place").cast("bigint").alias("place"))
    kind = texts.schema["id"].dataType.simpleString()
    out = None
    empty = real.where("p = ''").agg(F.min("place")).first()[0]
    if empty is not None:
        out = rows.select("id", F.lit(empty).alias("place"))
    for block in _blocks(real.where("p <> ''")):
        spread = texts.sparkSession.sparkContext.broadcast(block)
        found = rows.mapInArrow(_scanner(spread), f"id {kind}, place bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select("id", F.lit(None).cast("bigint").alias("place")).where(F.lit(False))
    return out.groupBy("id").agg(F.min("place").alias("place"))
