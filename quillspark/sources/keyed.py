"""Stores that are found by a key: one that a batch merges into, and one that it only adds to.

``KeyedStore`` keeps rows in folders by the hash of their key.  A batch reads and rewrites the folders
of its own keys only, by dynamic partition overwrite, and is marked as done afterwards: a replay of a
marked batch does nothing, and a replay of one that failed on its way gives the same rows again.

``append_absent`` keeps beside each file a Bloom filter and the range of its keys, so that a batch
reads the keys of those files that may hold one of its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quillspark.session import prepared, stored
from quillspark.sources.sinks import upsert

#: Folders of a store, bits and probes of a filter for each key, keys that are looked up at once.
BUCKETS, BITS, PROBES, KEYS = 64, 20, 7, 2_000_000


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


class KeyedStore:
    """Rows by ``key`` under a path; any session may open it."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = prepared(spark), path.rstrip("/"), key, buckets

    def _bucket(self, key):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        return _exists(self.spark, f"{self.path}/rows")

    def _rows(self) -> DataFrame:
        """With the schema of the last batch that added a column: folders keep files of earlier ones."""
        last = self.spark.read.text(f"{self.path}/schema").orderBy(F.desc(F.length("value"))).first()[0]
        return self.spark.read.schema(StructType.fromJson(json.loads(last)).add("_bucket", IntegerType())).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._rows().drop("_bucket")

    def lookup(self, keys: list) -> DataFrame:
        """Rows of a few keys, from their folders alone."""
        wanted = self.spark.createDataFrame([(k,) for k in keys], [self.key]).select(self._bucket(self.key).alias("b"))
        folders = [r["b"] for r in wanted.distinct().collect()]
        return self._rows().where(F.col("_bucket").isin(folders) & F.col(self.key).isin(keys)).drop("_bucket")

    def merge(self, batch: DataFrame, *, order: str | None = None, batch_id: str | None = None) -> bool:
        """Puts a batch's rows in: where a key is there already, columns that aren't null win; of rows that
        repeat a key the latest by ``order`` counts.  Rows without a key are left out.

        False if the batch was done before.  New columns are added, columns must not change type."""
        mark = f"{self.path}/_done/{batch_id}"
        if batch_id is not None and _exists(self.spark, mark):
            return False
        rows = batch.where(F.col(self.key).isNotNull())
        if order is None:
            rows = rows.dropDuplicates([self.key])
        else:  # the hot keys are thinned before the shuffle
            last = F.max_by(F.struct(*rows.columns), order)
            rows = rows.groupBy(F.col(self.key).alias("_k")).agg(last.alias("_r")).select("_r.*")
        rows = stored(rows, "batch")
        if self.exists():
            touched = [r["b"] for r in rows.select(self._bucket(self.key).alias("b")).distinct().collect()]  # folders
            if not touched:
                merged = None
            else:
                old = self._rows().where(F.col("_bucket").isin(touched)).drop("_bucket")
                merged = stored(upsert(old, rows, self.key), "merged")  # a folder isn't read while it is written
        else:
            merged = rows
        if merged is not None:
            if not self.exists() or set(merged.columns) - set(old.columns):
                self.spark.createDataFrame([(merged.schema.json(),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/schema")
            out = merged.withColumn("_bucket", self._bucket(self.key)).repartition("_bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string"), F.lit(1)), F.lit(4)))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")
        if batch_id is not None:
            p, fs = _path(self.spark, mark)
            fs.create(p).close()
        return True

    def writer(self, name: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: each batch once, whatever is replayed."""
        return lambda batch, n: self.merge(batch, order=order, batch_id=f"{name}-{n}") and None


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(key, probe): bits of a filter of that many bits."""
    h = hashes.astype(np.uint64)
    with np.errstate(over="ignore"):
        step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
        return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _filtered(table: pa.Table) -> pa.Table:
    """One file's (file, n, low, high, bits) from its rows (file, hash, key)."""
    hashes = np.unique(np.asarray(table.column("hash"), np.int64))
    size = max(64, -(-len(hashes) * BITS // 8) * 8)
    held = np.zeros(size, bool)
    held[_probes(hashes, size).ravel()] = True
    return pa.table({"file": [table.column("file")[0].as_py()], "n": [len(hashes)], "low": [table.column("low")[0].as_py()], "high": [table.column("high")[0].as_py()], "bits": [np.packbits(held).tobytes()]})


def _with_keys(spread):
    """Files whose filter lets one of the broadcast keys (sorted texts and hashes) by."""

    def run(batches):
        keys, hashes = spread.value
        for batch in batches:
            found = []
            for file, low, high, bits in zip(*(batch.column(i).to_pylist() for i in range(4))):
                a, b = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
                held = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
                if b > a and held[_probes(hashes[a:b], len(held))].all(axis=1).any():
                    found.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["file"])

    return run


def _files(spark: SparkSession, path: str) -> set[str]:
    """Names of the files of rows: a driver-side listing, as any read of the path makes."""
    p, fs = _path(spark, path)
    return {s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")} if fs.exists(p) else set()


def _noted(spark: SparkSession, path: str, key: str, files: set[str]) -> None:
    """Writes the filters of files that have none."""
    if not files:
        return
    rows = spark.read.parquet(*[f"{path}/{f}" for f in sorted(files)])
    text = F.col(key).cast("string")
    keyed = rows.where(F.col(key).isNotNull()).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.xxhash64(text).alias("hash"), text.alias("key"))
    ranges = keyed.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    notes = keyed.drop("key").join(F.broadcast(ranges), "file").groupBy("file").applyInArrow(_filtered, "file string, n bigint, low string, high string, bits binary")
    notes.write.mode("append").parquet(f"{path}/_keys")


def append_absent(new: DataFrame, path: str, key: str, *, read: list | None = None, repeats: bool = False) -> None:
    """Appends rows whose key the files under ``path`` haven't; of rows that repeat a key, one, or all
    with ``repeats``; rows without a key are left out.

    A filter never misses a key, and a file without one is read, so no key is taken for absent that is
    there.  ``read`` gets the names of the files whose keys were read.  More than ``KEYS`` new keys are
    compared with the keys of all files."""
    spark, path = prepared(new.sparkSession), path.rstrip("/")
    rows = new.where(F.col(key).isNotNull())
    rows = stored(rows if repeats else rows.dropDuplicates([key]), "new")
    there = _files(spark, path)
    noted = {r["file"] for r in spark.read.parquet(f"{path}/_keys").select("file").collect()} if _exists(spark, f"{path}/_keys") else set()
    maybe = set(there)
    n = rows.count()
    if noted and n <= KEYS:
        t = rows.select(F.col(key).cast("string").alias("key"), F.xxhash64(F.col(key).cast("string")).alias("hash")).toArrow()  # of bounded size
        keys = np.array(t.column("key").to_pylist(), object)
        order = np.argsort(keys, kind="stable") if n else np.zeros(0, int)
        spread = spark.sparkContext.broadcast((keys[order], np.asarray(t.column("hash"), np.int64)[order]))
        notes = spark.read.parquet(f"{path}/_keys").select("file", "low", "high", "bits")
        maybe = (there - noted) | ({r["file"] for r in notes.mapInArrow(_with_keys(spread), "file string").collect()} & there)
    if read is not None:
        read.extend(sorted(maybe))
    if maybe:
        rows = rows.join(spark.read.parquet(*[f"{path}/{f}" for f in sorted(maybe)]).select(key), key, "left_anti").select(*rows.columns)
    rows.write.mode("append").parquet(path)
    _noted(spark, path, key, _files(spark, path) - noted)
