"""Shared plumbing: tables written to the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import prepared

_written: list[str] = []


def scratch_base(spark: SparkSession) -> str:
    """The folder every executor shares.

    Read from ``spark.checkpoint.dir``.  Only a local master, where driver and executors are one
    process, may fall back to a folder of this machine; elsewhere an unset value is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
        return base
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; what is written there goes at the end of the session."""
    path = f"{scratch_base(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and a lost
    executor only costs the tasks that read the files again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_quill_path", None)
    if path:
        delete(df.sparkSession, path)
        _written.remove(path)


class Scratch:
    """Deletes at its end the tables written meanwhile, but those that were kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._quill_path)
        return df

    def __enter__(self) -> Scratch:
        self.before = set(_written)
        return self

    def __exit__(self, failed, *_) -> None:
        for path in [] if failed else [p for p in _written if p not in self.before | self.kept]:
            delete(self.spark, path)
            _written.remove(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened where they are among ``columns`` (letter case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one key from which a join meets the key's other side by broadcast, and such keys at most.
HEAVY, HEAVY_KEYS = 100_000, 500_000


def joined_on(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """Equi-join of many rows with a table that has a key once.

    ``heavy`` (key) names the keys of more than ``HEAVY`` rows, None if there are none: their rows
    stay where they are and meet a broadcast part of the table, so no task holds all rows of a key."""
    if heavy is None:
        return left.join(right, key, how)
    few = F.broadcast(heavy)
    hot = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how)
    return hot.unionByName(left.join(few, key, "left_anti").join(right, key, how))


def heavy_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame | None:
    """(key) of counts (key, n) beyond ``HEAVY``; None if there are none or more than are broadcast."""
    found = counts.where(F.col(n) > HEAVY).select(key)
    return found if 0 < found.limit(HEAVY_KEYS + 1).count() <= HEAVY_KEYS else None


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written if spark is not None else ():
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone already; the folder is the cluster's scratch
            return


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")
