"""Sessions: settings that plans here rely on, and a local session for tests and benches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A union that keeps its children's partitioning zips their partitions, which fails when adaptive
#: execution has coalesced one child and not the other.
#: Batches that Python gets are bounded by bytes; by rows alone they grow with the texts, and with the
#: partitions up to 10,000 whole texts.
REQUIRED = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def prepared(spark: SparkSession) -> SparkSession:
    """``spark`` with the settings that plans rely on."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; deleted at
    the end of the session.  Only a local master, one process on one machine, may go without."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", base)
    _scratch.append(f"{base.rstrip('/')}/quillspark-{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later plans don't compute it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _scratch if spark is not None else ():
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already
            return


def local(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("quillspark").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", "/tmp")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepared(spark)
