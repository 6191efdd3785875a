"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch: 10,000 long texts are too much for a small executor.
ARROW_BYTES = 4 << 20
#: Bytes of a shuffle that one task reads; a fixed number of partitions would let a task's share grow with the table.
SHARE = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Keep Arrow batches to so many bytes, unless the session has less already; the number of rows is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key).rstrip("b")
    if not found.isdigit() or int(found) > size:
        spark.conf.set(key, str(size))


def give_back() -> None:
    """Return to the system what the C library keeps of freed memory; after a fit, a hundred MB that the driver would hold for good."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it, and keeps so much
        pass


def spread(spark: SparkSession, size: int, share: int | None = None) -> None:
    """As many shuffle partitions as so many bytes take, unless the session has more already; adaptive execution joins small ones."""
    key = "spark.sql.shuffle.partitions"
    many = -(-size // (share or SHARE))
    if many > int(spark.conf.get(key)):
        spark.conf.set(key, str(many))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder, in folders by columns if asked, and read it back: lineage ends in files that any executor can read.

    The shuffle files of the write are of no more use then, and go at once instead of with the driver's next garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more: what was made of them has been written."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
