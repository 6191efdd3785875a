"""Sources and sinks: directories of files, tables of an archive, extraction."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.blocks import slices

TABLES = ("entries", "chunks", "entry_chunks", "blobs", "pieces")


#: Files of more bytes than this are hashed as a stream; a row with the content takes several times its size of memory.
WHOLE = 64 << 20
_PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"


def _reader(spark: SparkSession, kind: str, pattern: str | None):
    reader = spark.read.format(kind).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", pattern) if pattern else reader


def _relative(root: str):
    scheme = "^[a-z][a-z0-9+.-]*:/+"
    name = F.regexp_replace(F.col("path"), scheme, "/")
    bare = re.sub(scheme, "/", root.rstrip("/"))
    return F.regexp_replace(F.substring(name, len(bare) + 2, 1 << 20), r"\\", "/")


def collect_inputs(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Files below a directory as path (relative), size, mtime, data; of equal names the first by full path.

    Names are compared without contents, which stay in the task that reads them; only names that clash are broadcast.
    """
    found = _reader(spark, "binaryFile", pattern).load(root)
    rows = found.select(_relative(root).alias("name"), "path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("content").alias("data"))
    return _first_files(rows, found, root).select(F.col("name").alias("path"), "size", "mtime", "data")


def _first_files(rows: DataFrame, found: DataFrame, root: str) -> DataFrame:
    """Rows (path: the full one) without those of files whose relative name an earlier file has."""
    names = found.select("path", _relative(root).alias("name"))
    first = names.groupBy("name").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = names.join(first, "name").where("path <> first").select("path")
    return rows.join(F.broadcast(later), "path", "left_anti")


def hashed(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Files below a directory as path (relative), size, h; of equal names the first by full path.

    Larger files are read as pieces between line feeds, packed to blocks and hashed in order, so that memory holds a few
    blocks and the longest piece; those that Spark's text reader would unpack, by their names, are read whole.  Empty
    files are left out, as by all of Spark's readers.
    """
    packed = F.col("path").rlike(_PACKED)
    found = _reader(spark, "binaryFile", pattern).load(root)
    small = found.where((F.col("length") <= WHOLE) | packed).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("h"))
    lines = _reader(spark, "text", pattern).option("lineSep", "\n").load(root)
    # the hidden column has the path as a URI
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^([a-z]+)://(?=/)", "$1:")
    lines = lines.where(F.col("_metadata.file_size") > WHOLE).select(path.alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("data")).where(~packed)
    parts = lines.mapInArrow(_blocks, "path string, size long, start long, seq long, data binary")
    large = parts.repartition("path").sortWithinPartitions("path", "start", "seq").mapInArrow(_digests, "path string, size long, h string")
    return _first_files(small.unionByName(large), found, root).select(_relative(root).alias("path"), "size", "h")


def _blocks(batches: Iterator[pa.RecordBatch], least: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Lines of splits (path, size, start, data) in their order, as blocks with a line feed after each line."""
    now, seq, have, size = None, 0, [], 0

    def done() -> pa.RecordBatch:
        cols = [*([x] for x in now), [seq], [b"".join(have)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["path", "size", "start", "seq", "data"])

    for b in slices(batches):
        for *key, data in zip(*(c.to_pylist() for c in b.columns)):
            if have and (key != now or size >= least):
                yield done()
                seq, have, size = seq + 1, [], 0
            now = key
            have += (data, b"\n")
            size += len(data) + 1
    if have:
        yield done()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files from their blocks in order; a mark of UTF-8 at the start, which the text reader leaves out, and the last line feed go by the size."""
    mark = b"\xef\xbb\xbf"
    now, plain, marked, fed = None, None, None, 0

    def done() -> pa.RecordBatch:
        path, size = now
        if fed - size not in (0, 1, -3, -2):
            raise ValueError(f"{path}: {size} bytes are stated, {fed} came")
        h = plain if fed >= size else marked
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([h.hexdigest()])], ["path", "size", "h"])

    for b in slices(batches):
        for path, size, data in zip(*(b.column(k).to_pylist() for k in (0, 1, 4))):
            if (path, size) != now:
                if now is not None:
                    yield done()
                now, plain, marked, fed = (path, size), hashlib.sha256(), hashlib.sha256(mark), 0
            plain.update(data[: max(0, size - fed)])
            marked.update(data[: max(0, size - 3 - fed)])
            fed += len(data)
    if now is not None:
        yield done()


def first_of_name(inputs: DataFrame, order: str) -> DataFrame:
    """Inputs with each path once, the first in `order`."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("path").orderBy(order))
    return inputs.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def expand(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """Inputs below root that match any of the globs; a glob without a match is an error."""
    every = collect_inputs(spark, root)
    for p in patterns:
        if not every.where(P.glob(F.col("path"), p)).limit(1).count():
            raise FileNotFoundError(p)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | P.glob(F.col("path"), p)
    return every.where(hit)


def rule_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_archive(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of an archive as Parquet, `entries` last: an archive without it is not complete."""
    if unknown := set(tables) - set(TABLES):
        raise ValueError(f"no such table: {sorted(unknown)}")
    for name in sorted(tables, key=lambda n: n == "entries"):
        tables[name].write.option("compression", "zstd").parquet(f"{path}/{name}")


def read_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    out = {"entries": spark.read.parquet(f"{path}/entries")}
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in TABLES[1:]:
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            out[name] = spark.read.parquet(f"{path}/{name}")
    return out


def extraction_conflicts(entries: DataFrame) -> DataFrame:
    """Paths that cannot be written side by side: refused by the path policy, or equal but for case."""
    bad = entries.select("path", P.path_error(F.col("path")).alias("reason")).where("reason is not null")
    twice = entries.groupBy(F.lower("path").alias("low")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")
    return bad.unionByName(twice.select("path", F.lit("case").alias("reason")))


def extract(entries: DataFrame, folder: str, overwrite: bool = False) -> int:
    """Write entries (path, data, h) below a folder that all executors share; views stay out.

    All destinations are checked before the first byte; each file is written aside, its hash checked, then renamed.
    """
    if "derived_from" in entries.columns:
        entries = entries.where("derived_from is null")
    if bad := extraction_conflicts(entries).limit(1).collect():
        raise ValueError(f"{bad[0]['path']}: {bad[0]['reason']}")

    def put(rows) -> None:
        import hashlib
        import os

        for r in rows:
            to = os.path.join(folder, r["path"])
            if hashlib.sha256(bytes(r["data"])).hexdigest() != r["h"]:
                raise ValueError(f"{r['path']}: the content does not match its hash")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            if os.path.exists(to) and not overwrite:
                raise FileExistsError(to)
            part = f"{to}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(r["data"])
            os.replace(part, to)

    wanted = entries.select("path", "data", "h")
    wanted.foreachPartition(put)
    return wanted.count()


def rendered(rows: DataFrame) -> DataFrame:
    """Each row as a JSON document."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))
