"""Blocks and codecs: offsets, greedy filling, best-of compression."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels

#: Bytes of contents that a worker has in Python's hands at once; a batch of 10,000 long ones is too much.
SLICE = 1 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of some `SLICE` bytes of their binary columns, or one longer row."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + SLICE, "right")))
            yield b.slice(at, end - at)
            at = end



def offsets(parts: DataFrame, by: str, order: str, size: str) -> DataFrame:
    """parts with `off`: the sum of the sizes before within `by`."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("off", F.coalesce(F.sum(size).over(w), F.lit(0)))


def overlapping(parts: DataFrame, start: int, end: int) -> DataFrame:
    """Parts (off, s) that share bytes with the range from start to before end."""
    return parts.where((F.col("off") < end) & (F.col("off") + F.col("s") > start))


def recent_window(chunks: DataFrame, by: str = "archive_id", most: int = 32 << 20) -> DataFrame:
    """Chunks (by, ix, s) that still lie in the last `most` bytes of their archive."""
    w = Window.partitionBy(by).orderBy(F.desc("ix"))
    return chunks.withColumn("after", F.sum("s").over(w)).where(F.col("after") <= most)


def fill_blocks(chunks: DataFrame, by: str = "archive_id", block: int = 1 << 20) -> DataFrame:
    """chunks (by, ix, s, dict) with `blob_ix`: a new block where the next chunk would not fit, or the dictionary changes.

    The state restarts at each cut, so one archive's sizes are walked in order; contents are joined afterwards.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix", kind="stable")
        out, at, room, last = [], -1, -1, object()
        for s, d in zip(pdf["s"], pdf["dict"]):
            if s > room or d != last:
                at, room, last = at + 1, block, d
            room -= s
            out.append(at)
        return pdf.assign(blob_ix=out)[[by, "ix", "s", "blob_ix"]]

    return chunks.select(by, "ix", "s", F.coalesce("dict", F.lit("")).alias("dict")).groupBy(by).applyInPandas(walk, f"{by} long, ix long, s long, blob_ix long")


def delta_depths(chunks: DataFrame, by: str = "archive_id", most: int = 6) -> DataFrame:
    """chunks (by, ix, base: ix of an earlier chunk or null) with `depth` and whether the chain is still short enough to extend."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, depth, size = None, np.zeros(0, np.int64), np.zeros(0, np.int32), 0
        for b in batches:
            out = []
            for key, ix, base in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    now, size = key, 0
                d = 0
                if base is not None:
                    # most chunks have the one before as their base
                    k = size - 1 if size and seen[size - 1] == base else bisect_left(seen, base, 0, size)
                    d = int(depth[k]) + 1 if k < size and seen[k] == base else 1
                d = 0 if d > most else d
                if size == len(seen):
                    seen, depth = np.resize(seen, 2 * size + 1024), np.resize(depth, 2 * size + 1024)
                seen[size], depth[size] = ix, d
                size += 1
                out.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], [by, "ix", "depth"])

    # an archive's rows come in order as a stream: of the earlier ones only 12 bytes each stay
    ordered = chunks.select(F.col(by).cast("long").alias(by), F.col("ix").cast("long").alias("ix"), F.col("base").cast("long").alias("base")).repartition(by).sortWithinPartitions(by, "ix", F.desc("base"))
    return ordered.mapInArrow(rows, f"{by} long, ix long, depth int")


def compress(parts: DataFrame, level: int = 19, effort: int = 5) -> DataFrame:
    """parts (key, data) as key, codec, clen, ulen, payload: the shortest of the codecs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [kernels.best(x.as_py() or b"", level, effort) for x in b.column(1)]
            size = [len(x.as_py() or b"") for x in b.column(1)]
            cols = [b.column(0), pa.array([c for c, _ in out], pa.int32()), pa.array([len(z) for _, z in out], pa.int64()), pa.array(size, pa.int64()), pa.array([z for _, z in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "codec", "clen", "ulen", "payload"])

    return parts.select("key", F.col("data").cast("binary")).mapInArrow(rows, "key long, codec int, clen long, ulen long, payload binary")


def decompress(blobs: DataFrame) -> DataFrame:
    """(key, data) of blobs (key, codec, ulen, payload); a size that is not the stated one is an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data = [kernels.decode(z, c, n) for c, n, z in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["key", "data"])

    return blobs.select("key", "codec", "ulen", "payload").mapInArrow(rows, "key long, data binary")


def recoded(parts: DataFrame, codec: int, level: int = 9, dictionary: bytes = b"") -> DataFrame:
    """parts (key, data) through one codec and back: key, clen, data; dictionary: for the codecs that take one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data = [x.as_py() or b"" for x in b.column(1)]
            packed = [kernels.encode(x, codec, level, dictionary) for x in data]
            back = [kernels.decode(z, codec, len(x), dictionary) for x, z in zip(data, packed)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(z) for z in packed], pa.int64()), pa.array(back, pa.binary())], ["key", "clen", "data"])

    return parts.select("key", F.col("data").cast("binary")).mapInArrow(rows, "key long, clen long, data binary")


def deltas(pairs: DataFrame, level: int = 9) -> DataFrame:
    """pairs (key, data, base) with the data coded against its base as a prefix, and back: key, clen, alone, data."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for x, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                z, alone = kernels.encode(x or b"", 5 if d else 1, level, d or b""), len(kernels.encode(x or b"", 1, level))
                out.append((len(z), alone, kernels.decode(z, 5 if d else 1, len(x or b""), d or b"")))
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, kinds))], ["key", "clen", "alone", "data"])

    return pairs.select("key", F.col("data").cast("binary"), F.col("base").cast("binary")).mapInArrow(rows, "key long, clen long, alone long, data binary")


def best_of(trials: DataFrame) -> DataFrame:
    """Of trials (key, codec, try_order, clen, ulen) the shortest, the first of equals, stored as it is if none is shorter."""
    best = trials.groupBy("key").agg(F.min_by(F.struct("codec", "clen"), F.struct("clen", "try_order")).alias("b"), F.first("ulen").alias("ulen"))
    small = F.col("b.clen") < F.col("ulen")
    return best.select("key", F.when(small, F.col("b.codec")).otherwise("store").alias("codec"), F.least("b.clen", "ulen").alias("clen"))


def seal(blobs: DataFrame, key: bytes, label: str = "blob") -> DataFrame:
    """AES-256-GCM over payloads: the nonce from label and index, codec, size and first chunk as bound data."""
    iv = F.unhex(F.substring(F.sha2(F.concat_ws("|", F.lit(key.hex()), F.lit(label), "key"), 256), 1, 24))
    aad = F.concat_ws("|", "codec", "ulen")
    return blobs.withColumn("payload", F.aes_encrypt("payload", F.lit(key), F.lit("GCM"), F.lit("NONE"), iv, aad))


def unseal(blobs: DataFrame, key: bytes) -> DataFrame:
    """The payloads again; null where key, payload or bound data is not what it was."""
    return blobs.withColumn("payload", F.try_aes_decrypt("payload", F.lit(key), F.lit("GCM"), F.lit("NONE"), F.concat_ws("|", "codec", "ulen")))


def wrapped_key(secret: bytes, salt: bytes, n: int = 1 << 14, r: int = 8, p: int = 1) -> bytes:
    """A 256-bit key from a passphrase by scrypt; weaker parameters than these are refused."""
    import hashlib

    if n < 1 << 14 or r < 8 or p < 1:
        raise ValueError("the key derivation needs n >= 16384, r >= 8 and p >= 1")
    return hashlib.scrypt(secret, salt=salt, n=n, r=r, p=p, dklen=32, maxmem=128 * n * r * 2)
