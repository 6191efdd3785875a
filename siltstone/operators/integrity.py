"""Integrity: Merkle roots, verification, limits and consistency of the index tables.

Constraint checks return the violations, an empty table if all is well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

#: Leaves of a subtree that one row of the next level stands for.
SUBTREE_BITS = 12


def _digest(x: bytes) -> bytes:
    return hashlib.sha256(x).digest()


def merkle_root(leaves: DataFrame) -> DataFrame:
    """The root (hex) over leaves (i from 0, h hex), with subtrees of 4096 leaves built where they lie, level by level."""
    n = leaves.count()
    if not n:
        return leaves.sparkSession.range(1).select(F.lit(_digest(b"").hex()).alias("root"))
    level, first = leaves.select("i", F.unhex("h").alias("h")), True
    while True:
        last, many = n <= 1 << SUBTREE_BITS, n

        def rows(batches: Iterator[pa.RecordBatch], first=first, last=last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for items in b.column(1).to_pylist():
                    nodes = [x["h"] for x in sorted(items, key=lambda x: x["i"])]
                    if first:
                        nodes = [_digest(b"\0" + x) for x in nodes]
                    depth = 0
                    while len(nodes) > 1 or not last and depth < SUBTREE_BITS:
                        nodes = [_digest(b"\1" + nodes[k] + nodes[min(k + 1, len(nodes) - 1)]) for k in range(0, len(nodes), 2)]
                        depth += 1
                    out.append(nodes[0])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["i", "h"])

        grouped = level.groupBy(F.shiftright("i", SUBTREE_BITS).alias("g")).agg(F.collect_list(F.struct("i", "h")).alias("items"))
        level, first, n = grouped.mapInArrow(rows, "i long, h binary"), False, -(-many >> SUBTREE_BITS) if many else 0
        if last:
            return level.select(F.lower(F.hex("h")).alias("root"))


def verify_entries(entries: DataFrame) -> DataFrame:
    """One row: entries, how many are whole, and which are not (h against the text)."""
    good = F.sha2(F.col("text").cast("binary"), 256) == F.col("h")
    return entries.agg(F.count("*").alias("entries_total"), F.count_if(good).alias("entries_ok"), F.sort_array(F.collect_list(F.when(~good, F.col("path")))).alias("bad"))


def over_limits(entries: DataFrame, file_len: int, max_total: int = 4 << 30, max_ratio: int = 1000, ceiling: int = 64 << 30) -> DataFrame:
    """Declared total above its limit, or an expansion (whole number) above the allowed one."""
    sums = entries.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    ratio = F.floor(F.col("total") / file_len)
    reason = F.when(F.col("total") > min(max_total, ceiling), "total").when(ratio > max_ratio, "ratio")
    return sums.select("total", ratio.alias("ratio"), reason.alias("reason")).where("reason is not null")


def running_over(entries: DataFrame, max_entry: int, max_total: int) -> DataFrame:
    """Entries refused while packing in order: too large themselves, or the first to bring the sum over the limit."""
    from pyspark.sql import Window

    # sums of coarse ranges first, so that no window spans the table
    part = F.floor(F.col("entry_ord") / 4096)
    sums = entries.groupBy(part.alias("part")).agg(F.sum("size").alias("part_size"))
    before = sums.select("part", (F.sum("part_size").over(Window.orderBy("part")) - F.col("part_size")).alias("before"))
    own = F.sum("size").over(Window.partitionBy("part").orderBy("entry_ord"))
    run = entries.withColumn("part", part).join(F.broadcast(before), "part").withColumn("running", own + F.col("before"))
    reason = F.when(F.col("size") > max_entry, "entry").when(F.col("running") > max_total, "total")
    return run.select("entry_ord", "size", "running", reason.alias("reason")).where("reason is not null")


def index_violations(blobs: DataFrame, blob_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, key): sizes that do not add up, unknown chunks, chunks in two blobs, stored and external at once, odd hashes."""
    key = lambda c: F.col(c).cast("string").alias("key")
    met = blob_chunks.join(chunks, "chunk_ix", "left")
    sums = met.groupBy("blob_ix").agg(F.sum("s").alias("total")).join(blobs, "blob_ix", "full_outer")
    rules = [
        sums.where(~F.col("total").eqNullSafe(F.col("ulen"))).select(F.lit("size").alias("rule"), key("blob_ix")),
        met.where("h is null").select(F.lit("unknown chunk").alias("rule"), key("chunk_ix")),
        blob_chunks.groupBy("chunk_ix").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("two blobs").alias("rule"), key("chunk_ix")),
        chunks.join(blob_chunks.select("chunk_ix").distinct().withColumn("stored", F.lit(True)), "chunk_ix", "left").where(F.col("x") == F.coalesce("stored", F.lit(False))).select(F.lit("external").alias("rule"), key("chunk_ix")),
        chunks.where(F.length("h") != 64).select(F.lit("hash").alias("rule"), key("chunk_ix")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionAll(r)
    return out


def dictionaries_over(blob_dict: DataFrame, chunks: DataFrame, most: int = 64 << 20) -> DataFrame:
    return blob_dict.join(chunks, "chunk_ix").groupBy("blob_ix").agg(F.sum("s").alias("bytes")).where(F.col("bytes") > most)


def chain_depths(edges: DataFrame, most: int = 16) -> DataFrame:
    """Delta dependencies (blob, base): each blob's depth, or -1 past `most` or in a cycle; one join a level."""
    bases = edges.select("base").distinct()
    live = bases.join(edges.select(F.col("blob").alias("base")).distinct(), "base", "left_anti").select(F.col("base").alias("blob"), F.lit(0).alias("depth"))
    out = live
    for k in range(1, most + 1):
        live = edges.join(live.select(F.col("blob").alias("base")), "base").select("blob").distinct().withColumn("depth", F.lit(k))
        out = out.unionAll(live)
    deep = out.groupBy("blob").agg(F.max("depth").alias("depth"))
    every = edges.select(F.explode(F.array("blob", "base")).alias("blob")).distinct()
    over = edges.join(deep.where(F.col("depth") == most).select(F.col("blob").alias("base")), "base").select("blob").distinct().withColumn("over", F.lit(True))
    return every.join(deep, "blob", "left").join(over, "blob", "left").select("blob", F.when(F.col("over") | F.col("depth").isNull(), -1).otherwise(F.col("depth")).alias("depth"))


def layout_gaps(parts: DataFrame, by: str = "archive") -> DataFrame:
    """Sections (by, off, len) that do not begin where the one before ends."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("off")
    return parts.withColumn("expected", F.lag(F.col("off") + F.col("len"), 1, 0).over(w)).where("off <> expected")


def signing_message(sections: DataFrame) -> DataFrame:
    """The hash over all section rows (ix, t, off, len, h) in order."""
    row = F.concat_ws("|", "ix", "t", "off", "len", "h")
    return sections.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ix", row.alias("r")))), lambda x: x["r"]), "\n"), 256).alias("message"))


def set_id(archive_hash, size, piece_size, data, parity):
    """The identity of a volume set, from the archive and the geometry only."""
    return F.sha2(F.concat_ws("|", F.lit("volume-set"), archive_hash, size, piece_size, data, parity), 256)


def adler32(data):
    """Adler-32 of a binary column."""
    import zlib

    return F.udf(lambda x: zlib.adler32(x or b""), "long")(data)


def nfc(path):
    """A path in composed form."""
    return F.udf(lambda x: None if x is None else kernels.nfc(x), "string")(path)


def section_faults(sections: DataFrame, length: int, by: str = "archive") -> DataFrame:
    """Sections (by, ix, off, len, h, got) out of bounds, over the next one, or with another hash: by, ix, fault."""
    from pyspark.sql import Window

    end = F.col("off") + F.col("len")
    after = F.lead("off").over(Window.partitionBy(by).orderBy("off"))
    fault = F.when(end > length, "bounds").when(end > F.col("next"), "overlap").when(F.col("h") != F.col("got"), "hash")
    return sections.withColumn("next", after).select(by, "ix", fault.alias("fault")).where("fault is not null")


def bases_of(edges: DataFrame, targets: list[int], most: int = 16) -> DataFrame:
    """All blobs that the targets are decoded from, by steps: target, base, step; edges: blob, base."""
    live = edges.where(F.col("blob").isin(targets)).select(F.col("blob").alias("target"), "base", F.lit(1).alias("step"))
    out = live
    for k in range(2, most + 1):
        live = live.select("target", F.col("base").alias("blob")).join(edges, "blob").select("target", "base", F.lit(k).alias("step"))
        out = out.unionAll(live)
    return out
