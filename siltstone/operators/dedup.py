"""Chunks, deduplication and references to other archives."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels


def fixed_pieces(entries: DataFrame, size: int = 512) -> DataFrame:
    """Pieces of `size` characters: entry_ord, seq, h, s (bytes); an empty entry has one empty piece."""
    n = F.greatest(F.length("text"), F.lit(1)) - 1
    cut = entries.select("entry_ord", "text", F.explode(F.sequence(F.lit(0), F.floor(n / size).cast("int"))).alias("seq"))
    piece = F.substring("text", F.col("seq") * size + 1, F.lit(size))
    return cut.select("entry_ord", "seq", F.sha2(piece, 256).alias("h"), F.octet_length(piece).cast("long").alias("s"))


def content_chunks(entries: DataFrame, profile: str | tuple[int, int, int] = "p2p", keep_bytes: bool = False) -> DataFrame:
    """Content-defined chunks of `text` (string or binary): entry_ord, seq, off, s, h, and data if asked for."""
    least, usual, most = kernels.PROFILES[profile] if isinstance(profile, str) else profile
    kernels.check_profile(least, usual, most)
    names = ["entry_ord", "seq", "off", "s", "h"] + ["data"] * keep_bytes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, x in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                data, at, out = x.as_py() or b"", 0, []
                for k, end in enumerate(kernels.cut_points(data, least, usual, most)):
                    part = data[at:end]
                    out.append((key, k, at, end - at, hashlib.sha256(part).hexdigest(), part)[: len(names)])
                    at = end
                if out:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return entries.select("entry_ord", F.col("text").cast("binary")).mapInArrow(rows, "entry_ord long, seq int, off long, s long, h string" + ", data binary" * keep_bytes)


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """Each different chunk once, with its first appearance and how often it comes."""
    return chunks.groupBy("h").agg(F.min("s").alias("s"), F.min(F.struct("entry_ord", "seq")).alias("first"), F.count("*").alias("times"))


def report(chunks: DataFrame) -> DataFrame:
    """Counts and bytes before and after deduplication."""
    u = chunks.groupBy("h").agg(F.count("*").alias("n"), F.sum("s").alias("all"), F.min("s").alias("s"))
    return u.agg(F.sum("n").alias("chunks_total"), F.count("*").alias("chunks_unique"), F.sum("all").alias("logical_bytes"), F.sum("s").alias("unique_bytes"), (F.sum("all") - F.sum("s")).alias("saved_bytes"))


def first_of_each(refs: DataFrame) -> DataFrame:
    """References (ref_ix, h, x, ...): of each hash that is stored (x = 0) the one in the first archive."""
    return refs.where("x = 0").groupBy("h").agg(F.min("ref_ix").alias("ref_ix"))


def against_references(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """Unique chunks with the archive that already stores them, or null."""
    return chunks.join(first_of_each(refs), "h", "left")


def stored_only(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    return chunks.join(refs.where("x = 0"), "h", "left_anti")


def reference_usage(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    met = against_references(chunks, refs).where("ref_ix is not null")
    return met.groupBy("ref_ix").agg(F.count("*").alias("chunks"), F.sum("s").alias("bytes"))


def unresolved(external: DataFrame, refs: DataFrame) -> DataFrame:
    """How many external chunks no reference holds."""
    return external.join(refs.where("x = 0"), "h", "left_anti").agg(F.count("*").alias("unresolved"))
