"""What the two text classifiers share: a bounded labelled sample, its features on the driver, and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._spark import tune


def held_out(id_col: str, mod: int, rest: int):
    """Whether crc32(id as text) mod `mod` is `rest`; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def sample(rows: DataFrame, most: int) -> DataFrame:
    """At most so many different rows of (doc_id, ...), chosen by a hash of the id, the same whatever the partitioning.

    Of a large table only hashes in the range where some `2 * most` ids are expected are compared and sorted at all, so
    that what meets in one place does not grow with the number of tasks.  Rows that repeat count once.
    """
    n = rows.agg(F.approx_count_distinct("doc_id")).first()[0]
    if n > 4 * most:
        rows = rows.where(F.xxhash64("doc_id") < int(2 * most / n * 2.0**64) - 2**63)
    return rows.dropDuplicates().orderBy(F.xxhash64("doc_id"), *rows.columns).limit(most)


def gather(docs: DataFrame, chosen: DataFrame, kind: Callable, bits: int) -> list[tuple[int, int, np.ndarray]]:
    """(doc_id, label, buckets) of the chosen rows (doc_id, label), bounded by `sample`, in the order of ids.

    Where documents repeat an id, one of them is taken (the least by its buckets), so no more rows come than are chosen.
    """
    tune(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1).fill_null("")
            for lo, hi in X.slices(col):
                idx, ptr = kind(col.slice(lo, hi - lo), bits)
                out = [idx[ptr[i] : ptr[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(out, pa.binary())], ["doc_id", "label", "idx"])

    found = docs.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(rows, "doc_id long, label int, idx binary")
    found = found.groupBy("doc_id", "label").agg(F.min("idx").alias("idx")).toArrow()
    got = zip(found["doc_id"].to_pylist(), found["label"].to_pylist(), (np.frombuffer(x.as_py(), np.int32) for x in found["idx"]))
    return sorted(got, key=lambda x: (x[0], x[1], x[2].tobytes()))


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ptr = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) for x in rows], out=ptr[1:])
    return np.concatenate(rows) if rows else np.zeros(0, np.int32), ptr


def scored(docs: DataFrame, kind: Callable, bits: int, score: Callable, cut: float, held) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; score: of (buckets, where each document's begin)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, out = b.column(2).fill_null(""), [np.zeros(0)]
            for lo, hi in X.slices(col):
                out.append(score(*kind(col.slice(lo, hi - lo), bits)))
            s = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
