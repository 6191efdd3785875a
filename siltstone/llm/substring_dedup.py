"""Substring dedup: passages of `width` words that an earlier document already holds are removed.

Rabin-Karp hashes of every window of `width` words are computed in every document.  A window's *anchor* is the least
hash among its runs of `GRAM` words, so equal windows have equal anchors; consecutive windows with one anchor form a
*block*, whose context is the hash of all the words that its windows cover.

1. Blocks (anchor, context) are counted in Spark.  A block whose context also occurs in a smaller doc_id is settled:
   all its windows are removed.  Whole copies and the inside of shared passages end here, one row a block.
2. The first document of each context whose anchor occurs with another context too (ends of passages) has its single
   windows hashed and counted; those found in a smaller doc_id are removed.  A first occurrence of a window always
   lies in a block that is the first of its context, so nothing is missed.
3. Removed windows merge into maximal intervals of words in the document itself.

Texts move twice between executors, compressed; window hashes only for blocks that step 1 leaves open.  Keys that many
documents share meet in partial aggregates and in joins that AQE can split.

Cases: null or empty texts have no words and stay as they are; texts shorter than a window lose nothing; a row with a
null id loses nothing and is nobody's source; rows that repeat an id are judged each by its own text, and never against
each other; other columns are ignored by `removals` and kept by `remove_substrings`, whose added columns are
`n_words`, `n_removed` and `kept_text` (a ValueError says so if the input has such a name).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._spark import materialize, table, tune

WIDTH = 50
#: Words of an anchor.
GRAM = 12


def _windows(h: np.ndarray, ptr: np.ndarray, width: int) -> np.ndarray:
    """The first words of all windows that lie within one document."""
    size = np.diff(ptr)
    many = np.maximum(size - width + 1, 0)
    return np.arange(many.sum()) + np.repeat(ptr[:-1] - (np.cumsum(many) - many), many)


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for each i; shorter at the end, where no caller looks."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _blocks(h: np.ndarray, ptr: np.ndarray, width: int):
    """Of the words of some documents: window starts, the block of each, and of each block its document, anchor, context."""
    at = _windows(h, ptr, width)
    z = np.zeros(0, np.int64)
    if not len(at):
        return at, z, z, z.view(X.U), z.view(X.U), z.view(X.U), None
    gram = max(1, min(GRAM, width // 2))
    sums, down = X.prefix(h, X.WORDS)
    grams = X.run(sums, down, np.arange(len(h) - gram + 1), np.arange(gram, len(h) + 1))
    anchor = _slide_min(grams, width - gram + 1)[at]
    doc = np.searchsorted(ptr, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    lo, hi = at[first], at[last] + width
    sums2, down2 = X.prefix(X.mix(h ^ X.U(0x5851F42D4C957F2D)), X.WORDS2)
    return at, np.cumsum(new) - 1, doc[first], anchor[first], X.run(sums, down, lo, hi), X.run(sums2, down2, lo, hi), (sums, down, sums2, down2)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=1)
    for b in batches:
        z = [zip_.compress(x.as_buffer()) if x.is_valid else None for x in b.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary()), *b.columns[2:]], ["doc_id", "z", *b.schema.names[2:]])


def _unpack(col: pa.Array) -> list[bytes]:
    un = zstandard.ZstdDecompressor()
    return [un.decompress(x.as_buffer()) if x.is_valid else b"" for x in col]


def _by_bytes(texts: list[bytes], most: int = X.CHUNK) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def _block_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, ids = b.column(1).fill_null(""), b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in X.slices(col):
                _, _, doc, m, c1, c2, _ = _blocks(*X.words(col.slice(lo, hi - lo)), width)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][doc].astype(np.int64)), X.signed(m), X.signed(c1), X.signed(c2)], ["doc_id", "m", "c1", "c2"])

    return rows


def _listed(col: pa.Array, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of lists, nulls as empty lists."""
    part = col.slice(rows.start, rows.stop - rows.start)
    n = np.array([len(x.values) if x.is_valid else 0 for x in part], np.int64)
    return np.repeat(np.arange(len(n)), n), part.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(X.U)


def _of(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    return value ^ X.mix(row.astype(X.U) + X.U(1))


def _window_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = _unpack(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in _by_bytes(texts):
                at, block, doc, _, c1, _, more = _blocks(*X.words(pa.array(texts[lo:hi], pa.binary())), width)
                open_ = np.isin(_of(doc, c1), _of(*_listed(b.column(2), slice(lo, hi))))
                w = open_[block] if len(at) else np.zeros(0, bool)
                if not w.any():
                    continue
                p, (sums, down, sums2, down2) = at[w], more
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][doc[block[w]]].astype(np.int64)), X.signed(X.run(sums, down, p, p + width)), X.signed(X.run(sums2, down2, p, p + width))], ["doc_id", "h1", "h2"]
                )

    return rows


def _kept_rows(width: int, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _unpack(b.column(1))
            n, gone, sha, kept = [], [], [], []
            for lo, hi in _by_bytes(texts):
                settled, single = (_of(*_listed(b.column(k), slice(lo, hi))) for k in (2, 3))
                mask = ptr = None
                if len(settled) or len(single):
                    h, ptr = X.words(pa.array(texts[lo:hi], pa.binary()))
                    at, block, doc, _, c1, _, more = _blocks(h, ptr, width)
                    hit = np.isin(_of(doc, c1), settled)[block]
                    if len(single):
                        hit |= np.isin(_of(doc[block], X.run(more[0], more[1], at, at + width)), single)
                    step = np.zeros(len(h) + 1, np.int64)
                    np.add.at(step, at[hit], 1)
                    np.add.at(step, at[hit] + width, -1)
                    mask = np.cumsum(step[:-1]) > 0
                for i, t in enumerate(texts[lo:hi]):
                    w = t.split()
                    out = mask[ptr[i] : ptr[i + 1]] if mask is not None else None
                    k = b" ".join(w if out is None or not out.any() else compress(w, ~out))
                    n.append(len(w))
                    gone.append(0 if out is None else int(out.sum()))
                    sha.append(hashlib.sha256(k).hexdigest())
                    if with_text:
                        kept.append(k.decode())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.string()), b.column(4)], [*names, "kept_text", "text_key"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and kept_text and text_key (a hash of the text) if asked for."""
    if width < 2:
        raise ValueError("a window has two words at least")
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where("doc_id is not null")
    blocks = materialize(known.mapInArrow(_block_rows(width), "doc_id long, m long, c1 long, c2 long"), "blocks")
    firsts = blocks.groupBy("m", "c1", "c2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = materialize(firsts, "firsts")
    settled = blocks.join(firsts.where("first < last"), ["m", "c1", "c2"]).where("doc_id > first").select("doc_id", F.lit(0).alias("kind"), F.col("c1").alias("h"))
    shared = firsts.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m")
    asked = firsts.join(shared, "m").groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("c1").alias("asked"))
    packed = known.mapInArrow(_pack, "doc_id long, z binary")
    windows = packed.join(asked.hint("shuffle_hash"), "doc_id").mapInArrow(_window_rows(width), "doc_id long, h1 long, h2 long")
    windows = materialize(windows, "windows")
    earlier = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    earlier = materialize(earlier, "earlier")  # both sides of the join are then plain exchanges, which AQE can split
    single = windows.join(earlier, ["h1", "h2"]).where("doc_id > first").select("doc_id", F.lit(1).alias("kind"), F.col("h1").alias("h"))
    gone = settled.unionAll(single).groupBy("doc_id").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("h"))).alias(n) for k, n in enumerate(("settled", "single"))))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, text_key long" * with_text
    whole = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))) if with_text else docs
    both = whole.mapInArrow(_pack, "doc_id long, z binary" + ", text_key long" * with_text).join(gone.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "z", "settled", "single", *["text_key"] * with_text)
    return both.mapInArrow(_kept_rows(width, with_text), out)


def remove_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents, all rows and columns, with their words that stay, joined by one space, as kept_text.

    Results come back by id and text, so rows that repeat an id get what their own text gives, and rows with a null id
    keep all their words.
    """
    if clash := {"n_words", "n_removed", "kept_text"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = removals(docs, id_col, text_col, width, with_text=True).select(F.col("doc_id").alias("__s_id"), F.col("text_key").alias("__s_key"), "n_words", "n_removed", "kept_text")
    kept = kept.dropDuplicates(["__s_id", "__s_key"]).hint("shuffle_hash")
    met = docs.withColumn("__s_key0", key).join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__s_id")) & (F.col("__s_key0") == F.col("__s_key")), "left")
    return met.drop("__s_key0", "__s_id", "__s_key")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE doc_id > f),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS t FROM pos ANTI JOIN hit ON hit.doc_id = pos.doc_id AND hit.p = pos.p GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
QUERIES, SQL = {"op1_substring_dedup": op1_substring_dedup}, {"op1_substring_dedup": OP1_SQL}
