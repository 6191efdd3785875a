"""Exact dedup with DataFrame functions only: two passes of a Bloom filter, then only possibly repeated rows shuffle.

Texts are equal if they are identical after deleting every character of `[\\x20\\x09-\\x0D]`.  Pass one hashes every
normalised text to two cells of a filter and keeps the cells that two or more rows hit, packed into 64-bit words.  Pass
two tests every row against both its cells.  Rows that miss are alone and pass straight through, never shuffled; rows
that hit are grouped by the SHA-256 of the normalised text.  A cell that is full by chance only sends a row the longer
way.  The filter has 16 cells a row at any size: where that is more than `MOST_CELLS`, rows are written in folders by
ranges of hashes, and each range has a filter of its own of at most `MOST_CELLS` / 64 words, and so safe to broadcast.

Of equal texts the one with the most code points in the original text stays, then the smallest doc_id.

Cases: null counts as empty, and empty or blank texts are equal; a null id is larger than any other; rows that repeat
one id are one document, marked alike, though group_size counts them; other columns are kept by `drop_duplicates`
(whose help columns start with `__x_`) and ignored by `duplicate_groups`; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialize, table

CELLS_A_ROW, LEAST_CELLS, MOST_CELLS = 16, 1 << 12, 1 << 26


def normalized(text: Column) -> Column:
    """The text without `[\\x20\\x09-\\x0D]`; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _filter_words(hashed: DataFrame, cells: int) -> DataFrame:
    """(word, bits) of the cells that two or more rows of `__x_h` hit."""
    hits = hashed.select(F.explode(F.array(*_cells(cells))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    return hits.groupBy(F.expr("cell div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("bits"))


def _cells(cells: int) -> list[Column]:
    return [F.pmod(F.col("__x_h"), F.lit(cells)), F.pmod(F.xxhash64(F.col("__x_h")), F.lit(cells))]


def _tested(hashed: DataFrame, rows: int, cells: int | None, most: int) -> DataFrame:
    """hashed, with `__x_h`, and `__x_maybe`: whether another row may have the same text."""
    if cells is None:
        cells = LEAST_CELLS
        while cells < rows * CELLS_A_ROW:
            cells *= 2
    if cells <= most:
        return _range_tested(hashed, cells)
    ranges = cells // most
    found = materialize(hashed.withColumn("__x_range", F.expr(f"cast(pmod(shiftright(__x_h, 32), {ranges}) as int)")), "ranges", ("__x_range",))
    parts = [_range_tested(found.where(F.col("__x_range") == k).drop("__x_range"), most) for k in range(ranges)]
    return reduce(DataFrame.unionByName, parts)


def _range_tested(hashed: DataFrame, cells: int) -> DataFrame:
    words = materialize(_filter_words(hashed.select("__x_h"), cells), "filter")  # read twice here, and by each later query
    for k, cell in enumerate(_cells(cells)):
        side = F.broadcast(words.select(F.col("word").alias(f"__x_w{k}"), F.col("bits").alias(f"__x_b{k}")))
        hashed = hashed.withColumn("__x_c", cell).join(side, F.expr(f"__x_c div 64 = __x_w{k}"), "left")
        hashed = hashed.withColumn(f"__x_m{k}", F.expr(f"coalesce(__x_b{k} & shiftleft(1L, cast(__x_c % 64 as int)), 0L) <> 0")).drop("__x_c", f"__x_w{k}", f"__x_b{k}")
    return hashed.withColumn("__x_maybe", F.expr("__x_m0 and __x_m1")).drop("__x_m0", "__x_m1")


def _winners(rows: DataFrame) -> DataFrame:
    """Of (doc_id, text_sha256, n): a row a text with the id that stays."""
    best = F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), "doc_id")).alias("best")
    return rows.groupBy("text_sha256").agg(best, F.count("*").alias("group_size")).select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None, most: int = MOST_CELLS) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    plain = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("plain"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"))
    # texts are read and normalised once; all that follows reads this table, a small part of them
    slim = materialize(plain.select("doc_id", F.sha2("plain", 256).alias("text_sha256"), F.xxhash64("plain").alias("__x_h"), "n"), "hashes")
    rows = _tested(slim, slim.count(), cells, most)
    alone = rows.where("not __x_maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = rows.where("__x_maybe").select("doc_id", "text_sha256", "n")
    # a table of its own, so that both sides of the join are plain exchanges and AQE can split a large group
    winners = materialize(_winners(maybe), "winners")
    met = maybe.join(winners, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(met)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None, most: int = MOST_CELLS) -> DataFrame:
    """The documents that stay, with all their columns; rows that cannot have a copy are not shuffled."""
    rows = _tested(docs.withColumn("__x_h", F.xxhash64(normalized(F.col(text_col)))), docs.count(), cells, most)
    maybe = rows.where("__x_maybe")
    slim = maybe.select(F.col(id_col).alias("doc_id"), F.sha2(normalized(F.col(text_col)), 256).alias("text_sha256"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"))
    stay = _winners(slim).select(F.col("keep_id").alias("__x_keep"))
    met = maybe.join(stay.distinct(), F.col(id_col).eqNullSafe(F.col("__x_keep")), "left_semi")
    return rows.where("not __x_maybe").unionByName(met).select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
g AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
QUERIES, SQL = {"op4_exact_dedup": op4_exact_dedup}, {"op4_exact_dedup": OP4_SQL}
