"""The archive as an object: every method returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import blocks, dedup, diff, entries, integrity, volumes


class Archive:
    """Entries with text or bytes, and what is derived from them."""

    def __init__(self, rows: DataFrame, name: str = "archive"):
        self.entries, self.name = rows, name

    @classmethod
    def of_documents(cls, docs: DataFrame, name: str = "documents") -> Archive:
        return cls(entries.from_documents(docs), name)

    def list(self) -> DataFrame:
        return entries.listing(self.entries, self.name)

    def stat(self, path: str) -> DataFrame:
        return entries.stat(self.entries, path)

    def select(self, *patterns: str) -> Archive:
        return Archive(entries.select(self.entries, [*patterns]), self.name)

    def grep(self, pattern: str, glob: str | None = None, ignore_case: bool = False, most: int | None = 200) -> DataFrame:
        return entries.grep(self.entries, pattern, glob, ignore_case, most)

    def read(self, path: str, lines: tuple[int, int] | None = None, bytes_: tuple[int, int] | None = None) -> DataFrame:
        one = self.entries.where(F.col("path") == path)
        if lines:
            return entries.read_lines(one, *lines)
        return entries.read_bytes(one, *bytes_) if bytes_ else entries.read_limited(one)

    def chunks(self, profile: str | tuple[int, int, int] = "p2p") -> DataFrame:
        return dedup.content_chunks(self.entries, profile)

    def report(self, profile: str | tuple[int, int, int] = "p2p") -> DataFrame:
        return dedup.report(self.chunks(profile))

    def diff(self, other: Archive) -> DataFrame:
        return diff.by_path(self.entries, other.entries)

    def verify(self) -> DataFrame:
        return integrity.verify_entries(self.entries)

    def merkle_root(self, profile: str | tuple[int, int, int] = "p2p") -> DataFrame:
        from pyspark.sql import Window

        u = dedup.unique_chunks(self.chunks(profile))
        return integrity.merkle_root(u.select((F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("i"), "h"))

    def packed(self, level: int = 9, effort: int = 5) -> DataFrame:
        return blocks.compress(self.entries.select(F.col("entry_ord").alias("key"), F.col("text").alias("data")), level, effort)

    def split(self, data: int, parity: int, piece: int) -> DataFrame:
        whole = self.entries.select(F.col("path").alias("set_id"), F.col("text").cast("binary").alias("payload"))
        return volumes.split(whole, data, parity, piece)
