"""Best-fit packing by hierarchical residuals: partitions pack locally, nearly full bins leave, underfull bins merge in a tree.

Every document becomes token ids and a closing id 0, cut into pieces of at most `size` ids if it is longer (only the
first piece may then be shorter).  Pieces are dealt to partitions of about `ITEMS` pieces; each is packed best fit,
longest first, into bins of `size`.  Bins with at most `slack` free places, and pieces of full size, are final.  The
rest travel on as single items, `fan` partitions to one, and are packed again, until one partition is left, or a round
has closed less than a hundredth of them: then only bins at most half full meet, in one task.  A task never gets more than some `items` pieces: where more are left they
go to more partitions.  (Two bins that are both over half full never share a sequence, and best fit leaves one bin a
task that is not; so after the first round there is little left to win, and rounds end soon.)

Ids are those of the byte-level tokenizer file, its added tokens in a text included; they come from the same vocabulary
as ranks, through a bounded cache of space-separated words (a pre-token never spans a single space between two
non-spaces, so texts can be cut there).

Cases: null and empty texts are one piece of the closing id; a text of any length is cut whole; rows that repeat an id
are packed each (their pieces bear the same doc_id and piece, and different places); a null id is packed like others;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialize, table, tune

SIZE, ITEMS, FAN, SLACK = 2048, 1 << 17, 8, 8
#: Words of the cache, of at most so many characters each.
CACHE, LONGEST = 300_000, 40
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, final boolean, low boolean"
_SPACES = re.compile(r"\s")


def vocabulary(path: str | None = None):
    """The encoder; path: a file of ranks, by default the public byte-level one."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The added tokens of a tokenizer file, which are cut out of a text before anything else."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Encoder(dict):
    """Little-endian 32-bit ids of texts; as a dict, the cache of words with the space before them.

    path: the ranks; added: tokens beside them, by default those of the public tokenizer file.
    """

    def __init__(self, path: str | None = None, added: dict[str, int] | None = None):
        super().__init__()
        self.encode = vocabulary(path).encode_ordinary
        self.added = added_tokens() if added is None else added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)  # the neighbours matter
        out = self.ids(" " + word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out

    def text(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            return self.plain(text)
        parts = self.cut.split(text)
        return b"".join(np.array([self.added[x]], "<u4").tobytes() if k % 2 else self.plain(x) for k, x in enumerate(parts))

    def plain(self, text: str) -> bytes:
        head, space, rest = text.partition(" ")
        if not space or not head or head[-1].isspace():
            return self.ids(text)
        try:
            return self.ids(head) + b"".join([self[w] for w in rest.split(" ")])
        except KeyError:
            return self.ids(text)


def _piece_rows(size: int, path: str | None, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for doc_id, text in zip(ids, b.column(1)):
                code = encoder.text(text.as_py() or "") + end
                n = len(code) // 4
                many = -(-n // size)
                at = 0
                for k in range(many):
                    to = n - size * (many - 1 - k)
                    out.append((doc_id, k, at, to - at, zlib.crc32(code[4 * at : 4 * to])))
                    at = to
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and offset of each item, and the fill of each bin; longest first, each to the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    room: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit r: there is a bin with r places free
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, k = size, len(fill)
            fill.append(0)
        bins[i], offset[i] = k, size - r
        fill[k] = size - r + n
        r -= n
        if r:
            if not room[r]:
                some ^= 1 << r
            room[r].append(k)
    return bins, offset, np.array(fill, np.int64)


def _level(level: int, size: int, slack: int, last: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        t = t.combine_chunks()
        keys = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        part = TaskContext.get().partitionId()
        if level == 0:
            t = t.sort_by(keys)
            item = np.arange(t.num_rows)
            lengths, within = t["length"].to_numpy(), np.zeros(t.num_rows, np.int64)
        else:
            t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            _, item = np.unique(t["sequence_id"].to_numpy(), return_inverse=True)
            lengths, within = np.bincount(item, weights=t["length"].to_numpy()).astype(np.int64), t["offset"].to_numpy()
        bins, offset, fill = best_fit(lengths, size)
        final = (fill >= size - slack) | last
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        cols = [t[c].combine_chunks() for c in names]
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
        seq = (level << 56) + (part << 30) + bins[item]
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array(seq), pa.array(offset[item] + within), pa.array(final[bins[item]]), pa.array((2 * fill <= size)[bins[item]])],
            [*names, "sequence_id", "offset", "final", "low"],
        )

    return rows


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None, end_id: int = 0) -> DataFrame:
    """The pieces of every document; path: the tokenizer's ranks, on every executor."""
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_piece_rows(size, path, end_id), PIECES)


def pack(found: DataFrame, size: int = SIZE, items: int = ITEMS, fan: int = FAN, slack: int = SLACK) -> DataFrame:
    """Pieces with the sequence and the offset that each gets."""
    found = materialize(found, "pieces")
    short, names = found.where(F.col("length") < size), ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = found.where(F.col("length") == size).select("*", ((F.lit(255 >> 2).cast("long") * F.lit(1 << 56)) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    before = short.count()
    n = max(1, -(-before // items))
    done, rest, level, last = whole.select(*names), short.repartition(n), 0, False
    while True:
        placed = materialize(rest.mapInArrow(_level(level, size, slack, last), PLACED), f"packed{level}")
        done = done.unionByName(placed.where("final").select(*names))
        if last:
            return done
        left = placed.where("not final").count()
        few = n == 1 and level == 0 or level and left > 0.99 * before
        n, level, before = max(-(-n // fan), -(-left // items), 1), level + 1, left
        if few and level == 1:  # all were in one task
            return done.unionByName(placed.where("not final").select(*names))
        if few:  # bins over half full are sequences as they are; at most one a task is not, and these meet in one
            done = done.unionByName(placed.where("not final and not low").select(*names))
            placed, n = placed.where("low").repartition(1), 1
        last = n == 1
        rest = placed.where("not final").repartition(n, "sequence_id") if n > 1 else placed.where("not final").coalesce(1)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))


QUERIES, SQL = {"op6_best_fit_packing": op6_best_fit_packing}, {}
