"""Token counts: greedy longest-match pieces of every word, counted by a linear automaton without building pieces.

The vocabulary trie has a failure link and a number of popped tokens at each node: where the next byte does not go on
from a node, the tokens that greedy matching cuts off the matched bytes are counted at once and matching goes on from
the failure link, so no byte is read twice.  Words are runs of `[^\\x20\\x09-\\x0D]`; each stands as a space and its
bytes: pieces that begin with a space begin words, all others continue them.  The vocabulary holds the space and every
single byte, so every word can be cut.

Each different word of a block of text runs once, all of them in step as numpy arrays; the few longest go on alone.

Cases: null and empty texts have 0 words and 0 tokens; a null id is counted as any other; rows that repeat an id are
counted each; words of any length are read whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._spark import table, tune

_SPREAD, _BITS = 0x9E3779B97F4A7C15, 20
#: So many words and fewer are walked one by one.
FEW = 48


def pieces_of(path: str | None = None) -> set[bytes]:
    """The pieces in a file of ranks, by default the public byte-level one."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(line.split()[0]) for line in f if line.strip()}


class Automaton:
    """START reads a word's space and bytes; GO is the root of pieces that continue a word."""

    START, GO = 0, 1

    def __init__(self, pieces: set[bytes]):
        if missing := [b for b in range(256) if bytes([b]) not in pieces]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        edges: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for p in pieces:
            at = self.START if p[:1] == b" " else self.GO
            for c in p:
                if c not in edges[at]:
                    edges[at][c] = len(edges)
                    edges.append({})
                    ends.append(False)
                at = edges[at][c]
            ends[at] = True
        # a space inside a word cannot occur; as a first byte it always does
        fail, pops = [-1] * len(edges), [0] * len(edges)
        queue = deque([self.START, self.GO])
        while queue:
            u = queue.popleft()
            for c, v in edges[u].items():
                if ends[v]:
                    fail[v], pops[v] = self.GO, 1
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and c not in edges[z]:
                        z, n = fail[z], n + pops[z]
                    fail[v], pops[v] = (edges[z][c], n) if z >= 0 else (-1, 0)
                queue.append(v)
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        self.table = self.links = None  # made where a long word is met
        bits = max(_BITS, len(edges).bit_length() + 2)
        self.shift, self.mask = X.U(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for u, e in enumerate(edges):
            for c, v in e.items():
                key = u << 8 | c
                at = (key * _SPREAD & (1 << 64) - 1) >> 64 - bits
                while self.keys[at] >= 0:
                    at = at + 1 & self.mask
                self.keys[at], self.to[at] = key, v

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where there is none."""
        key = node.astype(np.int64) << 8 | byte
        at = (key.astype(X.U) * X.U(_SPREAD) >> self.shift).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.to[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def walk(self, word: bytes, node: int, count: int) -> tuple[int, int]:
        """The node and the count after some more bytes of one word."""
        if self.table is None:
            some = self.keys >= 0
            self.table = dict(zip(self.keys[some].tolist(), self.to[some].tolist()))
            self.links = self.fail.tolist(), self.pops.tolist()
        to, (fail, pops) = self.table.get, self.links
        for byte in word:
            new = to(node << 8 | byte, -1)
            while new < 0:
                count += pops[node]
                node = fail[node]
                new = to(node << 8 | byte, -1)
            node = new
        return node, count

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each span of bytes, a word without its space."""
        order = np.argsort(starts - ends, kind="stable")  # longest first: the words still being read are a prefix
        starts, size = starts[order], (ends - starts)[order]
        node = np.full(len(starts), self.step(np.array([self.START]), np.array([32]))[0], np.int32)
        count = np.zeros(len(starts), np.int64)
        live = len(starts)
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size[:live], -k, "left"))
            if live <= FEW:  # a step of so few words costs as much as one of hundreds: each is walked by itself
                for i in range(live):
                    node[i], count[i] = self.walk(data[starts[i] + k : starts[i] + size[i]].tobytes(), int(node[i]), int(count[i]))
                break
            byte = data[starts[:live] + k].astype(np.int64)
            now = node[:live]
            new = self.step(now, byte)
            stuck = np.flatnonzero(new < 0)
            while len(stuck):
                count[stuck] += self.pops[now[stuck]]
                now[stuck] = self.fail[now[stuck]]
                new[stuck] = self.step(now[stuck], byte[stuck])
                stuck = stuck[new[stuck] < 0]
            node[:live] = new
        left = np.flatnonzero(node != self.GO)
        while len(left):
            count[left] += self.pops[node[left]]
            node[left] = self.fail[node[left]]
            left = left[node[left] != self.GO]
        out = np.empty(len(count), np.int64)
        out[order] = count
        return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_tokens; path: the vocabulary, on the driver (the automaton is some 15 MB)."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces_of(path)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for b in batches:
            col, n, t = b.column(1).fill_null(""), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in X.slices(col):
                data, o = X.raw(col.slice(lo, hi - lo))
                starts, ends, ptr = X.spans(data, o)
                _, first, back = np.unique(X.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                sums = np.append(0, np.cumsum(automaton.counts(data, starts[first], ends[first])[back])) if len(first) else np.zeros(1, np.int64)
                n.append(np.diff(ptr))
                t.append(sums[ptr[1:]] - sums[ptr[:-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(t))], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, "doc_id long, n_words long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op7_token_counts": op7_token_counts}, {}
