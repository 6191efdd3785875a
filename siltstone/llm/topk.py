"""Exact top-k search by inner product: a KD-tree a shard, best-first with box bounds and a propagated kth score.

Vectors are dealt to shards of about `SHARD`; each becomes a KD-tree by median splits along the widest side, with a
tight box at every node.  Queries travel in blocks.  A task takes one block past a group of shards, one after the
other.  In a tree every query of the block keeps a frontier of boxes, opens the one with the highest bound of the inner
product, an inner node into its two halves, a leaf into its vectors, and stops when that bound is below its kth score
so far, which is carried from shard to shard; all queries go in step.  The groups' results, k a query, are then merged.

The result is exact: a leaf is left out only if no vector in it can be among the k.  Ties go to the smaller vec_id.
Work is queries times shards, as the contract asks for every row against a set of queries; neither side is ever
gathered in one place.

Cases: vectors that are null or hold null or non-finite components take no part, as queries or as candidates; shorter
vectors count as having zeros at the end; a null vec_id takes no part; rows that repeat a vec_id are candidates each
(never for a query of their own id) and of repeated queries the least vector is asked; other columns are ignored; fewer than k
candidates give fewer rows; products beyond 64 bits wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import materialize, table, tune

SHARD, LEAF, GROUPS, K = 4096, 256, 8, 20
#: Queries of a block: a 64th of them, within these bounds, for every shard travels once to each block.
LEAST_BLOCK, MOST_BLOCK = 1024, 4096


def tree(v: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors and ids in leaf order; nodes (first and last vector, the two halves or -1); lower and upper corners of their boxes."""
    order, nodes, todo = np.arange(len(v)), [[0, len(v), -1, -1]], [0]
    while todo:
        n = todo.pop()
        lo, hi = nodes[n][:2]
        part = v[order[lo:hi]]
        wide = part.max(0).astype(float) - part.min(0) if hi - lo else np.zeros(1)
        if hi - lo <= leaf or not wide.any():  # equal vectors cannot be split
            continue
        mid = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, wide.argmax()], mid)]
        nodes[n][2:] = len(nodes), len(nodes) + 1
        todo += nodes[n][2:]
        nodes += [[lo, lo + mid, -1, -1], [lo + mid, hi, -1, -1]]
    v, ids, nodes = v[order], ids[order], np.array(nodes, np.int64)
    low, high = np.zeros((len(nodes), v.shape[1]), np.int64), np.zeros((len(nodes), v.shape[1]), np.int64)
    for n in range(len(nodes) - 1, -1, -1):  # halves come after their whole
        lo, hi, a, b = nodes[n]
        low[n] = v[lo:hi].min(0, initial=2**62) if a < 0 else np.minimum(low[a], low[b])
        high[n] = v[lo:hi].max(0, initial=-(2**62)) if a < 0 else np.maximum(high[a], high[b])
    return v, ids, nodes, low, high


class Search:
    """The k best so far of each query of a block."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.ids, self.k = q, ids, k
        self.kth = np.full(len(q), -np.inf)
        self.top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, score, vec_id
        self.pos, self.neg = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
        self.leaves = 0

    def add(self, v: np.ndarray, ids: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        exact = float(np.abs(self.q).max(initial=0)) * float(np.abs(v).max(initial=0)) * v.shape[1] < 2**52
        q, v = (self.q.astype(float), v.astype(float)) if exact else (self.q, v)
        low, high = low.astype(float), high.astype(float)
        every = np.arange(len(q))
        open_ = np.full((len(q), len(nodes)), -np.inf)  # each query's frontier: the bounds of boxes not yet opened

        def found_at(who: np.ndarray, n: int) -> None:
            bound = self.pos[who] @ high[n] + self.neg[who] @ low[n]
            open_[who, n] = bound if exact else bound + np.abs(bound) * 1e-9 + 1

        found_at(every, 0)
        while True:
            best = open_.argmax(1)
            bound = open_[every, best]
            live = np.flatnonzero((bound >= self.kth) & (bound > -np.inf))
            if not len(live):
                return
            found = []
            for n in np.unique(best[live]):
                who = live[best[live] == n]
                open_[who, n] = -np.inf
                lo, hi, *halves = nodes[n]
                if halves[0] >= 0:
                    for half in halves:
                        found_at(who, half)
                    continue
                at = slice(lo, hi)
                score = q[who] @ v[at].T
                good = (score >= self.kth[who][:, None]) & (ids[at][None, :] != self.ids[who][:, None])
                a, b = np.nonzero(good)
                found.append((who[a], score[a, b].astype(np.int64), ids[at][b]))
                self.leaves += len(who)
            if found:
                self._keep(found)

    def _keep(self, found: list) -> None:
        who, score, vec = (np.concatenate(x) for x in zip(self.top, *found))
        order = np.lexsort((vec, -score, who))
        who, score, vec = who[order], score[order], vec[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        best = rank < self.k
        self.top = who[best], score[best], vec[best]
        last = rank == self.k - 1
        self.kth[who[last]] = score[last]


def _payload(with_tree: bool, dims: int, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, vecs = TaskContext.get().partitionId(), [], []
        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            n = np.array([len(x.values) for x in b.column(1)], np.int64)
            v = np.zeros((len(n), dims), np.int64)
            v[np.arange(dims)[None, :] < n[:, None]] = b.column(1).flatten().to_numpy()
            vecs.append(v)
        if not ids or not len(ids := np.concatenate(ids)):
            return
        v = np.concatenate(vecs)
        order = np.argsort(ids, kind="stable")
        v, ids = v[order], ids[order]
        for k, at in enumerate(range(0, len(ids), size)):
            w, i = v[at : at + size], ids[at : at + size]
            small = np.abs(w).max(initial=0) < 2**15
            kind = np.int16 if small else np.int64
            if with_tree:
                w, i, nodes, low, high = tree(w, i)
                cols = [w.astype(kind).tobytes(), i.tobytes(), nodes.tobytes(), low.tobytes(), high.tobytes()]
            else:
                cols = [w.astype(kind).tobytes(), i.tobytes(), b"", b"", b""]
            yield pa.RecordBatch.from_arrays([pa.array([part << 20 | k]), pa.array([bool(small)]), *(pa.array([c], pa.binary()) for c in cols)], ["at", "small", "v", "ids", "nodes", "low", "high"])

    return rows


def _searched(dims: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = search = None

        def done():
            who, score, vec = search.top
            return pa.RecordBatch.from_arrays([pa.array(search.ids[who]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

        for b in batches:
            for r in b.to_pylist():
                v = np.frombuffer(r["v"], np.int16 if r["small"] else np.int64).reshape(-1, dims).astype(np.int64)
                ids = np.frombuffer(r["ids"], np.int64)
                if (r["block"], r["grp"]) != key:
                    if search is not None:
                        yield done()
                    key, search = (r["block"], r["grp"]), None
                if r["kind"] == 0:
                    search = Search(v, ids, k)
                elif search is not None:
                    search.add(v, ids, np.frombuffer(r["nodes"], np.int64).reshape(-1, 4), *(np.frombuffer(r[c], np.int64).reshape(-1, dims) for c in ("low", "high")))
        if search is not None:
            yield done()

    return rows


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int | None = None) -> DataFrame:
    """The k best of vectors for each of queries, both (vec_id, v: array of long): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    tune(spark)
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n, dims = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    m, more = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    dims, block = max(1, dims or 0, more or 0), block or min(max(LEAST_BLOCK, -(-m // 64)), MOST_BLOCK)
    layout = "at long, small boolean, v binary, ids binary, nodes binary, low binary, high binary"
    shards = materialize(vectors.repartition(max(1, -(-n // shard))).mapInArrow(_payload(True, dims, 2 * shard), layout), "shards")
    blocks = materialize(queries.repartition(max(1, -(-m // block))).mapInArrow(_payload(False, dims, 1 << 40), layout), "blocks")
    # a partition made one row of queries, so partition numbers are the blocks' numbers
    n_blocks, groups = max(1, -(-m // block)), max(1, min(GROUPS, -(-n // shard)))
    shards = shards.withColumn("grp", F.expr(f"cast((at div {1 << 20}) % {groups} as int)"))
    blocks = blocks.withColumn("block", F.expr(f"cast(at div {1 << 20} as int)"))
    cols = ["block", "grp", "kind", "at", "small", "v", "ids", "nodes", "low", "high"]
    seq = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = blocks.select("*", seq(groups).alias("grp"), F.lit(0).alias("kind")).select(*cols)
    right = shards.select("*", seq(n_blocks).alias("block"), F.lit(1).alias("kind")).select(*cols)
    met = left.unionByName(right).repartition(n_blocks * groups, "block", "grp").sortWithinPartitions("block", "grp", "kind", "at")
    found = met.mapInArrow(_searched(dims, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def quantized(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v) with floor(scale * x) of each component; rows with a null or non-finite component are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
QUERIES, SQL = {"op3_exact_topk": op3_exact_topk}, {"op3_exact_topk": OP3_SQL}
