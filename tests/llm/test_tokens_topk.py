import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.llm import token_counts as C
from siltstone.llm import topk as K

from . import brute


def test_counts_against_greedy_matching(spark):
    vocabulary = C.pieces_of()
    rng = random.Random(2)
    texts = ["", None, " \n", "hello unbelievably", "你好é", "a" * 3000, "internationalization's"] + ["".join(rng.choices("abtheionr \nés", k=rng.randint(1, 200))) for _ in range(100)]
    docs = [*enumerate(texts), (3, "again"), (None, "no id")]
    got = C.token_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_tokens"]) for r in got), key=str) == sorted(((i, len(brute.WORD.findall(t or "")), brute.pieces(t, vocabulary)) for i, t in docs), key=str)
    assert C.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_small_vocabulary_with_failures():
    v = {bytes([b]) for b in range(256)} | {b" ab", b"abcd", b"bcde", b"cd", b" abcdx", b"ef", b"efgh"}
    a = C.Automaton(v)
    for w in ("abcde", "abcdx", "bcdef", "abefg", "x", "abcdabcdy", "cdefgcdefgh"):
        data = np.frombuffer(w.encode(), np.uint8)
        assert a.counts(data, np.array([0]), np.array([len(data)]))[0] == brute.pieces(w, v), w


def test_long_words_take_linear_time():
    a = C.Automaton(C.pieces_of())
    word, rng = bytearray(), random.Random(5)
    while len(word) < 1 << 20:
        word += rng.choice([b"abc", b"the", b"unlikely", b"0", b"zz", "é".encode()])
    data = np.frombuffer(bytes(word) + b"short" * 3, np.uint8)
    starts, ends = np.array([0, len(word), len(word) + 5]), np.array([len(word), len(word) + 5, len(word) + 15])
    start = time.time()
    got = a.counts(data, starts, ends)
    assert time.time() - start < 10 and got[0] == brute.pieces(bytes(word).decode(), C.pieces_of())
    few, C.FEW = C.FEW, 0  # all in step
    try:
        part = np.frombuffer(b"unlikelyabcthe" * 200, np.uint8)
        want = [brute.pieces(part[x:y].tobytes().decode(), C.pieces_of()) for x, y in ((0, 2000), (2000, 2800))]
        assert a.counts(part, np.array([0, 2000]), np.array([2000, 2800])).tolist() == want
    finally:
        C.FEW = few


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 9)).round(1)
    v[100:400] = v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1020, [None, 1.0]), (1040, [float("nan")] * 9), (1060, [float("inf")] * 9), (1080, [1.0, 2.0]), (1100, []), (None, [1.0] * 9), (20, [0.5] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).repartition(5)
    q = K.quantized(df)
    have = [(r["vec_id"], np.pad(np.array(r["v"], np.int64), (0, 9 - len(r["v"])))) for r in q.collect()]
    # ids are unique among queries but for 20, of which any row may be asked
    ask = q.where("vec_id % 20 = 0 and vec_id <> 20")
    want = set()
    for i, x in have:
        if i % 20 == 0 and i != 20:
            best = sorted((-int(x @ y), j) for j, y in have if j != i)[:15]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    got = K.top_k(q, ask, k=15, shard=64, block=8).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert K.top_k(q.limit(0), q.limit(0)).count() == 0 and K.top_k(q, q.limit(0)).count() == 0
    assert K.top_k(q.where("vec_id < 3"), q.where("vec_id = 0")).count() == 2


def test_leaves_are_pruned():
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.integers(-5, 5, (2000, 3)) + np.array(c) * 100 for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, -1, -1])])
    s = K.Search(v[:10].astype(np.int64), np.arange(10), 5)
    t = K.tree(v.astype(np.int64), np.arange(len(v)), 100)
    s.add(*t)
    assert s.leaves < 10 * len(t[2]) / 2


def test_arrow_slices():
    from siltstone.llm import _text as X

    col = pa.array(["x", "a b", "", "é  c\n", "zz"])[1:4]
    h, ptr = X.words(col)
    assert list(ptr) == [0, 2, 2, 4] and len(set(h.tolist())) == 4
    assert X.words(pa.array(["b a"]))[0].tolist() == h[:2][::-1].tolist()
    assert list(X.slices(pa.array(["abc"] * 5), 7)) == [(0, 2), (2, 4), (4, 5)]
