import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import substring_dedup as S

from . import brute

SCHEMA = "doc_id long, text string"


def rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", [2, 5, 50])
def test_against_brute_force(spark, width):
    rng = random.Random(width)
    word = lambda: rng.choice(["a", "b", "é", "dd", "e" * 30])
    passages = [[word() for _ in range(rng.randint(width - 1, 2 * width))] for _ in range(5)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.5 else [f"{rng.random():.3f}" if rng.random() < 0.3 else word() for _ in range(rng.randint(1, width))]
        docs.append((i * 3, rng.choice([" ", "\n", " \t "]).join(w)))
    docs += [(5, None), (7, ""), (8, " \n "), (None, docs[3][1]), (6, docs[3][1]), (6, docs[3][1]), (6, docs[4][1]), (200, "z " * 5000), (201, "z " * 4000)]
    rng.shuffle(docs)
    assert rows(S.removals(spark.createDataFrame(docs, SCHEMA).repartition(5), width=width)) == sorted(brute.removals(docs, width), key=str)


def test_empty_table_and_texts(spark):
    assert S.removals(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c d", 9), (2, "x a b c", 8)], SCHEMA + ", m long")
    got = {r["doc_id"]: (r["kept_text"], r["m"]) for r in S.remove_substrings(df, width=3).collect()}
    assert got == {1: ("a b c d", 9), 2: ("x", 8)}
    with pytest.raises(ValueError):
        S.remove_substrings(df.withColumn("kept_text", F.lit(1)))


def test_repeated_and_null_ids_keep_their_texts(spark):
    docs = [(1, "p q r s"), (None, "p q r"), (6, "p q r"), (6, "r s t"), (6, "r s t"), (None, None), (7, None)]
    got = sorted(((r["doc_id"], r["text"], r["kept_text"], r["n_removed"]) for r in S.remove_substrings(spark.createDataFrame(docs, SCHEMA), width=3).collect()), key=str)
    assert got == sorted([(1, "p q r s", "p q r s", 0), (None, "p q r", "p q r", 0), (6, "p q r", "", 3), (6, "r s t", "r s t", 0), (6, "r s t", "r s t", 0), (None, None, "", 0), (7, None, "", 0)], key=str)
