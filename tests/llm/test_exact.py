import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup as X

DOCS = [(1, "a b"), (2, "ab "), (3, "a\tb\n"), (4, None), (5, ""), (6, " "), (7, "x"), (8, "X"), (9, "a b"), (10, "l" * 50000), (11, "l " * 50000), (12, "y"), (12, "y"), (None, "x")]


def want(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    best = {k: (min(v)[3], len(v)) for k, v in groups.items()}
    return sorted(((i, *best[re.sub(r"[\x20\x09-\x0D]", "", t or "")]) for i, t in docs), key=str)


@pytest.mark.parametrize("cells", [None, 2, 64])
def test_groups(spark, cells):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    got = X.duplicate_groups(df, cells=cells).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == want(DOCS)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_kept_rows_have_all_columns(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("kept", F.lit(3)).withColumn("word", F.lit("w"))
    got = X.drop_duplicates(df)
    assert got.columns == df.columns
    # rows that repeat one id are one document
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([*{w[1] for w in want(DOCS)}, 12], key=str)


def test_ranges_with_filters_of_their_own(spark):
    docs = [(i, f"text {i // 3 if i % 2 else i}") for i in range(200)] + DOCS
    docs = [(i if i is None else i + 1000 * (k >= 200), t) for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = X.duplicate_groups(df, most=1 << 10).collect()  # 4 ranges
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == want(docs)
    left = X.drop_duplicates(df.withColumn("m", F.lit(1)), most=1 << 10)
    assert left.columns == ["doc_id", "text", "m"] and {r["doc_id"] for r in left.collect()} == {w[1] for w in want(docs)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert X.duplicate_groups(df).count() == 0 and X.drop_duplicates(df).count() == 0
