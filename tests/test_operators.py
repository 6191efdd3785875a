"""Operators that SQL cannot express, and odd inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.archive import Archive
from siltstone.functions import kernels
from siltstone.functions import paths as P
from siltstone.operators import blocks, dedup, entries, integrity, similarity, transfer, volumes
from siltstone.sources import files
from siltstone.streaming import limits


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(["", "one\ntwo\r\nthree\n", None, "same", "same", "x" * 9000, "éè 你"])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_archive_of_odd_entries(docs):
    a = Archive.of_documents(docs)
    assert a.list().count() == 7
    assert a.verify().first().asDict() == {"entries_total": 7, "entries_ok": 7, "bad": []}
    assert [(r["line"], r["text"]) for r in a.grep("t").collect()] == [(2, "two"), (3, "three")]
    assert a.read("s/en/1.txt", lines=(2, 3)).first()["content"] == "two\nthree"
    assert bytes(a.read("s/en/6.txt", bytes_=(0, 2)).first()["content"]) == "é".encode()
    assert {r["state"] for r in a.diff(a).collect()} == {"unchanged"}
    with pytest.raises(ValueError):
        a.select("s/en/99.txt")
    assert [r["entry_ord"] for r in a.select("s/*/[34].txt", "s/en/1.txt").entries.collect()] == [1, 3, 4]


def test_chunks_make_the_text_again(docs):
    e = entries.from_documents(docs)
    got = dedup.content_chunks(e, (64, 256, 1024), keep_bytes=True).groupBy("entry_ord").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("p"))
    text = {r["entry_ord"]: r["text"] for r in e.collect()}
    assert {r["entry_ord"]: b"".join(bytes(x["data"]) for x in r["p"]).decode() for r in got.collect()} == {k: v for k, v in text.items() if v}


def test_merkle_over_more_than_one_subtree(spark):
    for n in (0, 1, 5, 4096, 4097, 9000):
        rows = spark.range(n).select(F.col("id").alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("h")).repartition(3)
        leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
        assert integrity.merkle_root(rows).first()["root"] == kernels.merkle(leaves, lambda x: hashlib.sha256(x).digest()).hex()


def test_split_lose_repair_join(spark):
    data = {f"a{k}": bytes(range(256)) * k for k in (0, 1, 5)}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "set_id string, payload binary")
    made = volumes.split(df, 3, 2, 100).cache()
    harmed = made.where("not (slot = 0)").withColumn("payload", F.when(F.col("slot") == 1, F.concat("payload", F.lit(b"?"))).otherwise(F.col("payload")))
    out = {r["set_id"]: (bytes(r["payload"]), r["complete"]) for r in volumes.joined(volumes.repaired(harmed, made, 3, 2), 3).collect()}
    assert {k: v for k, (v, _) in out.items()} == data and all(c for _, c in out.values())
    states = volumes.set_status(volumes.piece_states(made.where("slot > 2"), made), 3)
    assert {r["reconstructible"] for r in states.where("set_id = 'a5'").collect()} == {False}
    assert volumes.sidecars(df, 100, 0.0).where("is_parity").count() == 3


def test_blocks_do_not_exceed_their_size(spark):
    rows = [(0, k, s, None) for k, s in enumerate([5, 5, 1, 9, 20, 3])]
    got = blocks.fill_blocks(spark.createDataFrame(rows, "archive_id long, ix long, s long, dict string"), block=10).orderBy("ix")
    assert [r["blob_ix"] for r in got.collect()] == [0, 0, 1, 1, 2, 3]


def test_sealing_needs_the_key(spark):
    df = spark.createDataFrame([(1, 0, 3, bytearray(b"abc"))], "key long, codec int, ulen long, payload binary")
    key = blocks.wrapped_key(b"secret", b"salt")
    sealed = blocks.seal(df, key)
    assert bytes(blocks.unseal(sealed, key).first()["payload"]) == b"abc"
    assert blocks.unseal(sealed, bytes(32)).first()["payload"] is None
    assert blocks.unseal(sealed.withColumn("ulen", F.lit(4)), key).first()["payload"] is None
    with pytest.raises(ValueError):
        blocks.wrapped_key(b"x", b"y", n=1024)


def test_globs_and_paths():
    import re

    assert re.match(P.glob_regex("a*/[!b]?.txt"), "ax/y/cd.txt")
    assert not re.match(P.glob_regex("a.txt"), "abtxt")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"one")
    (tmp_path / "in/sub/b.txt").write_bytes(b"two")
    got = files.collect_inputs(spark, str(tmp_path / "in"))
    assert sorted(r["path"] for r in got.collect()) == ["a.txt", "sub/b.txt"]
    assert files.expand(spark, str(tmp_path / "in"), ["sub/*"]).count() == 1
    with pytest.raises(FileNotFoundError):
        files.expand(spark, str(tmp_path / "in"), ["none*"])
    rows = got.select("path", "data", F.sha2("data", 256).alias("h"))
    assert files.extract(rows, str(tmp_path / "out")) == 2
    assert (tmp_path / "out/sub/b.txt").read_bytes() == b"two"
    with pytest.raises(ValueError):
        files.extract(rows.withColumn("path", F.lit("../x")), str(tmp_path / "out"))
    files.write_archive({"entries": rows}, str(tmp_path / "tables"))
    assert files.read_archive(spark, str(tmp_path / "tables"))["entries"].count() == 2


def test_chain_of_deltas_and_cycles(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (8, 9), (9, 8)], "blob long, base long")
    assert {r["blob"]: r["depth"] for r in integrity.chain_depths(edges).collect()} == {1: 0, 2: 1, 3: 2, 8: -1, 9: -1}


def test_long_names_are_compared_whole(spark):
    new = spark.createDataFrame([(100, "d/" + "n" * 150 + "x.dat"), (101, "n" * 70 + "yz.dat")], "entry_ord long, path string")
    old = spark.createDataFrame([(1, "e/" + "n" * 150 + "y.dat"), (2, "n" * 140 + "z" * 10 + ".dat"), (3, "n" * 66 + "q" * 90 + ".dat"), (4, "n" * 70 + "yq.dat")], "entry_ord long, path string")
    got = {(r["entry_ord"], r["rank"]): (r["old_entry_ord"], r["score"]) for r in similarity.name_candidates(new, old).collect()}
    assert got == {(100, 1): (1, 150), (100, 2): (2, 140), (100, 3): (4, 70), (101, 1): (4, 71), (101, 2): (2, 70), (101, 3): (1, 70)}


def test_token_bucket_batch_and_stream(spark, tmp_path):
    rows = [(k, k % 2, float(t)) for k, t in enumerate([0, 0, 0, 0.1, 0.2, 0.3, 5, 5, 5, 5, 5, 5])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, seconds double")
    want = {r["event_id"]: r["passed"] for r in limits.token_bucket(df, 1.0).collect()}
    assert sum(want.values()) == 8
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.token_bucket_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 1.0)
    q = stream.writeStream.format("memory").queryName("passed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["event_id"]: r["passed"] for r in spark.table("passed").collect()} == want


def test_request_lines(spark):
    df = spark.createDataFrame([("HAVE 1",), ("x" * 256,), ("é",), ("",)], "l string")
    assert [r[0] for r in df.select(transfer.plain_line(F.col("l"))).collect()] == [True, False, False, True]


def test_joins_of_names_are_not_broadcast(spark):
    df = spark.range(50).select(F.col("id").alias("entry_ord"), F.concat(F.lit("name"), "id").alias("path"))
    assert "BroadcastHashJoin" not in similarity.name_candidates(df, df)._jdf.queryExecution().executedPlan().toString()


def test_many_entries_of_one_name_make_no_pairs(spark):
    new = spark.range(3000).select("id", F.lit("d/same.dat").alias("path")).unionByName(spark.createDataFrame([(9000, "d/samey.dat"), (9001, "d/same.dat"), (9001, "d/same.dat"), (9002, None)], "id long, path string")).withColumnRenamed("id", "entry_ord")
    old = spark.range(20_000, 23_000).select(F.col("id").alias("entry_ord"), F.when(F.col("id") == 20_005, "d/same.dat").otherwise("e/same.dat").alias("path"))
    out = similarity.name_candidates(new, old)
    got = {}
    for r in out.collect():
        got.setdefault(r["entry_ord"], []).append((r["rank"], r["old_entry_ord"], r["score"]))
    latest = [(22_999, 8), (22_998, 8)]
    want = [(k, *x) for k, x in enumerate([(20_005, 1 << 30), *latest], 1)]
    assert len(got) == 3002 and all(sorted(got[k]) == want for k in (0, 2999, 9001))
    assert sorted(got[9000]) == [(k, o, 4) for k, o in enumerate((22_999, 22_998, 22_997), 1)]


def test_grep_knows_words_and_line_ends_as_its_sql_does(spark):
    lines = ["ationé", "ation é", "éation", "ation\x0b", "nation  ", "a\u0085tion", "x [\\b] (b"]
    e = entries.from_documents(spark.createDataFrame([(0, "\n".join(lines), "en", "s")], "doc_id long, text string, lang string, source string"))
    found = lambda p, **k: [(r["line"], r["text"]) for r in entries.grep(e, p, **k).collect()]
    assert found(r"ATION\b", ignore_case=True) == [(1, "ationé"), (2, "ation é"), (3, "éation"), (4, "ation\x0b"), (5, "nation  ")]
    assert found(r"\Bation") == [(5, "nation  ")]
    assert found("a.tion$") == [(6, "a\u0085tion")] and found("n$") == [(3, "éation"), (6, "a\u0085tion")]
    assert found(r"\Q(b\E") == found(r"[\\][b]\] [(]b\b") == [(7, "x [\\b] (b")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repair_meets_pieces_without_a_join(spark):
    rng = __import__("random").Random(5)
    data = {f"r{k}": rng.randbytes(n) for k, n in enumerate([0, 1, 255, 256, 257, 1024, 1025, 5000, 70_001])}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "set_id string, payload binary")
    made = volumes.split(df, 4, 2, 256)
    fixed = volumes.repaired(made.where("(stripe + slot) % 3 > 0"), made, 4, 2)
    assert "Join" not in _plan(fixed) and "Exchange" not in _plan(made)
    assert {r["set_id"]: bytes(r["payload"]) for r in volumes.joined(fixed, 4).collect()} == data
    assert fixed.exceptAll(made).count() == 0 and fixed.count() == made.count()
    few = volumes.repaired(made.where("slot > 2"), made, 4, 2)  # too few where three data pieces are gone
    assert few.where("stripe < 3 and set_id = 'r8'").count() == 9
    wrong = made.withColumn("h", F.when((F.col("set_id") == "r5") & (F.col("slot") == 0), F.sha2(F.lit("x"), 256)).otherwise(F.col("h")))
    with pytest.raises(Exception, match="not the expected ones"):
        volumes.repaired(made.where("slot > 1"), wrong, 4, 2).count()


def test_join_copies_each_byte_once(spark):
    df = spark.createDataFrame([("a", bytearray(bytes(range(256)) * 40))], "set_id string, payload binary")
    out = volumes.joined(volumes.split(df, 4, 2, 64), 4)
    assert "concat(" not in _plan(out) and bytes(out.first()["payload"]) == bytes(range(256)) * 40


def test_sidecars_are_cut_in_place_and_matrices_kept(spark):
    df = spark.createDataFrame([(str(n), bytearray(bytes(range(250)) * n)) for n in range(120)], "set_id string, payload binary").coalesce(1)
    out = volumes.sidecars(df, 100, 0.1)
    assert "Exchange" not in _plan(out)
    n = {r["set_id"]: (r["d"], r["p"]) for r in out.groupBy("set_id").agg(F.count_if(~F.col("is_parity")).alias("d"), F.count_if("is_parity").alias("p")).collect()}
    assert n["0"] == (1, 1) and n["4"] == (10, 1) and n["119"] == (298, 20 + 10)
    assert kernels.coding_matrix.cache_parameters()["maxsize"] >= volumes.STRIPE_PIECES


def test_codecs_take_long_batches_in_slices():
    import pyarrow as pa

    texts = [b"x" * n for n in (0, 10, blocks.SLICE // 2, blocks.SLICE // 2, 3 * blocks.SLICE, 5)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["key", "data"])
    got = list(blocks.slices(iter([b])))
    assert [r for s in got for r in s.column(0).to_pylist()] == list(range(len(texts))) and len(got) == 4
    assert max(sum(len(x or b"") for x in s.column(1).to_pylist()) for s in got if s.num_rows > 1) <= blocks.SLICE


def test_large_files_are_hashed_as_streams(spark, tmp_path, monkeypatch):
    import gzip
    import random

    rng, at = random.Random(2), tmp_path / "in put+%20"
    at.mkdir()
    data = {"a": rng.randbytes(300_000), "b": b"\n" * 5000, "c x+y%41": b"no line feed" * 900, "d": b"\xef\xbb\xbfmarked\n" * 700, "e": b"\xef\xbb\xbfmarked" + b"\r\n\0" * 3000, "f.gz": gzip.compress(rng.randbytes(9000)), "h": b"small"}
    for k, v in data.items():
        (at / k).write_bytes(v)
    monkeypatch.setattr(files, "WHOLE", 1000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        for root in (str(at), f"file://{at}/"):
            got = files.hashed(spark, root)
            assert {r["path"]: (r["size"], r["h"]) for r in got.collect()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in data.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    plan = files.collect_inputs(spark, str(at)).select("path", "size", "data")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_deltas_keep_no_compressor_of_a_base(spark):
    before = kernels._compressor.cache_info().currsize
    for k in range(20):
        z = kernels.encode(b"abc" * 50, 5, 9, bytes([k]) * 500)
        assert kernels.decode(z, 5, 150, bytes([k]) * 500) == b"abc" * 50
    assert kernels._compressor.cache_info().currsize == before
    df = spark.createDataFrame([(k, "x" * (blocks.SLICE // 2), "y" * (blocks.SLICE // 2) if k else None) for k in range(4)], "key long, data string, base string")
    assert [bytes(r["data"]) for r in blocks.deltas(df).orderBy("key").collect()] == [b"x" * (blocks.SLICE // 2)] * 4


def test_xz_tables_are_as_large_as_the_content_needs():
    assert [kernels._xz(n, 6)["dict_size"] for n in (0, 5000, 1 << 30)] == [4096, 8192, 8 << 20]
    for codec, level in ((6, 3), (6, 19), (2, 19)):
        for data in (b"", b"x", bytes(range(256)) * 700):
            assert kernels.decode(kernels.encode(data, codec, level), codec, len(data)) == data


def test_compress_gives_rows_in_slices(spark):
    df = spark.range(4).select(F.col("id").alias("key"), F.repeat(F.lit("ab"), blocks.SLICE // 2).alias("data")).coalesce(1)
    out = blocks.compress(df, 3, 2)
    assert {(r["key"], r["ulen"]) for r in out.collect()} == {(k, blocks.SLICE) for k in range(4)}


def test_decompress_takes_slices_of_odd_contents(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "z" * (blocks.SLICE + 1))], "key long, data string")
    assert {r["key"]: len(r["data"]) for r in blocks.decompress(blocks.compress(df, 3, 2)).collect()} == {0: 0, 1: 0, 2: blocks.SLICE + 1}


def test_contents_share_a_compressor():
    made = kernels._compressor.cache_info().misses
    for _ in range(50):
        kernels.encode(b"some text", 1, 7)
    assert kernels._compressor.cache_info().misses <= made + 1


def test_depths_of_long_chains_come_as_a_stream(spark):
    df = spark.range(25_000).select((F.col("id") % 2).alias("archive_id"), F.col("id").alias("ix"), F.when(F.col("id") % 50 > 1, F.when(F.col("id") % 50 == 9, F.col("id") + 2).when(F.col("id") % 50 == 48, F.col("id") - 8).otherwise(F.col("id") - 2)).alias("base"))
    want = {}
    for ix in range(25_000):
        base = None if ix % 50 < 2 else ix + 2 if ix % 50 == 9 else ix - 8 if ix % 50 == 48 else ix - 2
        d = 0 if base is None else want.get(base, 0) + 1
        want[ix] = 0 if d > 6 else d
    out = blocks.delta_depths(df)
    assert {r["ix"]: r["depth"] for r in out.collect()} == want and "FlatMapGroupsInPandas" not in _plan(out)
