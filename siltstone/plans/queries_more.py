"""More queries: sources, sinks, containers, codecs, views and transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import paths as P
from ..functions import text as T
from ..operators import blocks, dedup, entries, integrity, similarity, transfer, volumes
from ..sources import files
from ..streaming import limits
from .queries import C_SQL, E_SQL, V_SQL, W_SQL, _c, _e, _pieces, _sets, _t, query

# --- sources ----------------------------------------------------------------------------------------------------


@query(E_SQL + " SELECT entry_ord, path FROM e WHERE path LIKE 'src1/%' OR path LIKE '%/fr/_5.txt'")
def s2_expand_inputs(spark, d):
    hit = P.glob(F.col("path"), "src1/*") | P.glob(F.col("path"), "*/fr/?5.txt")
    return _e(spark, d).where(hit).select("entry_ord", "path")


@query()
def s3_file_scan(spark, d):
    return files.hashed(spark, d)


@query(E_SQL + " SELECT entry_ord, h FROM e WHERE size <= 67108864")
def s4_whole_file_scan(spark, d):
    return _e(spark, d).where(F.col("size") <= 64 << 20).select("entry_ord", F.sha2(F.col("text").cast("binary"), 256).alias("h"))


_SECTIONS = """WITH s AS (SELECT o_custkey AS archive, o_orderkey AS ix, o_orderkey * 10 AS off, CASE WHEN o_orderkey % 13 = 0 THEN 200 ELSE 10 END AS len, o_orderkey % 9 = 0 AS torn FROM orders),
n AS (SELECT *, lead(off) OVER (PARTITION BY archive ORDER BY off) AS next FROM s)"""


@query(_SECTIONS + " SELECT archive, ix, CASE WHEN off + len > 149900 THEN 'bounds' WHEN off + len > next THEN 'overlap' ELSE 'hash' END AS fault FROM n WHERE off + len > 149900 OR off + len > next OR torn")
def s5_framing(spark, d):
    k = F.col("o_orderkey")
    s = _t(spark, d, "orders").select(F.col("o_custkey").alias("archive"), k.alias("ix"), (k * 10).alias("off"), F.when(k % 13 == 0, 200).otherwise(10).alias("len"), F.sha2(k.cast("string"), 256).alias("h"), F.sha2(F.concat(k.cast("string"), F.when(k % 9 == 0, "x").otherwise("")), 256).alias("got"))
    return integrity.section_faults(s, 149900)


@query(E_SQL + " SELECT split_part(path, '/', 1) AS archive, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM e GROUP BY ALL")
def s6_inspect(spark, d):
    return _e(spark, d).groupBy(F.substring_index("path", "/", 1).alias("archive")).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


@query(C_SQL + " SELECT 'entries' AS what, count(*) AS n FROM e UNION ALL SELECT 'chunks', count(DISTINCT h) FROM c UNION ALL SELECT 'torn entries', count(*) FROM e LEFT JOIN (SELECT entry_ord, sum(s) AS t FROM c GROUP BY entry_ord) USING (entry_ord) WHERE t IS DISTINCT FROM size")
def s7_open_archive(spark, d):
    e, c = _e(spark, d), _c(spark, d)
    torn = e.join(c.groupBy("entry_ord").agg(F.sum("s").alias("t")), "entry_ord", "left").where("not (t <=> size)")
    one = lambda df, what, n=F.count("*"): df.agg(n.alias("n")).select(F.lit(what).alias("what"), "n")
    return one(e, "entries").unionAll(one(c, "chunks", F.countDistinct("h"))).unionAll(one(torn, "torn entries"))


@query(V_SQL + " SELECT set_id, stripe, count(*) FILTER (NOT is_parity) AS k, count(*) FILTER (is_parity) AS m FROM p GROUP BY ALL HAVING count(*) FILTER (NOT is_parity) < 5 OR count(*) FILTER (is_parity) < 2")
def s9_stripe_table(spark, d):
    _, expected = _pieces(spark, d)
    g = expected.groupBy("set_id", "stripe").agg(F.count_if(~F.col("is_parity")).alias("k"), F.count_if("is_parity").alias("m"))
    return g.where("k < 5 or m < 2")


@query("SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 6 END IS NOT NULL AS by_header, s_suppkey % 6 AS ix FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 10 = 0")
def s10_probe(spark, d):
    k = F.col("s_suppkey")
    seen = _t(spark, d, "supplier").select(k.alias("ord"), F.when(k % 5 != 0, k % 6).alias("header_ix"), F.when(k % 2 == 0, k % 6).alias("trailer_ix"))
    return seen.select("ord", F.col("header_ix").isNotNull().alias("by_header"), F.coalesce("header_ix", "trailer_ix").alias("ix")).where("ix is not null")


def _zips(spark, d):
    def pack(text):
        import io
        import zipfile

        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as z:
            z.writestr("member.txt", text, zipfile.ZIP_DEFLATED)
            z.writestr("stored.bin", text[:10])
        return f.getvalue()

    return _e(spark, d).select(F.col("path"), F.when(F.col("entry_ord") % 10 == 0, F.col("text").cast("binary")).otherwise(F.udf(pack, "binary")("text")).alias("data"))


_ZIP_SQL = E_SQL + " SELECT path, 'zip' AS mode, 'member.txt' AS name, h FROM e WHERE entry_ord % 10 <> 0 UNION ALL SELECT path, 'zip', 'stored.bin', sha256(left(text, 10)) FROM e WHERE entry_ord % 10 <> 0 UNION ALL SELECT path, 'raw', NULL, h FROM e WHERE entry_ord % 10 = 0"


@query(_ZIP_SQL)
def s11_explode_zip(spark, d):
    return volumes.exploded_containers(_zips(spark, d)).select("path", "mode", "name", F.sha2("content", 256).alias("h"))


@query(E_SQL + " SELECT path, h FROM e")
def s12_explode_streams(spark, d):
    import zlib

    made = F.udf(lambda t: b"1 0 obj\nstream\n" + zlib.compress(t.encode()) + b"\nendstream\nend", "binary")
    plain = F.udf(lambda b: next(x for _, k, x in kernels.pdf_streams(b) if k), "binary")
    return _e(spark, d).select("path", F.sha2(plain(made("text")), 256).alias("h"))


@query("SELECT s_suppkey % 20 AS peer, count(DISTINCT s_suppkey % 7) AS volumes FROM supplier GROUP BY ALL")
def s14_peer_have(spark, d):
    return _t(spark, d, "supplier").groupBy((F.col("s_suppkey") % 20).alias("peer")).agg(F.countDistinct(F.col("s_suppkey") % 7).alias("volumes"))


# --- sinks ------------------------------------------------------------------------------------------------------


@query("SELECT path, reason FROM (SELECT 'Dir' || (s_suppkey % 40) || '/' || CASE WHEN s_suppkey % 3 = 0 THEN 'READ' ELSE 'read' END AS path, 'case' AS reason, lower('Dir' || (s_suppkey % 40) || '/read') AS low FROM supplier) GROUP BY low, reason, path HAVING FALSE UNION ALL SELECT min(path), 'case' FROM (SELECT 'Dir' || (s_suppkey % 40) || '/' || CASE WHEN s_suppkey % 3 = 0 THEN 'READ' ELSE 'read' END AS path FROM supplier) GROUP BY lower(path) HAVING count(*) > 1")
def k3_extraction_conflicts(spark, d):
    name = F.concat(F.lit("Dir"), F.col("s_suppkey") % 40, F.when(F.col("s_suppkey") % 3 == 0, "/READ").otherwise("/read"))
    return files.extraction_conflicts(_t(spark, d, "supplier").select(name.alias("path")))


@query(E_SQL + " SELECT entry_ord, h, size FROM e WHERE size > 0")
def k4_stream_entry(spark, d):
    c = dedup.content_chunks(_e(spark, d), (256, 1024, 8192), keep_bytes=True)
    parts = c.groupBy("entry_ord").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("p"))
    data = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.data))")
    return parts.select("entry_ord", F.sha2(data, 256).alias("h"), F.octet_length(data).cast("long").alias("size"))


@query(E_SQL + ", n AS (SELECT path, greatest((size + 99) // 100, 1) AS n FROM e) SELECT path AS set_id, CAST(n AS BIGINT) AS data_pieces, CAST(sum(greatest(1, CAST(floor(least(200, n - s * 200) * 0.1 + 0.5) AS BIGINT))) AS BIGINT) AS parity_pieces FROM (SELECT path, n, unnest(range(0, (n + 199) // 200)) AS s FROM n) GROUP BY ALL")
def k5_sidecars(spark, d):
    whole = _e(spark, d).select(F.col("path").alias("set_id"), F.col("text").cast("binary").alias("payload"))
    return volumes.sidecars(whole, 100, 0.1).groupBy("set_id").agg(F.count_if(~F.col("is_parity")).alias("data_pieces"), F.count_if("is_parity").alias("parity_pieces"))


@query(E_SQL + ", n AS (SELECT path, greatest((size + 255) // 256, 1) AS n FROM e) SELECT path AS set_id, CAST(n AS BIGINT) AS data_pieces, CAST((n + 3) // 4 * 2 AS BIGINT) AS parity_pieces, CAST((n + 3) // 4 AS BIGINT) AS stripes FROM n")
def k6_split_geometry(spark, d):
    whole = _e(spark, d).select(F.col("path").alias("set_id"), F.col("text").cast("binary").alias("payload"))
    g = volumes.split(whole, 4, 2, 256).groupBy("set_id")
    return g.agg(F.count_if(~F.col("is_parity")).alias("data_pieces"), F.count_if("is_parity").alias("parity_pieces"), F.countDistinct("stripe").alias("stripes"))


@query(E_SQL + ", n AS (SELECT path, greatest((size + 255) // 256, 1) AS n FROM e) SELECT path AS set_id, CAST(n + (n + 3) // 4 * 2 AS BIGINT) AS whole FROM n")
def k8_repair_volumes(spark, d):
    whole = _e(spark, d).select(F.col("path").alias("set_id"), F.col("text").cast("binary").alias("payload"))
    made = volumes.split(whole, 4, 2, 256)
    fixed = volumes.repaired(made.where("slot > 1"), made, 4, 2)
    return fixed.where(F.sha2("payload", 256) == F.col("h")).groupBy("set_id").agg(F.count("*").alias("whole"))


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def k10_json(spark, d):
    return files.rendered(_t(spark, d, "nation").select("n_nationkey", "n_name"))


@query("SELECT n_nationkey, base64(encode(n_name)) AS content FROM nation")
def k11_base64(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", F.base64(F.col("n_name").cast("binary")).alias("content"))


@query(E_SQL + " SELECT path, CASE WHEN entry_ord % 10 = 0 THEN 'raw' ELSE 'zip' END AS mode, TRUE AS same FROM e")
def k12_rebuild_or_keep(spark, d):
    def same(data):
        mode, members, _ = kernels.exploded(data)
        return {"mode": mode, "same": mode == "raw" or kernels.zip_rebuilt(data, members) == data}

    return _zips(spark, d).select("path", F.udf(same, "mode string, same boolean")("data").alias("r")).select("path", "r.mode", "r.same")


# --- filters, joins, windows ------------------------------------------------------------------------------------


@query()
def f19_machine_code(spark, d):
    x86, arm = F.udf(kernels.looks_like_x86, "boolean"), F.udf(kernels.arm64_alignment, "int")
    data = F.when(F.col("entry_ord") % 2 == 0, F.unhex(F.repeat(F.lit("E810000000900000"), 1024))).otherwise(F.col("text").cast("binary"))
    return _e(spark, d).select("entry_ord", x86(data).alias("x86"), arm(data).alias("arm64"))


@query("SELECT p_partkey, p_size * 1024 >= 16384 AND p_size % 10 >= 8 AS enough FROM part")
def f26_key_derivation_floor(spark, d):
    return _t(spark, d, "part").select("p_partkey", ((F.col("p_size") * 1024 >= 16384) & (F.col("p_size") % 10 >= 8)).alias("enough"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS blob, o_orderkey // 3 AS base FROM orders WHERE o_orderkey > 2),
r AS (SELECT blob AS target, blob, base, 1 AS step FROM e WHERE blob IN (2999, 1234, 5) UNION ALL SELECT r.target, e.blob, e.base, step + 1 FROM r JOIN e ON e.blob = r.base) SELECT target, base, step FROM r""")
def j10_delta_traversal(spark, d):
    edges = _t(spark, d, "orders").where("o_orderkey > 2").select(F.col("o_orderkey").alias("blob"), F.expr("o_orderkey div 3").alias("base"))
    return integrity.bases_of(edges, [2999, 1234, 5])


@query(E_SQL + " SELECT path || '.md' AS view FROM e WHERE path LIKE 'src3/en/%' AND entry_ord % 4 = 3")
def j18_views_of(spark, d):
    v = _e(spark, d).where("entry_ord % 4 = 3").select(F.concat("path", F.lit(".md")).alias("view"), F.col("path").alias("derived_from"))
    return v.where(F.col("derived_from").startswith("src3/en/")).select("view")


@query("""WITH n AS (SELECT p_partkey AS k, p_name AS x FROM part WHERE p_size > 25), o AS (SELECT p_partkey AS ok, p_name AS y FROM part WHERE p_size <= 25)
SELECT k AS entry_ord, ok AS best FROM (SELECT k, ok, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN x = y THEN 1073741824 ELSE lcp END DESC, ok DESC) AS r FROM (SELECT *, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: left(x, i) = left(y, i))) AS lcp FROM n JOIN o ON left(x, 3) = left(y, 3)) WHERE lcp >= 3 AND lcp * 2 >= least(length(x), length(y))) WHERE r = 1""")
def w6_best_candidate(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("entry_ord"), F.col("p_name").alias("path"), "p_size")
    return similarity.name_candidates(p.where("p_size > 25"), p.where("p_size <= 25"), 1).select("entry_ord", F.col("old_entry_ord").alias("best"))


@query(E_SQL + """, l AS (SELECT entry_ord, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS v FROM e WHERE text <> '')
SELECT entry_ord, len(v) AS lines FROM l""")
def w10_line_numbers(spark, d):
    lines = _e(spark, d).select("entry_ord", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return lines.groupBy("entry_ord").agg((F.max("pos") + 1).cast("long").alias("lines"))


@query("SELECT s_suppkey, s_suppkey % 4 AS output FROM supplier")
def w13_round_robin(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", F.pmod("s_suppkey", F.lit(4)).cast("long").alias("output"))


@query(E_SQL + " SELECT path, min(entry_ord) AS entry_ord FROM e GROUP BY path ORDER BY path")
def o1_sorted_inputs(spark, d):
    return files.first_of_name(_e(spark, d).select("path", "entry_ord"), "entry_ord").orderBy("path")


@query(C_SQL + " SELECT entry_ord, seq, s FROM c QUALIFY row_number() OVER (PARTITION BY entry_ord ORDER BY s DESC, seq) <= 3")
def o4_top_three(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("entry_ord").orderBy(F.desc("s"), "seq"))
    return _c(spark, d).withColumn("rank", rank).where("rank <= 3").select("entry_ord", "seq", "s")


@query(E_SQL + " SELECT DISTINCT entry_ord, path FROM e WHERE path LIKE 'src4/%' OR path LIKE '%/es/%' ORDER BY entry_ord")
def o6_selection_order(spark, d):
    return entries.select(_e(spark, d), ["src4/*", "*/es/*"]).select("entry_ord", "path")


@query("SELECT DISTINCT s_suppkey % 50 AS set_id FROM supplier ORDER BY 1")
def o7_listing_order(spark, d):
    return transfer.served(_t(spark, d, "supplier").select((F.col("s_suppkey") % 50).alias("set_id"), (F.col("s_suppkey") % 7).alias("ix"))).select("set_id").orderBy("set_id")


@query("SELECT h, min(r) AS ref_ix FROM (SELECT sha256(coalesce(text, '')) AS h, 0 AS r FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT sha256(coalesce(text, '')), 1 FROM documents WHERE doc_id % 3 = 0) GROUP BY h")
def u6_union_of_references(spark, d):
    e = _e(spark, d)
    a, b = e.where("entry_ord % 2 = 0").select("h", F.lit(0).alias("ref_ix"), F.lit(0).alias("x")), e.where("entry_ord % 3 = 0").select("h", F.lit(1).alias("ref_ix"), F.lit(0).alias("x"))
    return dedup.first_of_each(a.unionByName(b))


# --- codecs and views -------------------------------------------------------------------------------------------

_ROUND = E_SQL + " SELECT entry_ord AS key, h FROM e"


def _some(spark, d):
    return _e(spark, d).select(F.col("entry_ord").alias("key"), F.col("text").alias("data"))


def _back(df):
    return df.select("key", F.sha2("data", 256).alias("h"))


@query(E_SQL + " SELECT entry_ord, h FROM e")
def b2_content_hash(spark, d):
    return _e(spark, d).select("entry_ord", F.sha2(F.col("text").cast("binary"), 256).alias("h"))


@query(_ROUND)
def b3_zstd(spark, d):
    return _back(blocks.recoded(_some(spark, d), 1))


@query(_ROUND)
def b4_xz(spark, d):
    return _back(blocks.recoded(_some(spark, d), 2, 3))


@query(_ROUND)
def b5_bz2(spark, d):
    return _back(blocks.recoded(_some(spark, d), 3))


@query(_ROUND)
def b6_zstd_dictionary(spark, d):
    # a bounded sample: 64 entries of at most 8 KiB each
    sample = [bytes(r[0]) for r in _some(spark, d).orderBy("key").limit(64).select(F.substring(F.col("data").cast("binary"), 1, 8192)).collect()]
    return _back(blocks.recoded(_some(spark, d), 4, 9, kernels.train_dictionary(sample, 16 << 10) or b"dictionary" * 100))


@query(_ROUND)
def b7_delta(spark, d):
    one = _some(spark, d)
    base = one.select((F.col("key") + 1).alias("key"), F.col("data").alias("base"))
    return _back(blocks.deltas(one.join(base, "key", "left")))


@query(_ROUND)
def b8_x86_filter(spark, d):
    return _back(blocks.recoded(_some(spark, d), 6, 3))


@query()
def b12_key_wrap(spark, d):
    key = blocks.wrapped_key(b"passphrase", b"a salt of sixteen")
    one = spark.createDataFrame([(1, 0, 32, bytearray(range(32)))], "key long, codec int, ulen long, payload binary")
    return blocks.unseal(blocks.seal(one, key, "key"), key).select("key", F.hex("payload").alias("secret"))


@query(E_SQL + " SELECT path, '## ' || entry_ord || chr(10) || chr(10) || 'end' || chr(10) AS text FROM e")
def b15_docx_view(spark, d):
    def doc(n):
        import io
        import zipfile

        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as z:
            z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>{n}</w:t></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>')
        return f.getvalue()

    made = _e(spark, d).select(F.concat("path", F.lit(".docx")).alias("path"), F.udf(doc, "binary")("entry_ord").alias("data"))
    return volumes.views(made).select(F.regexp_replace("path", r"\.docx$", "").alias("path"), "text")


@query(E_SQL + " SELECT path, '<!-- page 1 -->' || chr(10) || 'Page ' || entry_ord AS text FROM e")
def b16_pdf_view(spark, d):
    import zlib

    made = F.udf(lambda n: b"1 0 obj\nstream\n" + zlib.compress(f"BT (Page {n}) Tj ET".encode()) + b"\nendstream", "binary")
    pdf = _e(spark, d).select(F.concat("path", F.lit(".pdf")).alias("path"), made("entry_ord").alias("data"))
    return volumes.views(pdf).select(F.regexp_replace("path", r"\.pdf$", "").alias("path"), "text")


@query(E_SQL + " SELECT entry_ord, text || chr(65533) AS text FROM e")
def b17_text_view(spark, d):
    torn = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))
    return _e(spark, d).select("entry_ord", F.make_valid_utf8(torn.cast("string")).alias("text"))


@query("SELECT n_nationkey, n_name FROM nation")
def b19_record_round_trip(spark, d):
    j = _t(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("j"), F.struct("n_nationkey", "n_name").alias("s"))
    kind = j.schema["s"].dataType
    return j.select(F.from_json("j", kind).alias("r")).select("r.*")


# --- volumes, transfers -----------------------------------------------------------------------------------------


@query(V_SQL + ", t AS (SELECT set_id, stripe, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (NOT is_parity) AS real FROM q GROUP BY ALL) SELECT set_id, stripe, ok + 5 - real >= 5 AS rebuildable FROM t")
def v6_rebuildable_stripes(spark, d):
    states = volumes.piece_states(*_pieces(spark, d))
    g = states.groupBy("set_id", "stripe").agg(F.count_if(F.col("state") == "ok").alias("ok"), F.count_if(~F.col("is_parity")).alias("real"))
    return g.select("set_id", "stripe", (F.col("ok") + 5 - F.col("real") >= 5).alias("rebuildable"))


@query(V_SQL + " SELECT set_id, stripe, slot FROM q WHERE state <> 'ok'")
def v7_flagged_pieces(spark, d):
    return volumes.piece_states(*_pieces(spark, d)).where("state <> 'ok'").select("set_id", "stripe", "slot")


@query(V_SQL + ", t AS (SELECT set_id, stripe, count(*) FILTER (state <> 'ok') AS bad, count(*) FILTER (is_parity AND state = 'ok') AS spare, count(*) FILTER (NOT is_parity AND state <> 'ok') AS lost FROM q GROUP BY ALL) SELECT set_id, count(*) FILTER (lost <= spare) AS repaired, count(*) FILTER (lost > spare) AS skipped FROM t WHERE bad > 0 GROUP BY set_id")
def v8_recover(spark, d):
    states = volumes.piece_states(*_pieces(spark, d))
    ok = F.col("state") == "ok"
    g = states.groupBy("set_id", "stripe").agg(F.count_if(~ok).alias("bad"), F.count_if(F.col("is_parity") & ok).alias("spare"), F.count_if(~F.col("is_parity") & ~ok).alias("lost")).where("bad > 0")
    return g.groupBy("set_id").agg(F.count_if(F.col("lost") <= F.col("spare")).alias("repaired"), F.count_if(F.col("lost") > F.col("spare")).alias("skipped"))


@query(W_SQL + " SELECT set_id, count(*) AS wanted, (SELECT count(*) FROM l WHERE l.set_id = w.set_id) AS here FROM w GROUP BY set_id")
def v9_fetch_plan(spark, d):
    every, local, have = _sets(spark, d)
    n = transfer.wanted(every, local, have).groupBy("set_id").agg(F.count("*").alias("wanted"))
    return n.join(local.groupBy("set_id").agg(F.count("*").alias("here")), "set_id", "left").withColumn("here", F.coalesce("here", F.lit(0)))


@query()
def t4_bandwidth(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 8).alias("server"), (F.col("o_orderkey") / 100).alias("seconds"), (F.col("o_orderkey") % 5000).alias("bytes"))
    return limits.bandwidth(o, 4000.0)
