"""Queries over the driver's tables, one an operator, with the SQL that gives the same rows.

A row of `documents` stands for an archive entry; B is the archive A without every seventh entry and with every
eleventh changed.  Orders and their lines stand for blobs and their chunks, suppliers for peers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import blocks, dedup, diff, entries, integrity, similarity, transfer, volumes
from ..sources import files
from ..streaming import limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

E_SQL = "WITH e AS (SELECT doc_id AS entry_ord, source || '/' || lang || '/' || doc_id || '.txt' AS path, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS h, coalesce(text, '') AS text FROM documents)"
B_SQL = E_SQL + ", b AS (SELECT entry_ord, path, CASE WHEN entry_ord % 11 = 0 THEN sha256(text || '!') ELSE h END AS h FROM e WHERE entry_ord % 7 <> 0)"
C_SQL = E_SQL + ", c AS (SELECT entry_ord, seq, sha256(t) AS h, strlen(t) AS s FROM (SELECT entry_ord, seq, substr(text, seq * 512 + 1, 512) AS t FROM (SELECT entry_ord, text, unnest(range(0, (greatest(length(text), 1) - 1) // 512 + 1)) AS seq FROM e)))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _e(spark: SparkSession, d: str) -> DataFrame:
    return entries.from_documents(_t(spark, d, "documents"))


def _b(e: DataFrame) -> DataFrame:
    text = F.when(F.col("entry_ord") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return e.where("entry_ord % 7 <> 0").withColumn("text", text).withColumn("h", F.sha2("text", 256))


def _c(spark: SparkSession, d: str) -> DataFrame:
    return dedup.fixed_pieces(_e(spark, d), 512)


# --- sources ----------------------------------------------------------------------------------------------------


@query("SELECT path, min(ord) AS ord FROM (SELECT source || '/' || lang AS path, doc_id AS ord FROM documents) GROUP BY path")
def s1_collect_inputs(spark, d):
    names = _t(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang").alias("path"), F.col("doc_id").alias("ord"))
    return files.first_of_name(names, "ord")


@query("SELECT h, min(r) AS ref_ix FROM (SELECT sha256(coalesce(text, '')) AS h, doc_id % 3 AS r FROM documents WHERE doc_id % 5 <> 0) GROUP BY h")
def s8_first_archive_wins(spark, d):
    refs = _e(spark, d).select("h", (F.col("entry_ord") % 3).alias("ref_ix"), (F.col("entry_ord") % 5 == 0).cast("int").alias("x"))
    return dedup.first_of_each(refs)


def _rules(spark, d):
    c = _t(spark, d, "customer")
    line = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("# only a comment "), "c_custkey")).when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("FP"), "c_custkey", F.lit("   # everything")))
    line = line.otherwise(F.concat(F.lit(" fp"), "c_custkey", F.lit(" set"), "c_nationkey", F.lit("  set"), F.col("c_nationkey") + 1, F.lit(" # two")))
    return transfer.rules(c.select(line.alias("value")))


R_SQL = """WITH r AS (SELECT 'fp' || c_custkey AS fp, unnest(CASE WHEN c_custkey % 4 = 0 THEN [NULL] ELSE ['set' || c_nationkey, 'set' || (c_nationkey + 1)] END) AS set_id FROM customer WHERE c_custkey % 10 <> 0)"""


@query(R_SQL + " SELECT DISTINCT fp, set_id FROM r")
def s15_rule_files(spark, d):
    return _rules(spark, d)


# --- projections ------------------------------------------------------------------------------------------------


@query(C_SQL + """, n AS (SELECT entry_ord, count(*) AS n_chunks FROM c GROUP BY entry_ord)
SELECT e.entry_ord, path, size, 'raw' AS mode, substr(h, 1, 12) AS short_hash, CAST(ceil(size / 3.5) AS BIGINT) AS tokens_est, 'text/plain' AS mime, 'text' AS view,
  'siltstone://docs/' || path AS uri, n_chunks, CASE WHEN e.entry_ord % 9 = 0 THEN path || '.view' END AS stored_view FROM e JOIN n USING (entry_ord)""")
def p1_list(spark, d):
    e = _e(spark, d)
    n = _c(spark, d).groupBy("entry_ord").agg(F.count("*").alias("n_chunks"))
    views = e.where("entry_ord % 9 = 0").select(F.col("path").alias("derived_from"), F.concat("path", F.lit(".view")).alias("stored_view"))
    return entries.listing(e, "docs", n, views)


@query(E_SQL + " SELECT entry_ord, '| ' || path || ' | ' || size || ' | ' || CASE WHEN entry_ord % 9 = 0 THEN 'view of ' || path ELSE 'raw' END || ' |' AS row FROM e")
def p2_list_markdown(spark, d):
    return entries.markdown_rows(_e(spark, d).withColumn("derived_from", F.when(F.col("entry_ord") % 9 == 0, F.col("path"))))


@query(E_SQL + " SELECT path, size, h, TRUE AS verified, CAST(ceil(size / 4.0) AS BIGINT) AS tokens_low, CAST(ceil(size / 3.5) AS BIGINT) AS tokens_high FROM e")
def p3_stat(spark, d):
    return entries.stat(_e(spark, d))


@query(E_SQL + " SELECT entry_ord, 'siltstone://' || substr(h, 1, 16) || '/' || path || '#L1-3' AS uri FROM e")
def p4_entry_uri(spark, d):
    return _e(spark, d).select("entry_ord", P.uri(F.substring("h", 1, 16), F.col("path"), F.lit("L1-3")).alias("uri"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'text/html' WHEN page_id % 4 = 1 THEN 'application/pdf' WHEN page_id % 4 = 2 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime FROM pages")
def p5_mime(spark, d):
    name = F.concat(F.lit("a.b/"), "page_id", F.element_at(F.array(F.lit(".HTML"), F.lit(".pdf"), F.lit(".x.jpg"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int")))
    return _t(spark, d, "pages").select("page_id", P.mime(name).alias("mime"))


@query(E_SQL + " SELECT entry_ord, CAST(ceil(size / 3.5) AS BIGINT) AS tokens_est FROM e")
def p6_listed_tokens(spark, d):
    return _e(spark, d).select("entry_ord", T.listed_tokens(F.col("size")).alias("tokens_est"))


@query(E_SQL + """ SELECT entry_ord, CASE WHEN entry_ord % 3 = 0 THEN CAST(ceil(ceil((size + 1) * 4 / 3.0) / 2.5) AS BIGINT) ELSE CAST(ceil(size / 4.0) AS BIGINT) END AS low,
  CASE WHEN entry_ord % 3 = 0 THEN CAST(ceil(ceil((size + 1) * 4 / 3.0) / 2.5) AS BIGINT) ELSE CAST(ceil(size / 3.5) AS BIGINT) END AS high FROM e""")
def p7_token_estimate(spark, d):
    data = F.when(F.col("entry_ord") % 3 == 0, F.concat(F.unhex(F.lit("00")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return _e(spark, d).select("entry_ord", T.token_estimates(data).alias("t")).select("entry_ord", "t.low", "t.high")


@query(C_SQL + " SELECT entry_ord, count(*) AS n_chunks FROM c GROUP BY entry_ord")
def p8_chunk_count(spark, d):
    return _c(spark, d).groupBy("entry_ord").agg(F.count("*").alias("n_chunks"))


@query("SELECT l_orderkey AS entry_ord, max(l_linenumber) >= 4 AS requires_kind FROM lineitem GROUP BY l_orderkey")
def p9_requires(spark, d):
    segments = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("kinds"))
    return segments.select(F.col("l_orderkey").alias("entry_ord"), F.exists("kinds", lambda k: k >= 4).alias("requires_kind"))


def _blobs(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("blob_ix"), F.col("l_returnflag").alias("codec"), F.col("l_quantity").cast("long").alias("clen"), (F.col("l_quantity").cast("long") * 2 + 1).alias("ulen"))


@query("""SELECT codec, count(*) AS blobs, CAST(sum(clen) AS BIGINT) AS clen, CAST(sum(ulen) AS BIGINT) AS ulen, round(sum(clen) * 1000 / sum(ulen)) / 10 AS ratio_pct
FROM (SELECT l_returnflag AS codec, CAST(l_quantity AS BIGINT) AS clen, CAST(l_quantity AS BIGINT) * 2 + 1 AS ulen FROM lineitem) GROUP BY ROLLUP (codec)""")
def p10_info(spark, d):
    return entries.info(_blobs(spark, d))


@query("SELECT l_linenumber AS codec_id, CASE l_linenumber WHEN 1 THEN 'zstd' WHEN 2 THEN 'xz' WHEN 3 THEN 'bz2' WHEN 4 THEN 'zstd-dict' WHEN 5 THEN 'zstd-delta' WHEN 6 THEN 'xz-x86' ELSE 'unknown' END AS codec, count(*) AS n FROM lineitem GROUP BY ALL")
def p11_codec_names(spark, d):
    from ..functions.kernels import CODECS

    name = P.lookup({str(k): v for k, v in CODECS.items()}, F.col("l_linenumber").cast("string"), "unknown")
    return _t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("codec_id"), name.alias("codec")).agg(F.count("*").alias("n"))


@query("SELECT set_id, array_to_string(list_transform(list_sort(list(DISTINCT ix)), lambda x: CAST(x AS VARCHAR)), ',') AS volumes FROM (SELECT ps % 50 AS set_id, ps % 7 AS ix FROM (SELECT s_suppkey AS ps FROM supplier)) GROUP BY set_id")
def p12_served(spark, d):
    return transfer.served(_t(spark, d, "supplier").select((F.col("s_suppkey") % 50).alias("set_id"), (F.col("s_suppkey") % 7).alias("ix")))


# --- filters ----------------------------------------------------------------------------------------------------


@query(E_SQL + " SELECT entry_ord, path FROM e WHERE regexp_matches(path, '^src1.*/en/.*[0-4]\\.txt$')")
def f1_glob(spark, d):
    return _e(spark, d).where(P.glob(F.col("path"), "src1*/en/*[0-4].txt")).select("entry_ord", "path")


@query(E_SQL + " SELECT entry_ord, path FROM e WHERE entry_ord = 1 OR path LIKE 'src2/%' OR path LIKE '%/de/_.txt'")
def f2_select_entries(spark, d):
    e = _e(spark, d)
    return entries.select(e, [e.where("entry_ord = 1").first()["path"], "src2/*", "*/de/?.txt"]).select("entry_ord", "path")


G_SQL = E_SQL + """, l AS (SELECT entry_ord, path, unnest(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS t,
  generate_subscripts(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)), 1) AS line FROM e WHERE text <> '')"""


@query(G_SQL + " SELECT entry_ord, path, line, regexp_replace(t, '\\s+$', '') AS text FROM l WHERE regexp_matches(t, '(?i)thing|ation\\b')")
def f3_grep(spark, d):
    return entries.grep(_e(spark, d), r"thing|ation\b", ignore_case=True, most=None)


@query(E_SQL + " SELECT entry_ord, path, array_to_string(list_slice(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)), 2, 3), chr(10)) AS content FROM e")
def f4_line_range(spark, d):
    return entries.read_lines(_e(spark, d), 2, 3)


@query(E_SQL + " SELECT entry_ord, path, lower(hex(encode(text)[11:60])) AS content FROM e")
def f5_byte_range(spark, d):
    return entries.read_bytes(_e(spark, d), 10, 60).withColumn("content", F.lower(F.hex("content")))


@query(E_SQL + " SELECT entry_ord, path, CASE WHEN entry_ord % 9 = 0 THEN 'view ' || left(text, 20) ELSE text END AS view_text, entry_ord % 9 = 0 AS stored FROM e")
def f6_view_read(spark, d):
    e = _e(spark, d)
    return entries.read_view(e, e.where("entry_ord % 9 = 0").select(F.col("path").alias("derived_from"), F.concat(F.lit("view "), F.substring("text", 1, 20)).alias("view_text")))


@query(E_SQL + " SELECT entry_ord, path FROM e WHERE path = 'src3/en/3.txt' OR path = 'src3/fr/3.txt'")
def f7_find_entry(spark, d):
    return _e(spark, d).where(F.col("path").isin(*(f"src3/{x}/3.txt" for x in ("en", "fr")))).select("entry_ord", "path")


@query("SELECT doc_id AS entry_ord FROM documents WHERE doc_id % 9 <> 0")
def f8_default_extraction(spark, d):
    e = _e(spark, d).withColumn("derived_from", F.when(F.col("entry_ord") % 9 == 0, F.col("path")))
    return e.where("derived_from is null").select("entry_ord")


_ODD = ["a/b.txt", "./a/b.txt", "", "/abs", "a//b", "a/../b", "c:x", "a/con.txt", "dir /x", "a\\b", "a/aux", "x./y", "ok/nul.d/z", "t\tt"]


@query("""WITH p AS (SELECT s_suppkey AS k, (['a/b.txt', './a/b.txt', '', '/abs', 'a//b', 'a/../b', 'c:x', 'a/con.txt', 'dir /x', 'a\\b', 'a/aux', 'x./y', 'ok/nul.d/z', 't' || chr(9) || 't'])[s_suppkey % 14 + 1] AS raw FROM supplier),
c AS (SELECT k, regexp_replace(replace(raw, '\\', '/'), '^(\\./)+', '') AS path FROM p)
SELECT k, path, CASE WHEN path = '' THEN 'empty' WHEN path LIKE '/%' THEN 'absolute' WHEN regexp_matches(path, '[\\x00-\\x1f\\x7f]') THEN 'control' WHEN contains(path, ':') THEN 'colon'
  WHEN regexp_matches(path, '(^|/)(/|$)') THEN 'empty component' WHEN regexp_matches(path, '(^|/)\\.{1,2}(/|$)') THEN 'dot component' WHEN regexp_matches(path, '[ .](/|$)') THEN 'trailing space or dot'
  WHEN regexp_matches(lower(path), '(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\.[^/]*)?(/|$)') THEN 'reserved name' END AS error FROM c""")
def f9_path_policy(spark, d):
    odd = F.element_at(F.array(*map(F.lit, _ODD)), (F.col("s_suppkey") % 14 + 1).cast("int"))
    clean = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), P.cleaned(odd).alias("path"))
    return clean.select("k", "path", P.path_error(F.col("path")).alias("error"))


@query(E_SQL + " SELECT entry_ord, 'out/dir/' || path AS target FROM e")
def f10_safe_join(spark, d):
    return _e(spark, d).where(P.path_error(F.col("path")).isNull()).select("entry_ord", F.concat(F.lit("out/dir/"), "path").alias("target"))


@query("SELECT page_id, page_id % 4 = 0 AS zip_like, page_id % 4 = 1 AS streams, CASE page_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' WHEN 2 THEN 'text' END AS view FROM pages")
def f11_type_predicates(spark, d):
    name = F.concat(F.lit("d/"), "page_id", F.element_at(F.array(F.lit(".DocX"), F.lit(".pdf"), F.lit(".md"), F.lit(".bin")), (F.col("page_id") % 4 + 1).cast("int")))
    return _t(spark, d, "pages").select("page_id", P.is_zip_like(name).alias("zip_like"), P.is_stream_container(name).alias("streams"), P.view_kind(name).alias("view"))


@query(E_SQL + " SELECT sum(size)::BIGINT AS total, (sum(size) // 100)::BIGINT AS ratio, CASE WHEN sum(size) > 4294967296 THEN 'total' ELSE 'ratio' END AS reason FROM e HAVING sum(size) > 4294967296 OR sum(size) // 100 > 1000")
def f12_limits(spark, d):
    return integrity.over_limits(_e(spark, d), 100)


def _index(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("blob_ix"), F.col("l_partkey").alias("chunk_ix"), F.col("l_linenumber"))
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("chunk_ix"), F.col("p_size").cast("long").alias("s"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("h"), (F.col("p_partkey") % 10 == 0).alias("x"))
    blobs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("blob_ix"), (F.col("o_orderkey") % 100).alias("ulen"))
    return blobs, li.select("blob_ix", "chunk_ix"), parts


I_SQL = "WITH li AS (SELECT l_orderkey AS b, l_partkey AS c FROM lineitem), p AS (SELECT p_partkey AS c, p_size AS s, p_partkey % 10 = 0 AS x FROM part)"


@query(I_SQL + """ SELECT 'size' AS rule, CAST(coalesce(t.b, o.o_orderkey) AS VARCHAR) AS key FROM (SELECT b, sum(s) AS total FROM li LEFT JOIN p USING (c) GROUP BY b) t FULL JOIN orders o ON o.o_orderkey = t.b WHERE total IS DISTINCT FROM o_orderkey % 100
UNION ALL SELECT 'unknown chunk', CAST(li.c AS VARCHAR) FROM li ANTI JOIN p USING (c)
UNION ALL SELECT 'two blobs', CAST(c AS VARCHAR) FROM li GROUP BY c HAVING count(*) > 1
UNION ALL SELECT 'external', CAST(c AS VARCHAR) FROM p WHERE x = (c IN (SELECT c FROM li))""")
def f13_index_consistency(spark, d):
    return integrity.index_violations(*_index(spark, d))


@query(I_SQL + " SELECT b AS blob_ix, CAST(sum(s) AS BIGINT) AS bytes FROM li JOIN p USING (c) GROUP BY b HAVING sum(s) > 120")
def f14_dictionary_bounds(spark, d):
    _, uses, chunks = _index(spark, d)
    return integrity.dictionaries_over(uses, chunks, 120)


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS blob, o_orderkey // 3 AS base FROM orders WHERE o_orderkey > 2),
r AS (SELECT DISTINCT base AS blob, 0 AS depth FROM e WHERE base NOT IN (SELECT blob FROM e) UNION SELECT e.blob, r.depth + 1 FROM e JOIN r ON e.base = r.blob WHERE r.depth < 16)
SELECT blob, max(depth) AS depth FROM r GROUP BY blob""")
def f15_delta_depth(spark, d):
    edges = _t(spark, d, "orders").where("o_orderkey > 2").select(F.col("o_orderkey").alias("blob"), F.expr("o_orderkey div 3").alias("base"))
    return integrity.chain_depths(edges)


@query("SELECT l_orderkey AS entry_ord, l_linenumber AS seq FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 13 <> 0)")
def f16_references_in_range(spark, d):
    known = _t(spark, d, "supplier").where("s_suppkey % 13 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return _t(spark, d, "lineitem").join(known, "l_suppkey", "left_anti").select(F.col("l_orderkey").alias("entry_ord"), F.col("l_linenumber").alias("seq"))


@query(E_SQL + """, r AS (SELECT entry_ord, size, CAST(sum(size) OVER (ORDER BY entry_ord) AS BIGINT) AS running FROM e)
SELECT entry_ord, size, running, CASE WHEN size > 20000 THEN 'entry' ELSE 'total' END AS reason FROM r WHERE size > 20000 OR running > 2000000""")
def f17_pack_limits(spark, d):
    return integrity.running_over(_e(spark, d), 20000, 2000000)


@query(E_SQL + """, t AS (SELECT entry_ord, left(CASE WHEN entry_ord % 5 = 0 THEN repeat(chr(7), 50) || text ELSE text END, 65536) AS x FROM e)
SELECT entry_ord, length(x) > 0 AND (length(x) - length(regexp_replace(x, '[^\\x01-\\x08\\x0e-\\x1f\\x7f]', '', 'g'))) * 100 >= length(x) * 97 AS text_like FROM t""")
def f18_looks_like_text(spark, d):
    x = F.when(F.col("entry_ord") % 5 == 0, F.concat(F.repeat(F.lit("\x07"), 50), "text")).otherwise(F.col("text"))
    return _e(spark, d).select("entry_ord", T.looks_like_text(x).alias("text_like"))


@query("""WITH c AS (SELECT l_orderkey AS k, length(o_orderpriority) AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT k, bool_and(z * 100 >= 10 * 97) AS incompressible FROM c GROUP BY k""")
def f20_incompressible(spark, d):
    met = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    return met.groupBy(F.col("l_orderkey").alias("k")).agg(F.every(F.length("o_orderpriority") * 100 >= 10 * 97).alias("incompressible"))


def _requests(spark, d):
    o = _t(spark, d, "orders")
    return o.select(F.concat(F.lit("fp"), "o_custkey").alias("client"), F.concat(F.lit("set"), F.col("o_orderkey") % 25).alias("set_id")).distinct()


@query(R_SQL + " SELECT DISTINCT client, q.set_id FROM (SELECT 'fp' || o_custkey AS client, 'set' || (o_orderkey % 25) AS set_id FROM orders) q JOIN r ON r.fp = client AND (r.set_id IS NULL OR r.set_id = q.set_id)")
def f21_acl(spark, d):
    return transfer.may_read(_requests(spark, d), _rules(spark, d))


@query("SELECT DISTINCT 'fp' || o_custkey AS client FROM orders WHERE o_custkey % 17 <> 0")
def f22_revocation(spark, d):
    revoked = _t(spark, d, "customer").where("c_custkey % 17 = 0").select(F.concat(F.lit("fp"), "c_custkey").alias("client"))
    return transfer.not_revoked(_requests(spark, d).select("client").distinct(), revoked)


@query("SELECT s_suppkey, s_suppkey % 5 < 2 AS loopback FROM supplier")
def f23_loopback(spark, d):
    address = F.element_at(F.array(*map(F.lit, ("127.0.0.1", "::1", "10.127.0.1", "::12", "example.org"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return _t(spark, d, "supplier").select("s_suppkey", P.loopback(address).alias("loopback"))


@query(E_SQL + " SELECT entry_ord, path LIKE 'src1/%' AS inside FROM e")
def f24_root_containment(spark, d):
    return _e(spark, d).select("entry_ord", P.within(F.lit("src1"), F.col("path")).alias("inside"))


@query("""SELECT p_partkey AS set_id, CASE WHEN p_size % 10 < 1 THEN 'geometry' WHEN p_size * 1000000 > 16777216 THEN 'piece size' WHEN 7 <> ceil(p_partkey * 1000 / (p_size * 1000000.0)) THEN 'pieces' ELSE 'stripes' END AS reason
FROM part WHERE p_size % 10 < 1 OR p_size * 1000000 > 16777216 OR 7 <> ceil(p_partkey * 1000 / (p_size * 1000000.0)) OR 3 <> ceil(ceil(p_partkey * 1000 / (p_size * 1000000.0)) / (p_size % 10))""")
def f25_descriptor(spark, d):
    sets = _t(spark, d, "part").select(F.col("p_partkey").alias("set_id"), (F.col("p_size") % 10).alias("data"), F.lit(2).alias("parity"), (F.col("p_size") * 1000000).alias("piece_size"), (F.col("p_partkey") * 1000).alias("archive_size"), F.lit(7).alias("pieces"), F.lit(3).alias("stripes"))
    return volumes.descriptor_violations(sets)


# --- joins ------------------------------------------------------------------------------------------------------


@query(C_SQL + " SELECT h, min(s) AS s, count(*) AS times, arg_min(entry_ord, entry_ord * 100000 + seq) AS entry_ord, arg_min(seq, entry_ord * 100000 + seq) AS seq FROM c GROUP BY h")
def j1_chunk_dedup(spark, d):
    return dedup.unique_chunks(_c(spark, d)).select("h", "s", "times", "first.entry_ord", "first.seq")


def _refs(c: DataFrame) -> DataFrame:
    return c.where("entry_ord % 3 <> 0").select("h", (F.col("entry_ord") % 3).alias("ref_ix"), (F.col("entry_ord") % 5 == 0).cast("int").alias("x"))


F_SQL = C_SQL + ", f AS (SELECT h, min(entry_ord % 3) AS ref_ix FROM c WHERE entry_ord % 3 <> 0 AND entry_ord % 5 <> 0 GROUP BY h), u AS (SELECT h, min(s) AS s FROM c WHERE entry_ord % 2 = 0 GROUP BY h)"


@query(F_SQL + " SELECT h, s, coalesce(ref_ix, -1) AS ref_ix FROM u LEFT JOIN f USING (h)")
def j2_external_chunks(spark, d):
    c = _c(spark, d)
    met = dedup.against_references(c.where("entry_ord % 2 = 0").groupBy("h").agg(F.min("s").alias("s")), _refs(c))
    return met.withColumn("ref_ix", F.coalesce("ref_ix", F.lit(-1)))


@query(F_SQL + " SELECT count(*) AS unresolved FROM u ANTI JOIN f USING (h)")
def j3_unresolved(spark, d):
    c = _c(spark, d)
    return dedup.unresolved(c.where("entry_ord % 2 = 0").select("h").distinct(), _refs(c))


@query("SELECT c_custkey AS entry_ord, o_orderkey AS chunk_ix, l_linenumber AS blob_ix, CAST(l_quantity AS BIGINT) AS len FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def j4_entry_chunk_blob(spark, d):
    c, o, li = (_t(spark, d, n) for n in ("customer", "orders", "lineitem"))
    met = c.join(o, F.expr("o_custkey = c_custkey")).join(li, F.expr("l_orderkey = o_orderkey"))
    return met.select(F.col("c_custkey").alias("entry_ord"), F.col("o_orderkey").alias("chunk_ix"), F.col("l_linenumber").alias("blob_ix"), F.col("l_quantity").cast("long").alias("len"))


@query(B_SQL + " SELECT coalesce(e.path, b.path) AS path, CASE WHEN e.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN e.h = b.h THEN 'unchanged' ELSE 'changed' END AS state FROM (SELECT * FROM e WHERE entry_ord % 25 <> 1) e FULL JOIN b ON e.path = b.path")
def j5_diff_paths(spark, d):
    e = _e(spark, d)
    return diff.by_path(e.where("entry_ord % 25 <> 1"), _b(e))


@query(C_SQL + """, a AS (SELECT DISTINCT h FROM c WHERE entry_ord % 2 = 0), b AS (SELECT DISTINCT h, s FROM c WHERE entry_ord % 3 <> 0)
SELECT count(*) FILTER (b.h IN (SELECT h FROM a)) AS shared_chunks, CAST(sum(s) FILTER (b.h IN (SELECT h FROM a)) AS BIGINT) AS shared_bytes, count(*) FILTER (b.h NOT IN (SELECT h FROM a)) AS new_chunks,
  CAST(sum(s) FILTER (b.h NOT IN (SELECT h FROM a)) AS BIGINT) AS new_bytes, round(sum(s) FILTER (b.h NOT IN (SELECT h FROM a)) * 1000 / sum(s)) / 10 AS new_pct FROM b""")
def j6_shared_chunks(spark, d):
    c = _c(spark, d)
    return diff.chunk_counters(c.where("entry_ord % 2 = 0"), c.where("entry_ord % 3 <> 0"))


@query(E_SQL + " SELECT e.path, v.path AS view FROM e LEFT JOIN (SELECT path || '.md' AS path, path AS src FROM e WHERE entry_ord % 4 = 0) v ON v.src = e.path")
def j7_view_map(spark, d):
    e = _e(spark, d)
    v = e.where("entry_ord % 4 = 0").select(F.concat("path", F.lit(".md")).alias("view"), F.col("path").alias("derived_from"))
    return e.join(v, e["path"] == v["derived_from"], "left").select("path", "view")


@query("""WITH n AS (SELECT p_partkey AS k, p_name || '.dat' AS base FROM part WHERE p_size > 25), o AS (SELECT p_partkey AS ok, p_name || '.dat' AS obase FROM part WHERE p_size <= 25),
m AS (SELECT k, ok, base, obase, len(list_filter(range(1, least(length(base), length(obase)) + 1), lambda i: left(base, i) = left(obase, i))) AS lcp FROM n JOIN o ON left(base, 3) = left(obase, 3)),
f AS (SELECT k, ok, CASE WHEN base = obase THEN 1073741824 ELSE lcp END AS score FROM m WHERE lcp >= 3 AND lcp * 2 >= least(length(base), length(obase)))
SELECT k AS entry_ord, ok AS old_entry_ord, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, ok DESC) AS INTEGER) AS rank FROM f QUALIFY rank <= 3""")
def j8_name_candidates(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("entry_ord"), F.concat("p_name", F.lit(".dat")).alias("path"), "p_size")
    return similarity.name_candidates(p.where("p_size > 25"), p.where("p_size <= 25"))


@query(C_SQL + """, cand AS (SELECT n.entry_ord, o.entry_ord AS old FROM (SELECT DISTINCT entry_ord FROM c) n JOIN (SELECT DISTINCT entry_ord FROM c) o ON o.entry_ord BETWEEN n.entry_ord - 20 AND n.entry_ord - 1)
SELECT cand.entry_ord, old AS old_entry_ord, CAST(sum(c.s) AS BIGINT) AS shared, t.total FROM cand JOIN c USING (entry_ord) JOIN (SELECT DISTINCT entry_ord AS old, h FROM c) x USING (old, h) JOIN (SELECT entry_ord, CAST(sum(s) AS BIGINT) AS total FROM c GROUP BY entry_ord) t ON t.entry_ord = cand.entry_ord
GROUP BY ALL HAVING sum(c.s) * 4 >= total""")
def j9_confirmed_candidates(spark, d):
    c, e = _c(spark, d), _t(spark, d, "documents").select(F.col("doc_id").alias("entry_ord"))
    near = e.select("entry_ord", F.explode(F.sequence(F.col("entry_ord") - 20, F.col("entry_ord") - 1)).alias("old_entry_ord")).where("old_entry_ord >= 0")
    return similarity.confirmed(near, c, c)


@query("SELECT o_orderkey, o_custkey % 9 <> 0 AS same FROM orders")
def j11_positional_check(spark, d):
    o = _t(spark, d, "orders")
    torn = F.when(F.col("o_custkey") % 9 == 0, 1).otherwise(0)
    want = o.select("o_orderkey", F.sha2(F.col("o_custkey").cast("string"), 256).alias("h"))
    got = o.select("o_orderkey", F.sha2((F.col("o_custkey") + torn).cast("string"), 256).alias("g"))
    return want.join(got, "o_orderkey").select("o_orderkey", (F.col("h") == F.col("g")).alias("same"))


@query("""WITH f AS (SELECT s_suppkey AS ord, s_nationkey AS set_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 6 END AS hi, s_suppkey % 6 AS ti, s_suppkey % 4 <> 0 AS usable FROM supplier)
SELECT set_id, coalesce(hi, ti) AS ix, usable, ord FROM f QUALIFY row_number() OVER (PARTITION BY set_id, coalesce(hi, ti) ORDER BY usable DESC, ord) = 1""")
def j12_chosen_volumes(spark, d):
    k = F.col("s_suppkey")
    found = _t(spark, d, "supplier").select(k.alias("ord"), F.col("s_nationkey").alias("set_id"), F.when(k % 3 != 0, k % 6).alias("header_ix"), (k % 6).alias("trailer_ix"), (k % 4 != 0).alias("usable"))
    return volumes.chosen_volumes(found)


def _sets(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 200).alias("set_id"), (F.col("o_orderkey") % 9).alias("ix"), "o_orderkey")
    return o.select("set_id", "ix").distinct(), o.where("o_orderkey % 5 = 0").select("set_id", "ix").distinct(), o.where("o_orderkey % 2 = 0").select("set_id", "ix").distinct()


W_SQL = """WITH o AS (SELECT o_custkey % 200 AS set_id, o_orderkey % 9 AS ix, o_orderkey AS k FROM orders), v AS (SELECT DISTINCT set_id, ix FROM o), l AS (SELECT DISTINCT set_id, ix FROM o WHERE k % 5 = 0), p AS (SELECT DISTINCT set_id, ix FROM o WHERE k % 2 = 0),
w AS (SELECT * FROM v ANTI JOIN l USING (set_id, ix) SEMI JOIN p USING (set_id, ix))"""


@query(W_SQL + " SELECT set_id, ix FROM w")
def j13_wanted_volumes(spark, d):
    return transfer.wanted(*_sets(spark, d))


@query("""WITH s AS (SELECT sha256(CAST(s_suppkey AS VARCHAR)) AS set_id FROM supplier), p AS (SELECT left(set_id, 16 + ascii(set_id) % 5) AS prefix FROM s UNION ALL SELECT left(set_id, 8) FROM s)
SELECT prefix, min(set_id) AS set_id FROM p JOIN s ON starts_with(set_id, prefix) WHERE length(prefix) >= 16 GROUP BY prefix HAVING count(*) = 1""")
def j14_set_prefix(spark, d):
    s = _t(spark, d, "supplier").select(F.sha2(F.col("s_suppkey").cast("string"), 256).alias("set_id"))
    long = s.select(F.substring("set_id", F.lit(1), (F.ascii("set_id") % 5 + 16).cast("int")).alias("prefix"))
    return transfer.matching_set(long.unionAll(s.select(F.substring("set_id", 1, 8))), s)


O_SQL = C_SQL + ", o AS (SELECT entry_ord AS b, seq AS i, s, CAST(coalesce(sum(s) OVER (PARTITION BY entry_ord ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM c)"


def _offsets(spark, d):
    return blocks.offsets(_c(spark, d).select(F.col("entry_ord").alias("b"), F.col("seq").alias("i"), "s"), "b", "i", "s")


@query(O_SQL + " SELECT b, i, s, off FROM o WHERE off < 1700 AND off + s > 700")
def j15_range_overlap(spark, d):
    return blocks.overlapping(_offsets(spark, d), 700, 1700)


@query("""WITH x AS (SELECT o_custkey AS a, o_orderkey * 10 AS off, CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE 10 END AS len FROM orders), y AS (SELECT *, coalesce(lag(off + len) OVER (PARTITION BY a ORDER BY off), 0) AS expected FROM x)
SELECT a AS archive, off, len, expected FROM y WHERE off <> expected""")
def j16_layout(spark, d):
    x = _t(spark, d, "orders").select(F.col("o_custkey").alias("archive"), (F.col("o_orderkey") * 10).alias("off"), F.when(F.col("o_orderkey") % 3 == 0, 9).otherwise(10).alias("len"))
    return integrity.layout_gaps(x)


@query("SELECT o_custkey AS blob_ix, string_agg(CAST(o_orderkey AS VARCHAR), '' ORDER BY o_orderkey) AS dictionary FROM orders GROUP BY o_custkey")
def j17_dictionary_bytes(spark, d):
    parts = F.sort_array(F.collect_list("o_orderkey"))
    return _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("blob_ix")).agg(F.array_join(F.transform(parts, lambda x: x.cast("string")), "").alias("dictionary"))


# --- aggregates -------------------------------------------------------------------------------------------------


@query(C_SQL + ", u AS (SELECT h, count(*) AS n, sum(s) AS a, min(s) AS s FROM c GROUP BY h) SELECT CAST(sum(n) AS BIGINT) AS chunks_total, count(*) AS chunks_unique, CAST(sum(a) AS BIGINT) AS logical_bytes, CAST(sum(s) AS BIGINT) AS unique_bytes, CAST(sum(a) - sum(s) AS BIGINT) AS saved_bytes FROM u")
def a1_pack_report(spark, d):
    return dedup.report(_c(spark, d))


@query("SELECT codec, count(*) AS n FROM (SELECT unnest([l_returnflag, CASE WHEN l_linenumber % 3 = 0 THEN 'filter:' || l_returnflag END]) AS codec FROM lineitem) WHERE codec IS NOT NULL GROUP BY codec")
def a2_codec_histogram(spark, d):
    both = F.explode(F.array(F.col("l_returnflag"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("filter:"), "l_returnflag"))))
    return _t(spark, d, "lineitem").select(both.alias("codec")).where("codec is not null").groupBy("codec").agg(F.count("*").alias("n"))


@query(F_SQL + " SELECT ref_ix, count(*) AS chunks, CAST(sum(s) AS BIGINT) AS bytes FROM u JOIN f USING (h) GROUP BY ref_ix")
def a4_reference_usage(spark, d):
    c = _c(spark, d)
    return dedup.reference_usage(c.where("entry_ord % 2 = 0").groupBy("h").agg(F.min("s").alias("s")), _refs(c))


@query(B_SQL + " SELECT CASE WHEN e.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN e.h = b.h THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n FROM (SELECT * FROM e WHERE entry_ord % 25 <> 1) e FULL JOIN b ON e.path = b.path GROUP BY ALL")
def a5_diff_counters(spark, d):
    e = _e(spark, d)
    return diff.counters(e.where("entry_ord % 25 <> 1"), _b(e))


@query(E_SQL + " SELECT count(*) AS entries_total, count(*) FILTER (entry_ord % 50 <> 0) AS entries_ok, array_to_string(list_sort(list(path) FILTER (entry_ord % 50 = 0)), ',') AS bad FROM e")
def a6_verify_report(spark, d):
    e = _e(spark, d).withColumn("text", F.when(F.col("entry_ord") % 50 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return integrity.verify_entries(e).withColumn("bad", F.array_join("bad", ","))


@query("""WITH RECURSIVE l AS (SELECT 0 AS lvl, list(sha256('\\x00'::BLOB || unhex(sha256(CAST(n AS VARCHAR)))) ORDER BY n) AS v FROM (SELECT s_suppkey AS n FROM supplier)
UNION ALL SELECT lvl + 1, list_transform(range(0, (len(v) + 1) // 2), lambda i: sha256('\\x01'::BLOB || unhex(v[2 * i + 1]) || unhex(coalesce(v[2 * i + 2], v[2 * i + 1])))) FROM l WHERE len(v) > 1)
SELECT v[1] AS root FROM l WHERE len(v) = 1""")
def a7_merkle_root(spark, d):
    from pyspark.sql import Window

    s = _t(spark, d, "supplier")
    return integrity.merkle_root(s.select((F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("long").alias("i"), F.sha2(F.col("s_suppkey").cast("string"), 256).alias("h")))


@query(E_SQL + " SELECT entry_ord, h FROM e")
def a8_entry_hash(spark, d):
    return _e(spark, d).select("entry_ord", "h")


@query("SELECT p.l_orderkey AS set_id, CAST(l_linenumber // 4 AS BIGINT) AS stripe, count(*) FILTER (l_partkey % 3 <> 0) AS ok FROM lineitem p GROUP BY ALL HAVING count(*) FILTER (l_partkey % 3 <> 0) < 3")
def a9_short_stripes(spark, d):
    li = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("set_id"), F.expr("l_linenumber div 4").alias("stripe"))
    return li.agg(F.count_if(F.col("l_partkey") % 3 != 0).alias("ok")).where("ok < 3")


@query("SELECT s_nationkey AS set_id, s_suppkey % 3 AS location, count(*) AS volumes FROM supplier GROUP BY ALL HAVING count(*) > 2")
def a10_crowded_locations(spark, d):
    return volumes.crowded(_t(spark, d, "supplier").select(F.col("s_nationkey").alias("set_id"), (F.col("s_suppkey") % 3).alias("location")), 2)


@query("SELECT l_orderkey AS entry_ord, count(*) FILTER (l_returnflag = 'A') AS stored, count(*) FILTER (l_returnflag = 'N') AS deflate, count(*) FILTER (l_returnflag = 'R') AS raw FROM lineitem GROUP BY l_orderkey")
def a11_member_kinds(spark, d):
    kinds = (("A", "stored"), ("N", "deflate"), ("R", "raw"))
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entry_ord")).agg(*(F.count_if(F.col("l_returnflag") == k).alias(n) for k, n in kinds))


@query("""WITH t AS (SELECT o_custkey AS key, o_orderpriority AS codec, o_orderkey AS o, o_orderkey % 40 AS clen FROM orders), b AS (SELECT key, arg_min(codec, clen * 100000000 + o) AS codec, min(clen) AS clen FROM t GROUP BY key)
SELECT key, CASE WHEN clen < 20 THEN codec ELSE 'store' END AS codec, least(clen, 20) AS clen FROM b""")
def a12_best_codec(spark, d):
    o = _t(spark, d, "orders")
    return blocks.best_of(o.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("codec"), F.col("o_orderkey").alias("try_order"), (F.col("o_orderkey") % 40).alias("clen"), F.lit(20).cast("long").alias("ulen")))


@query()
def a13_checksums(spark, d):
    return _e(spark, d).select("entry_ord", F.crc32(F.col("text").cast("binary")).alias("crc32"), integrity.adler32(F.col("text").cast("binary")).alias("adler32"))


@query("SELECT sha256(string_agg(concat_ws('|', n_nationkey, n_regionkey, n_nationkey * 10, 10, sha256(n_name)), chr(10) ORDER BY n_nationkey)) AS message FROM nation")
def a14_signing_message(spark, d):
    return integrity.signing_message(_t(spark, d, "nation").select(F.col("n_nationkey").alias("ix"), F.col("n_regionkey").alias("t"), (F.col("n_nationkey") * 10).alias("off"), F.lit(10).alias("len"), F.sha2("n_name", 256).alias("h")))


@query(E_SQL + " SELECT entry_ord, sha256(concat_ws('|', 'volume-set', h, size, 65536, 4, 2)) AS set_id FROM e")
def a15_set_id(spark, d):
    return _e(spark, d).select("entry_ord", integrity.set_id(F.col("h"), F.col("size"), F.lit(65536), F.lit(4), F.lit(2)).alias("set_id"))


@query(C_SQL.replace("FROM documents)", "FROM documents)") + ", u AS (SELECT lang, h, min(s) AS s, count(*) AS n FROM c JOIN documents ON doc_id = entry_ord GROUP BY lang, h) SELECT lang, CAST(sum(n) AS BIGINT) AS chunks_total, count(*) AS chunks_unique, CAST(sum(n * s) AS BIGINT) AS logical_bytes, CAST(sum(s) AS BIGINT) AS unique_bytes FROM u GROUP BY lang")
def a17_dedup_by_language(spark, d):
    lang = _t(spark, d, "documents").select(F.col("doc_id").alias("entry_ord"), "lang", F.col("text"))
    cut = dedup.fixed_pieces(lang.select(F.struct("entry_ord", "lang").alias("entry_ord"), F.coalesce("text", F.lit("")).alias("text")), 512)
    u = cut.groupBy(F.col("entry_ord.lang").alias("lang"), "h").agg(F.min("s").alias("s"), F.count("*").alias("n"))
    return u.groupBy("lang").agg(F.sum("n").alias("chunks_total"), F.count("*").alias("chunks_unique"), F.sum(F.col("n") * F.col("s")).alias("logical_bytes"), F.sum("s").alias("unique_bytes"))


@query("SELECT count(*) FILTER (l_returnflag = 'A') AS fetched, count(*) FILTER (l_returnflag = 'N') AS kept, count(*) FILTER (l_returnflag = 'R') AS failed, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS bytes, CAST(sum(l_linenumber) AS BIGINT) AS retries FROM lineitem")
def a18_fetch_report(spark, d):
    state = P.lookup({"A": "fetched", "N": "kept", "R": "failed"}, F.col("l_returnflag"))
    return transfer.fetch_report(_t(spark, d, "lineitem").select(state.alias("state"), F.col("l_quantity").cast("long").alias("s"), F.col("l_linenumber").alias("retries")))


@query(R_SQL + """, s AS (SELECT DISTINCT 'set' || n_nationkey AS set_id FROM nation), n AS (SELECT count(DISTINCT fp) AS n FROM r WHERE set_id IS NULL), o AS (SELECT set_id, count(DISTINCT fp) AS own FROM r WHERE set_id IS NOT NULL AND fp NOT IN (SELECT fp FROM r WHERE set_id IS NULL) GROUP BY set_id)
SELECT s.set_id, coalesce(own, 0) + n AS readers FROM s LEFT JOIN o USING (set_id), n""")
def a19_acl_readers(spark, d):
    sets = _t(spark, d, "nation").select(F.concat(F.lit("set"), "n_nationkey").alias("set_id")).distinct()
    return transfer.readers_of_sets(_rules(spark, d), sets)


@query("SELECT l_returnflag AS command, median(CAST(l_quantity AS DOUBLE)) AS seconds FROM lineitem GROUP BY l_returnflag")
def a20_medians(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("command")).agg(F.median(F.col("l_quantity").cast("double")).alias("seconds"))


# --- windows ----------------------------------------------------------------------------------------------------


@query(O_SQL + " SELECT b, i, s, off FROM o")
def w1_offsets(spark, d):
    return _offsets(spark, d)


@query(C_SQL + ", f AS (SELECT h, min(entry_ord * 100000 + seq) AS o FROM c GROUP BY h) SELECT h, row_number() OVER (ORDER BY o) - 1 AS chunk_ix FROM f")
def w2_chunk_index(spark, d):
    u = dedup.unique_chunks(_c(spark, d))
    # ranges in order of first appearance, then places within a range and the ranges' sizes before it
    return first_appearance_index(u)


def first_appearance_index(u: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    part = F.floor(F.col("first.entry_ord") / 1024)
    sizes = u.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    return u.withColumn("part", part).withColumn("place", place).join(F.broadcast(before), "part").select("h", (F.col("before") + F.col("place")).cast("long").alias("chunk_ix"))


@query()
def w3_greedy_blocks(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 16).alias("archive_id"), F.col("o_orderkey").alias("ix"), (F.col("o_orderkey") % 50 * 1000).alias("s"), F.lit(None).cast("string").alias("dict"))
    return blocks.fill_blocks(o, block=1 << 18)


@query()
def w4_delta_chain(spark, d):
    li = _t(spark, d, "orders").select((F.col("o_custkey") % 16).alias("archive_id"), F.col("o_orderkey").alias("ix"))
    from pyspark.sql import Window

    base = F.lag("ix").over(Window.partitionBy("archive_id").orderBy("ix"))
    return blocks.delta_depths(li.withColumn("base", F.when(F.col("ix") % 4 != 0, base)))


@query("SELECT archive_id, ix, s, after FROM (SELECT l_suppkey % 16 AS archive_id, l_orderkey * 10 + l_linenumber AS ix, CAST(l_quantity AS BIGINT) AS s, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey % 16 ORDER BY l_orderkey * 10 + l_linenumber DESC) AS BIGINT) AS after FROM lineitem) WHERE after <= 3000")
def w5_recent_window(spark, d):
    li = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 16).alias("archive_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ix"), F.col("l_quantity").cast("long").alias("s"))
    return blocks.recent_window(li, most=3000)


@query("SELECT o_orderkey AS ix, CAST(o_orderkey // 6 AS BIGINT) AS stripe, CAST(o_orderkey % 6 AS INTEGER) AS slot, CAST((o_orderkey % 6) % 4 AS INTEGER) AS output FROM orders")
def w7_stripe_slot(spark, d):
    return volumes.placed(_t(spark, d, "orders").select(F.col("o_orderkey").alias("ix")), 6, 4)


@query("SELECT o_orderkey // 50 AS stripe, count(*) AS k, greatest(1, CAST(floor(count(*) * 0.1 + 0.5) AS BIGINT)) AS m FROM orders GROUP BY ALL")
def w8_stripes(spark, d):
    g = _t(spark, d, "orders").groupBy(F.expr("o_orderkey div 50").alias("stripe")).agg(F.count("*").alias("k"))
    return g.withColumn("m", F.greatest(F.lit(1).cast("long"), F.floor(F.col("k") * 0.1 + 0.5)))


@query(W_SQL + ", h AS (SELECT set_id, count(*) AS n FROM l GROUP BY set_id), q AS (SELECT set_id, ix, row_number() OVER (PARTITION BY set_id ORDER BY ix) AS r FROM w) SELECT set_id, ix FROM q LEFT JOIN h USING (set_id) WHERE r <= 4 - coalesce(n, 0)")
def w9_needed_volumes(spark, d):
    return transfer.needed(*_sets(spark, d), 4)


@query(E_SQL + ", s AS (SELECT entry_ord, size * 64 AS size, least(greatest(size * 64 // 131072, 8), 32) AS n FROM e) SELECT entry_ord, CAST(len(o) AS INTEGER) AS n, CAST(list_sum(o) AS BIGINT) AS total FROM (SELECT entry_ord, list_transform(range(0, n), lambda i: (i * greatest(size - 8192, 0) // (n - 1)) // 4 * 4) AS o FROM s)")
def w11_sample_slices(spark, d):
    o = _e(spark, d).select("entry_ord", (F.col("size") * 64).alias("size"))
    n = F.least(F.greatest(F.expr("size div 131072"), F.lit(8)), F.lit(32))
    slices = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.floor(F.floor(i * F.greatest(F.col("size") - 8192, F.lit(0)) / (n - 1)) / 4) * 4)
    return o.select("entry_ord", slices.alias("o")).select("entry_ord", F.size("o").alias("n"), F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT o_orderkey AS ix, a AS attempt, (o_custkey + a) % 5 AS peer FROM orders, (SELECT unnest([0, 1, 2]) AS a)")
def w12_failover(spark, d):
    return transfer.failover(_t(spark, d, "orders").select(F.col("o_orderkey").alias("ix"), F.col("o_custkey").alias("start")), 5, 3)


# --- order, sets ------------------------------------------------------------------------------------------------


@query(G_SQL + " SELECT entry_ord, path, line, regexp_replace(t, '\\s+$', '') AS text FROM l WHERE regexp_matches(t, 'on') ORDER BY entry_ord, line LIMIT 50")
def o2_grep_limit(spark, d):
    return entries.grep(_e(spark, d), "on", most=50)


@query(E_SQL + " SELECT entry_ord, path, lower(hex(encode(text)[1:100])) AS content, size > 100 AS truncated FROM e")
def o3_read_limit(spark, d):
    return entries.read_limited(_e(spark, d), 100).withColumn("content", F.lower(F.hex("content")))


@query(E_SQL + ", o AS (SELECT l_orderkey AS a, list(l_linenumber ORDER BY l_extendedprice, l_linenumber) AS v FROM lineitem GROUP BY ALL) SELECT a, array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ',') AS local_order FROM o")
def o5_local_order(spark, d):
    parts = F.sort_array(F.collect_list(F.struct("l_extendedprice", "l_linenumber")))
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(F.array_join(F.transform(parts, lambda x: x["l_linenumber"].cast("string")), ",").alias("local_order"))


@query(E_SQL + " SELECT path FROM e WHERE entry_ord % 2 = 0 UNION SELECT path FROM e WHERE entry_ord % 3 = 0")
def u1_union(spark, d):
    e = _e(spark, d).select("entry_ord", "path")
    return e.where("entry_ord % 2 = 0").select("path").union(e.where("entry_ord % 3 = 0").select("path")).distinct()


@query(W_SQL + " SELECT set_id, ix FROM v EXCEPT SELECT set_id, ix FROM l")
def u2_missing_volumes(spark, d):
    every, local, _ = _sets(spark, d)
    return every.exceptAll(local)


@query(B_SQL + " SELECT 'removed' AS side, path FROM (SELECT path FROM e EXCEPT SELECT path FROM b) UNION ALL SELECT 'added', path FROM (SELECT path FROM b EXCEPT SELECT path FROM e)")
def u3_added_removed(spark, d):
    e = _e(spark, d)
    a, b = e.select("path"), _b(e).select("path")
    return a.exceptAll(b).select(F.lit("removed").alias("side"), "path").union(b.exceptAll(a).select(F.lit("added"), "path"))


@query(C_SQL + " SELECT h FROM c WHERE entry_ord % 2 = 0 INTERSECT SELECT h FROM c WHERE entry_ord % 2 = 1")
def u4_shared_hashes(spark, d):
    c = _c(spark, d)
    return c.where("entry_ord % 2 = 0").select("h").intersect(c.where("entry_ord % 2 = 1").select("h"))


@query(R_SQL + " SELECT 'admitted' AS list, fp FROM (SELECT DISTINCT fp FROM r) UNION ALL SELECT 'restricted', fp FROM (SELECT fp FROM r WHERE set_id IS NOT NULL EXCEPT SELECT fp FROM r WHERE set_id IS NULL)")
def u5_allow_lists(spark, d):
    r = _rules(spark, d)
    return transfer.admitted(r).select(F.lit("admitted").alias("list"), "fp").union(transfer.restricted(r).select(F.lit("restricted"), "fp"))


# --- kernels, volumes, limits -----------------------------------------------------------------------------------


@query()
def b1_content_chunks(spark, d):
    return dedup.content_chunks(_e(spark, d), (256, 1024, 8192))


@query()
def b9_compress_best(spark, d):
    e = _e(spark, d).select(F.col("entry_ord").alias("key"), F.col("text").alias("data"))
    return blocks.compress(e, 3, 5).select("key", "codec", "clen", "ulen")


@query(E_SQL + " SELECT entry_ord AS key, h FROM e")
def b10_codec_round_trip(spark, d):
    e = _e(spark, d).select(F.col("entry_ord").alias("key"), F.col("text").alias("data"))
    return blocks.decompress(blocks.compress(e, 3, 2)).select("key", F.sha2("data", 256).alias("h"))


@query(E_SQL + " SELECT entry_ord AS key, h, TRUE AS refused FROM e")
def b11_sealed_round_trip(spark, d):
    key, other = bytes(range(32)), bytes(32)
    e = _e(spark, d).select(F.col("entry_ord").alias("key"), F.lit(0).alias("codec"), F.col("size").alias("ulen"), F.col("text").cast("binary").alias("payload"))
    sealed = blocks.seal(e, key)
    good, bad = blocks.unseal(sealed, key), blocks.unseal(sealed, other).select("key", F.col("payload").isNull().alias("refused"))
    return good.select("key", F.sha2("payload", 256).alias("h")).join(bad, "key")


@query(E_SQL + " SELECT path AS set_id, h, TRUE AS complete FROM e")
def b14_erasure_round_trip(spark, d):
    whole = _e(spark, d).select(F.col("path").alias("set_id"), F.col("text").cast("binary").alias("payload"))
    made = volumes.split(whole, 4, 2, 256)
    lost = made.where("slot not in (1, 4)")
    return volumes.joined(volumes.repaired(lost, made, 4, 2), 4).select("set_id", F.sha2("payload", 256).alias("h"), "complete")


@query("SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;') <> text AS escaped, text FROM conversations")
def b20_unescape(spark, d):
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return _t(spark, d, "conversations").select("conv_id", "turn", (esc != F.col("text")).alias("escaped"), T.unescape_xml(esc).alias("text"))


@query("SELECT p_partkey, CAST(least(greatest(pow(2, ceil(log2(greatest(ceil(p_partkey * 1000000 / 256.0), 1)))), 65536), 16777216) AS BIGINT) AS piece FROM part")
def v1_piece_size(spark, d):
    return _t(spark, d, "part").select("p_partkey", volumes.adaptive_piece_size(F.col("p_partkey") * 1000000, 4).alias("piece"))


@query("SELECT p_partkey, ix, CASE WHEN ix < 4 THEN p_partkey // 4 + CASE WHEN ix < p_partkey % 4 THEN 1 ELSE 0 END ELSE CAST(ceil(p_partkey / 4.0) AS BIGINT) END AS pieces FROM part, (SELECT unnest(range(0, 6)) AS ix)")
def v2_volume_pieces(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("ix"))
    return p.select("p_partkey", "ix", volumes.pieces_of_volume(F.col("p_partkey"), F.col("ix"), 4).alias("pieces"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'set-' || substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 8) ELSE 'docs ' || s_suppkey END || '.' || lpad(CAST(s_suppkey % 12 AS VARCHAR), 2, '0') || '.vol' AS name FROM supplier")
def v3_volume_name(spark, d):
    k = F.col("s_suppkey")
    stem = F.when(k % 3 == 0, F.concat(F.lit("../up"), k)).otherwise(F.concat(F.lit("docs "), k))
    return _t(spark, d, "supplier").select("s_suppkey", volumes.volume_name(stem, F.sha2(k.cast("string"), 256), k % 12, 12).alias("name"))


def _pieces(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select((k % 11).cast("string").alias("set_id"), F.floor(k / 77).alias("stripe"), (F.floor(k / 11) % 7).cast("int").alias("slot"), (k % 50 + 1).alias("s"), F.col("o_custkey").cast("string").cast("binary").alias("payload"))
    o = o.withColumn("is_parity", F.col("slot") > 4).withColumn("h", F.sha2("payload", 256))
    odd = F.col("s") % 5 == 0
    return o.where("s % 7 <> 0").withColumn("payload", F.when(odd, F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload"))), o.drop("payload")


V_SQL = "WITH p AS (SELECT CAST(o_orderkey % 11 AS VARCHAR) AS set_id, o_orderkey // 77 AS stripe, CAST(o_orderkey // 11 % 7 AS INTEGER) AS slot, o_orderkey // 11 % 7 > 4 AS is_parity, o_orderkey % 50 + 1 AS s FROM orders), q AS (SELECT *, CASE WHEN s % 7 = 0 THEN 'missing' WHEN s % 5 = 0 THEN 'damaged' ELSE 'ok' END AS state FROM p)"


@query(V_SQL + """, t AS (SELECT set_id, stripe, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (NOT is_parity) AS real, count(*) FILTER (state = 'damaged') AS bad, count(*) FILTER (state = 'missing') AS gone FROM q GROUP BY ALL)
SELECT set_id, CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(bad) AS BIGINT) AS damaged, CAST(sum(gone) AS BIGINT) AS missing, count(*) FILTER (ok + 4 - real < 4) AS stripes_short, count(*) FILTER (ok + 4 - real < 4) = 0 AS reconstructible FROM t GROUP BY set_id""")
def v4_set_status(spark, d):
    found, expected = _pieces(spark, d)
    return volumes.set_status(volumes.piece_states(found, expected), 4)


@query(V_SQL + " SELECT set_id, stripe, slot, is_parity, s, state FROM q")
def v5_verify_pieces(spark, d):
    return volumes.piece_states(*_pieces(spark, d))


@query(V_SQL + " SELECT set_id, count(*) FILTER (state <> 'ok') <= count(*) FILTER (is_parity) AS recoverable FROM q GROUP BY set_id")
def v10_recoverable(spark, d):
    states = volumes.piece_states(*_pieces(spark, d))
    return states.groupBy("set_id").agg((F.count_if(F.col("state") != "ok") <= F.count_if(F.col("is_parity"))).alias("recoverable"))


@query()
def t1_token_bucket(spark, d):
    ev = _t(spark, d, "events").select("event_id", "user_id", (F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("seconds"))
    return limits.token_bucket(ev, 0.6)


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey % 1000 AS b, o_orderkey % 1000 + 50 AS f FROM orders), m AS (SELECT k, b AS t, 1 AS d FROM s UNION ALL SELECT k, f, -1 FROM s),
r AS (SELECT k, sum(d) OVER (PARTITION BY k ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS live FROM m) SELECT k, CAST(max(live) AS BIGINT) AS most FROM r GROUP BY k""")
def t3_concurrency(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 1000).alias("begin"), (F.col("o_orderkey") % 1000 + 50).alias("finish"))
    return limits.concurrency(o, "k")


@query("SELECT o_orderkey AS ix FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0")
def t6_resume(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("ix"))
    payload = F.concat(F.col("ix").cast("string"), F.when(F.col("ix") % 5 == 0, "torn").otherwise("")).cast("binary")
    return transfer.resumable(o.withColumn("have", F.col("ix") % 3 == 0), o.withColumn("payload", payload), o.withColumn("h", F.sha2(F.col("ix").cast("string"), 256)))
