"""Language ID by Bayesian evidence fusion over web pages.

Four kinds of evidence give one posterior a page:

* text: a Naive Bayes model of byte trigrams, learnt from a bounded sample of documents with known languages, reads
  the whole page without its markup; a long text counts for at most `WEIGHT` trigrams, or it would drown the rest;
* the language that the markup declares: P(value | language), from grouped sums of the text posteriors over all pages;
* a prior of the host: grouped sums of the text posteriors of its pages (less the page's own), smoothed towards its
  suffix, and that towards all pages;
* the suffix of the address, through the host's prior only: with weight `KAPPA`, so it says little on hosts of many pages.

Sums are grouped with partial aggregates; only the table of languages by declared values (two or three letters) is
broadcast, suffixes meet their hosts and hosts their pages in joins that AQE can split.

Cases: null or empty pages have no text evidence and get what host and address say, or the sample's shares; null or
odd addresses have host and suffix ''; a null page_id is judged like others; rows that repeat an id are judged each;
other columns are ignored; ties go to the first language by name; an empty table gives an empty result; a sample
without any language is a ValueError.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _labelled as L
from . import _text as X
from ._features import LOWER
from ._spark import materialize, table, tune

SAMPLE, BITS, WEIGHT, KAPPA = 4_000, 16, 200.0, 5.0
_OPEN = re.compile(r"<(script|style|noscript)\b", re.I)
_CLOSE = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript")}
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*(?:[\"']\s*)?([A-Za-z]{2,3})\b", re.I)


def parsed(page: str) -> tuple[str, str]:
    """A page's text without markup, scripts and comments, and the language of the first html tag that has one.

    One pass: what has no end is searched for it once, and then is a tag like others, or text where no tag ends.
    """
    out, at, said, endless = [], 0, "", set()

    def ends(what: str, found) -> int:
        if what in endless or found is None:
            endless.add(what)
            return -1
        return found

    while (tag := page.find("<", at)) >= 0:
        out.append(page[at:tag])
        at = -1
        if page.startswith("<!--", tag):
            at = -1 if "-->" in endless else page.find("-->", tag + 4)
            at = ends("-->", at + 3 if at >= 0 else None)
        elif skip := _OPEN.match(page, tag):
            name = skip[1].lower()
            close = None if name in endless else _CLOSE[name].search(page, skip.end())
            at = ends(name, close and close.end())
        if at < 0:
            at = page.find(">", tag) + 1
            if not at:
                return html.unescape("".join((*out, page[tag:]))), said or _said(page, tag, len(page))
            said = said or _said(page, tag, at - 1)
        out.append(" ")
    out.append(page[at:])
    return html.unescape("".join(out)), said


def _said(page: str, tag: int, end: int) -> str:
    found = _HTML.match(page, tag) and _LANG.search(page, tag + 5, end)
    return found[1].lower() if found else ""


def readable(page: str) -> str:
    """A page's text without markup, scripts and comments."""
    return parsed(page)[0]


def declared(page: str) -> str:
    """The language of the first html tag that has one, anywhere in the page but in comments and scripts."""
    return parsed(page)[1]


def _trigrams(text: bytes) -> np.ndarray:
    d = LOWER[np.frombuffer(text, np.uint8)].astype(np.int64)
    if len(d) < 3:
        return d[:0]
    return (d[:-2] * 40503 + d[1:-1] * 30011 * 257 + d[2:] * 65599 * 4099) & (1 << BITS) - 1


def train(docs: DataFrame, most: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log P(trigram | language) and the sample's shares, from at most `most` of docs (doc_id, text, lang)."""
    tune(docs.sparkSession)
    known = docs.where("doc_id is not null and lang is not null")
    chosen = L.sample(known.select("doc_id", "lang"), most)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(_trigrams((text or "").encode()), minlength=1 << BITS)
                docs_of[lang] = docs_of.get(lang, 0) + 1
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(s[at].astype(np.int64)), pa.array([docs_of[lang]] + [0] * (len(at) - 1))] if len(at) else [pa.array([lang]), pa.array([0]), pa.array([0]), pa.array([docs_of[lang]])], ["lang", "bucket", "n", "docs"])

    counted = known.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").select("lang", "text")
    got = counted.mapInArrow(rows, "lang string, bucket long, n long, docs long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toArrow().to_pandas()
    langs = sorted(got["lang"].unique())
    if not langs:
        raise ValueError("no document has a language")
    share = np.array([got.loc[got["lang"] == x, "docs"].sum() for x in langs], float)
    p = np.full((len(langs), 1 << BITS), 0.5)
    for k, x in enumerate(langs):
        part = got[got["lang"] == x]
        p[k, part["bucket"].to_numpy()] += part["n"].to_numpy()
    return langs, np.log(p / p.sum(1, keepdims=True)).astype(np.float32), share / share.sum()


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def identify(pages: DataFrame, docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row a page: page_id, lang, probability, text_lang, declared, host; docs: doc_id, text, lang."""
    spark = pages.sparkSession
    langs, model, share = train(docs, most)
    many, shared = len(langs), spark.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for b in batches:
            like, said = [], []
            for page in b.column(2).to_pylist():
                text, value = parsed(page or "")
                t = _trigrams(text.encode("utf-8", "replace"))
                like.append((table_[:, t].sum(1, dtype=np.float64) * min(1.0, WEIGHT / max(1, len(t)))).tolist())
                said.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(like, pa.list_(pa.float64()))], ["page_id", "host", "declared", "likelihood"])

    seen = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), "html").mapInArrow(read, "page_id long, host string, declared string, likelihood array<double>")
    seen = seen.withColumn("suffix", F.when(F.col("host").rlike(r"\.[a-z]+$"), F.regexp_extract("host", r"([a-z]+)$", 1)).otherwise(""))
    logs = [F.col("likelihood")[k] + F.lit(float(np.log(share[k]))) for k in range(many)]
    top = F.greatest(*logs) if many > 1 else logs[0]
    seen = seen.withColumn("post", F.array(*(F.exp(x - top) for x in logs)))
    seen = seen.withColumn("post", F.transform("post", lambda x: x / F.aggregate("post", F.lit(0.0), lambda a, y: a + y)))
    seen = materialize(seen, "pages")

    def sums(*by: str) -> DataFrame:
        return seen.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(many)))

    total = sums().first()
    of_all = np.array([total[f"s{k}"] or 0.0 for k in range(many)]) + share
    of_all = of_all / of_all.sum()
    got = sums("declared").collect()  # values of two or three letters
    s = np.array([[r[f"s{k}"] for k in range(many)] for r in got]).reshape(len(got), many)
    p = (s + 1.0) / (s.sum(0) + 1.0 + len(got))
    given = {r["declared"]: np.log(p[i]) for i, r in enumerate(got)}
    given.pop("", None)  # nothing declared says nothing
    known = spark.sparkContext.broadcast((given, of_all))
    every = F.array(*(F.col(f"s{k}") for k in range(many)))
    hosts = materialize(sums("host", "suffix").select("host", "suffix", every.alias("sums")), "hosts")
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(many))).select("suffix", every.alias("above"))
    hosts = materialize(hosts.join(materialize(suffixes, "suffixes"), "suffix").select("host", "sums", "above"), "priors")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, of_all = known.value
        for b in batches:
            n = b.num_rows
            text, post, host, above = (np.array(b.column(k).to_pylist(), float).reshape(n, many) for k in (3, 4, 5, 6))
            said = b.column(2).to_pylist()
            rest = np.maximum(host - post, 0)
            up = (above + KAPPA * of_all) / (above.sum(1, keepdims=True) + KAPPA)
            x = text + np.log((rest + KAPPA * up) / (rest.sum(1, keepdims=True) + KAPPA))
            zero = np.zeros(many)
            x += np.array([given.get(v, zero) for v in said]).reshape(n, many)
            p = _softmax(x)
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([langs[i] for i in best], pa.string()), pa.array(p[np.arange(n), best]), pa.array([langs[i] for i in post.argmax(1)], pa.string()), b.column(2), b.column(1)],
                ["page_id", "lang", "probability", "text_lang", "declared", "host"],
            )

    met = seen.join(hosts, "host").select("page_id", "host", "declared", "likelihood", "post", "sums", "above")
    return met.mapInArrow(fuse, "page_id long, lang string, probability double, text_lang string, declared string, host string")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op9_language_id": op9_language_id}, {}
