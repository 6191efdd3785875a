import collections
import math
import os
import random
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import language_id, mixing, quality, toxicity

SF = "/root/testdata/sf0.01"


def words(rng, n, extra=()):
    w = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n)]
    for x in extra:
        w.insert(rng.randrange(len(w) + 1), x)
    return w


@pytest.fixture(scope="module")
def corpus(spark):
    rng, docs, labels = random.Random(1), [], []
    for i in range(600):
        bad, toxic = i % 4 == 0, i % 7 == 0
        w = words(rng, rng.randint(5, 60), ["nasty" + rng.choice("abc")] * rng.randint(1, 3) if toxic else ())
        docs.append((i, " ".join(x + "###" if bad else x for x in w), "q"))
        if i % 2 or i % 3 == 0:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, None, "q"), (1001, "", "q"), (1002, "x" * 100_000, "q"), (1002, "x" * 100_000, "q"), (None, "some words", "q")]
    labels += [(1, None, None), (None, 1, 1), (5000, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(corpus):
    got = quality.scores(*corpus).collect()
    assert len(got) == 605
    right = [r["predicted"] == int(r["doc_id"] % 4 != 0) for r in got if r["held_out"] and r["doc_id"] < 600]
    assert len(right) > 100 and np.mean(right) > 0.95
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_needs_no_held_out_label(spark, corpus):
    docs, labels = corpus
    held = [r["doc_id"] for r in quality.scores(docs, labels).where("held_out").collect()]
    other = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.scores(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_one_class_or_none(spark, corpus):
    docs, labels = corpus
    assert {r["score"] > 0.99 for r in quality.scores(docs, labels.where("quality = 1")).collect()} == {True}
    assert {r["predicted"] for r in quality.scores(docs, labels.limit(0)).collect()} == {1}
    assert {r["predicted"] for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0}
    assert quality.scores(docs.limit(0), labels).count() == 0 and toxicity.scores(docs.limit(0), labels).count() == 0


def test_dual_coordinate_descent_is_optimal():
    """Against the objective's value at small random moves."""
    rng = np.random.default_rng(2)
    ptr, idx = np.arange(0, 401, 4), rng.integers(0, 30, 400)
    y = np.where(rng.random(100) < 0.5, 1, -1)
    cost, scale, norm = np.full(100, 0.5), rng.normal(size=30), np.full(100, 2.0)
    rows = np.zeros((100, 31))
    for i in range(100):
        rows[i, idx[ptr[i] : ptr[i + 1]]] = scale[idx[ptr[i] : ptr[i + 1]]] / 2
    rows[:, 30] = 1
    idx = np.concatenate([np.unique(idx[a:b]) for a, b in zip(ptr, ptr[1:])])
    ptr = np.append(0, np.cumsum([(r[:30] != 0).sum() for r in rows]))
    w, b = quality.descend(idx, ptr, scale, norm, y, cost, rounds=3000, close=1e-9)
    value = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (rows @ v))).sum()
    best = np.append(w, b)
    assert all(value(best) <= value(best + rng.normal(size=31) * s) + 1e-3 for s in (1e-3, 1e-2, 0.1) for _ in range(50))


def test_toxicity(corpus):
    got = [r for r in toxicity.scores(*corpus).collect()]
    assert len(got) == 605
    mine = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    found = {(r["predicted"], r["doc_id"] % 7 == 0) for r in mine}
    hit = sum(r["predicted"] for r in mine if r["doc_id"] % 7 == 0) / sum(r["doc_id"] % 7 == 0 for r in mine)
    false = sum(r["predicted"] for r in mine if r["doc_id"] % 7) / len(mine)
    assert hit > 0.8 and false < 0.03, (hit, false, found)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_quality_on_the_tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.op2_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9


def test_language(spark):
    rng = random.Random(4)
    voices = {"xx": "aeiou", "yy": "bcdfg", "zz": "mnprs"}
    text = lambda k, n: " ".join("".join(rng.choices(voices[k], k=4)) for _ in range(n))
    docs = [(i, text(k, 40), k) for i, k in enumerate(list(voices) * 30)] + [(900, None, "xx"), (901, "", None)]
    pages, true = [], {}
    for i in range(300):
        k = rng.choice(list(voices))
        host = f"h{'' if i % 3 else i}.example.{k}" if i % 5 else "big.example.org"
        pages.append((i, f"https://{host}/a", f"<html lang='{k if i % 4 else 'qq'}'><script>{text('xx', 50)}</script><p>{text(k, 30)}</p></html>", "c"))
        true[i] = k
    pages += [(1000, None, None, "c"), (1001, "not an address", "", "c"), (1002, "http://h.example.yy/", "<html lang=yy></html>", "c"), (1002, "http://h.example.yy/", "<html lang=yy></html>", "c"), (None, "http://x.yy", "<p>" + text("yy", 9) * 3000, "c")]
    p, d = spark.createDataFrame(pages, "page_id long, url string, html string, lang string").repartition(3), spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = language_id.identify(p, d).collect()
    assert len(got) == 305
    assert np.mean([r["lang"] == true[r["page_id"]] for r in got if r["page_id"] in true]) > 0.97
    # no text at all: host, suffix and markup decide
    assert {r["lang"] for r in got if r["page_id"] == 1002} == {"yy"}
    assert language_id.identify(p.limit(0), d).count() == 0
    with pytest.raises(ValueError):
        language_id.identify(p, d.where("lang is null"))


def test_language_of_rare_suffixes_and_declarations(spark):
    docs = spark.createDataFrame([(i, "aeio" * 20 if i % 2 else "bcdf" * 20, "xx" if i % 2 else "yy") for i in range(20)], "doc_id long, text string, lang string")
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: letters[i // 676] + letters[i // 26 % 26] + letters[i % 26]
    pages = [(2 * i + j, f"http://h{j}.{name(i)}", f"<html lang={name(i)}><p>" + "aeio" * 20) for i in range(2000) for j in range(2)]
    # less frequent than 2,000 others: on zzx the suffix decides, with zzy the declaration
    pages += [(8000, "http://a.zzx", "bcdf" * 20), (8001, "http://b.zzx", ""), (8002, "http://c.ccc", "<html lang=zzy>" + "bcdf" * 20), (8003, "http://d.ddd", "<html lang=zzy>")]
    got = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    # most pages are xx: without that evidence both would be so by more than 0.9
    assert 0.5 < got[8001]["probability"] < 0.9 and 0.5 < got[8003]["probability"] < 0.8, (got[8001], got[8003])


def test_declared_anywhere():
    assert language_id.declared("<!--" + "x" * 100_000 + "--><HTML class=a lang = ' EN-us'>") == "en"
    assert language_id.declared("<html><p lang=de><html dir=ltr lang=fr>") == "fr"
    assert language_id.declared("<html " * 100_000 + "lang=" + " " * 100_000) == ""


def test_pages_are_parsed_in_one_pass():
    assert language_id.declared("<!-- <html lang=de> --><script>'<html lang=es>'</script ><html lang=fr>") == "fr"
    assert language_id.readable("a<b>c</b><style>x</style>d<!-- e -->f&amp;<script>g") == "a c  d f& g"
    assert language_id.readable("1 < 2 and <p no end") == "1 < 2 and <p no end"
    start = time.time()
    for page in ("<script " * 200_000, "<script>" * 200_000, "<!--" * 300_000, "<" * 1_000_000, "</script" * 100_000 + "<script>" * 100_000 + ">", "<!-->" * 200_000):
        language_id.parsed(page)
    assert time.time() - start < 10


def test_fusion_is_the_plain_one(spark):
    """Posteriors with host priors and declared values, in plain Python from the same likelihoods."""
    rng = random.Random(6)
    voices = {"xx": "aeiou", "yy": "bcdfg"}
    text = lambda k, n: "".join(rng.choices(voices[k], k=n))
    docs = spark.createDataFrame([(i, text(k, 80), k) for i, k in enumerate(list(voices) * 15)], "doc_id long, text string, lang string")
    pages = [(i, f"http://h{i % 4}.{'ab'[i % 2]}", f"<html lang={rng.choice(['xx', 'yy', 'zz'])}>" * (i % 3 > 0) + text(rng.choice(list(voices)), rng.randint(0, 6))) for i in range(60)]
    got = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    langs, model, share = language_id.train(docs)
    like, post = {}, {}
    for i, _, page in pages:
        t = language_id._trigrams(language_id.readable(page).encode())
        like[i] = model[:, t].sum(1, dtype=float) * min(1, language_id.WEIGHT / max(1, len(t)))
        e = np.exp(like[i] + np.log(share))
        post[i] = e / e.sum()
    total = sum(post.values()) + share
    total = total / total.sum()
    by = lambda key: {k: sum(post[i] for i, u, h in pages if key(u, h) == k) for k in {key(u, h) for _, u, h in pages}}
    host, suffix, said = by(lambda u, _: u[7:]), by(lambda u, _: u[-1]), by(lambda _, h: language_id.declared(h))
    for i, u, page in pages:
        up = (suffix[u[-1]] + 5 * total) / (suffix[u[-1]].sum() + 5)
        rest = host[u[7:]] - post[i]
        x = like[i] + np.log((rest + 5 * up) / (rest.sum() + 5))
        d = language_id.declared(page)
        if d:
            x += np.log((said[d] + 1) / (sum(said.values()) + 1 + len(said)))
        p = np.exp(x - x.max())
        assert got[i]["lang"] == langs[int(p.argmax())] and abs(got[i]["probability"] - (p / p.sum()).max()) < 1e-6 and got[i]["declared"] == d


def test_mixing(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices([k + x for x in "abcdefg"] + ["both"], k=rng.randint(1, 80))), k) for i in range(400) for k in [rng.choice("pppq")]]
    rows = [*docs, (900, None, "p"), (901, "", "p"), (902, "word " * 20_000, "p"), (903, "pa pb", "q"), (903, "pa pb", "q"), (None, "qa qb", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    labelled = spark.createDataFrame([(i, k) for i, _, k in docs[:200]] + [(None, "p"), (5, None)], "doc_id long, domain string")
    got = mixing.mixture(df, labelled, {"p": 0.3, "q": 0.7, "none": 5.0}).collect()
    assert len(got) == len(rows)
    n, p, r = np.array([x["n_tokens"] for x in got]), np.array([x["posterior"] for x in got]), np.array([x["rate"] for x in got])
    assert sorted(n) == sorted(len((t or "").split()) for _, t, _ in rows)
    assert (r >= 0).all() and np.allclose(p.sum(1), 1)
    total = n.sum()
    assert np.abs((n * r) @ p / total - [0.3, 0.7]).max() < 1e-5
    # the same steps with numpy
    mass, goal = n @ p, np.array([0.3, 0.7]) * total
    gram = (p * n[:, None]).T @ p / np.sqrt(np.outer(mass, mass))
    step, x = 1 / np.linalg.eigvalsh(gram).max(), np.ones(len(n))
    for _ in range(60):
        if np.abs((n * x) @ p - goal).max() / total < mixing.CLOSE:
            break
        x = np.maximum(0, x - p @ (step * ((n * x) @ p - goal) / mass))
    assert np.abs(x - r).max() < 1e-4
    out = mixing.mix_documents(df, labelled, {"p": 0.3, "q": 0.7})
    assert out.columns == df.columns
    assert out.count() == sum(x["copies"] for x in got)
    with pytest.raises(ValueError):
        mixing.mixture(df, labelled.limit(0), {"p": 1.0})


def test_posteriors_are_the_plain_ones(spark):
    """Against Naive Bayes in plain Python, over the same buckets."""
    rng = random.Random(8)
    bucket = lambda w: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64_intdigest(w.encode(), seed=42)) % mixing.BUCKETS
    plain = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    docs = [(i, "".join(rng.choice(["\t", " ", "  ", "\x0b\r"]) + rng.choice([k + x for x in "abcd"] + ["both", "é"]) for _ in range(rng.randint(0, 200))), k) for i in range(120) for k in ["p" if i % 3 else "q"]]
    df = spark.createDataFrame([*docs, (500, None, None), (7, docs[7][1], "p")], "doc_id long, text string, lang string")
    names, shares, weights = mixing.model(df, df.where("doc_id < 60").select("doc_id", F.col("lang").alias("domain")))
    counts = {d: collections.Counter(bucket(w) for i, t, k in docs[:60] if k == d for w in plain(t)) for d in "pq"}
    total = {d: sum(c.values()) for d, c in counts.items()}
    assert names == ["p", "q"] and np.allclose(shares, [math.log(sum(k == d for _, _, k in docs[:60]) / 60) for d in names])
    log = lambda d, w: math.log((counts[d][bucket(w)] + 0.5) / (total[d] + 0.5 * mixing.BUCKETS))
    got = mixing.posteriors(df, names, shares, weights).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter([*range(120), 500, 7])
    for r in got:
        w = plain({i: t for i, t, _ in docs}.get(r["doc_id"]))
        x = np.array([sum(log(d, y) for y in w) * min(1, mixing.WEIGHT / max(1, len(w))) + s for d, s in zip(names, shares)])
        assert r["n_tokens"] == len(w) and np.allclose(r["posterior"], np.exp(x - x.max()) / np.exp(x - x.max()).sum(), atol=1e-4)


def test_targets_out_of_reach(spark):
    """A domain that always comes with another cannot weigh more than it: the residual says so."""
    df = spark.createDataFrame([(i, "a b c d") for i in range(40)], "doc_id long, text string")
    labelled = df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "p").otherwise("q").alias("domain"))
    with pytest.warns(UserWarning, match="no rates give these targets"):
        got = mixing.mixture(df, labelled, {"p": 0.9, "q": 0.1}).collect()
    assert all(0.3 < r["residual"] < 0.5 for r in got)


def test_mixing_to_zero_and_without_targets(spark):
    df = spark.createDataFrame([(i, "a b c" if i % 3 else "x y z") for i in range(60)], "doc_id long, text string")
    labelled = df.select("doc_id", F.when(F.col("text") == "a b c", "p").otherwise("q").alias("domain"))
    by = {r["text"]: r for r in mixing.mixture(df, labelled, {"p": 1.0}).join(df, "doc_id").collect()}
    assert by["x y z"]["rate"] < 0.05 and by["a b c"]["rate"] > 1.4
    even = {r["text"]: r["rate"] for r in mixing.mixture(df, labelled, {}).join(df, "doc_id").collect()}
    assert 0.7 < even["a b c"] < 0.8 and 1.4 < even["x y z"] < 1.6


def test_sample_is_the_plain_one(spark):
    from siltstone.llm import _labelled as L

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"))
    plain = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(300)
    assert {r[0] for r in L.sample(rows, 300).collect()} == {r[0] for r in plain.collect()}
    assert L.sample(rows, 30_000).count() == 20_000


def test_repeated_ids_stay_within_the_bound(spark):
    """A document that is there many times is one row of a sample and of what it gathers."""
    from siltstone.llm import _features
    from siltstone.llm import _labelled as L

    docs = spark.range(300).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    chosen = L.sample(docs.select("doc_id").withColumn("label", F.lit(1)), 1000)
    assert chosen.count() == 101
    got = L.gather(docs, chosen, _features.bare, 18)
    assert sorted(i for i, _, _ in got) == [7, *range(200, 300)]


def risk(w, b, rows, n_pos, prior, bounded):
    """The non-negative risk of a linear model, written out; rows: lists of buckets, positives first."""
    f = [sum(w[k] for k in r) + b for r in rows]
    loss = (lambda x: 1 / (1 + math.exp(x))) if bounded else (lambda x: math.log1p(math.exp(-x)))
    pos = sum(loss(x) for x in f[:n_pos]) / n_pos
    neg = sum(loss(-x) for x in f[n_pos:]) / (len(f) - n_pos) - prior * sum(loss(-x) for x in f[:n_pos]) / n_pos
    return prior * pos + max(0.0, neg)


def test_toxicity_fit_lowers_the_plain_risk():
    rng = np.random.default_rng(3)
    word = lambda k, n: rng.choice(np.arange(k, k + 40), n, replace=False)
    pos = [np.sort(np.append(word(0, 8), 100)) for _ in range(80)]
    unl = [np.sort(np.append(word(0, 8), 100)) if k % 5 == 0 else np.sort(word(0, 8)) for k in range(400)]
    m = toxicity.Model(8).fit(pos, unl, 0.2, ridge=0.0)
    start = risk(np.zeros(256), math.log(0.25), pos + unl, 80, 0.2, True)
    end = risk(m.weight, m.bias, pos + unl, 80, 0.2, True)
    assert end < 0.25 * start and end < 0.02
    for k in (100, None):  # no small move lowers it by more than a trace
        for s in (-0.1, 0.1):
            w = m.weight.copy()
            if k is not None:
                w[k] += s
            assert risk(w, m.bias + (0 if k is not None else s), pos + unl, 80, 0.2, True) > end - 2e-3


def test_narrow_ids(spark, corpus):
    docs, labels = corpus
    narrow = docs.where("doc_id < 100").withColumn("doc_id", F.col("doc_id").cast("int"))
    assert quality.scores(narrow, labels).count() == 100 and toxicity.scores(narrow, labels).count() == 100


KEPT = """
import re, sys
import numpy as np
from siltstone.llm import quality

class Rows:
    where = select = lambda self, *_: self

def gathered(*_):
    rng = np.random.default_rng(3)
    raw = [np.unique(rng.integers(0, 1 << 17, rng.integers(300, 1200)) + (i % 2 << 16)).astype(np.int32).tobytes() for i in range(10_000)]
    return sorted(((i, i % 2, np.frombuffer(x, np.int32)) for i, x in enumerate(raw)), key=lambda x: (x[0], x[2].tobytes()))

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

quality.L.sample, quality.L.gather = (lambda rows, most: rows), gathered
quality.F = type("F", (), {"col": lambda x: quality.F, "alias": lambda x: x, "cast": lambda x: quality.F})
quality.descend = lambda *a, f=quality.descend, **k: f(*a, **k, rounds=1)
before = mb()
model = quality.train(Rows(), Rows())
print(mb() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_fit_leaves_little_memory_behind():
    """A process of its own, as other tests leave free memory that a fit could take."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", KEPT], cwd=top, capture_output=True, text=True, timeout=120, check=True)
    assert float(got.stdout) < 30
