"""Mixing sources to target weights with DataFrame functions only: soft domains, rates by projected-gradient least squares.

1. A Naive Bayes model over hashed words, counted from a bounded sample of a labelled table, gives every document a
   posterior over the domains (`posteriors`).  A long text counts for at most `WEIGHT` words, so posteriors stay soft.
2. Every document gets a rate >= 0, starting from 1, such that the expected tokens of each domain, the sum over
   documents of rate x tokens x posterior, come to the target weights' shares of all tokens.  Each step is one grouped
   sum of as many numbers as there are domains; the gradient step and the projection on rates >= 0 are a column
   expression of the numbers so far, so no state but those few numbers is kept on the driver.  The squares are weighted
   by the domains' sizes and rates are measured by tokens, which makes steps nearly independent of the sizes.
3. `copies` rounds the rate with a hash of the id, so that its expectation is the rate; `residual` is the largest error
   of a domain's expected total, as a share of all tokens, that the fit has left (0 nearly, unless no rates give the
   targets, of which a warning tells).

Words are counted within documents before anything is shuffled: one row a document and task.

Cases: null and empty texts have no tokens, the sample's shares as posterior and a rate like any other; a null id is a
document like others; rows that repeat an id and a text get one result each, equal; rows that repeat an id with other
texts are documents of their own; labelled rows with a null domain teach nothing; a sample without any domain, or with
more than `DOMAINS`, is a ValueError; target weights of domains that do not occur are left out, domains without one get
0, and if none is left all domains weigh the same; other columns are ignored, or kept by `mix_documents` (whose own
start with `__m_`); empty tables give empty results.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _labelled as L
from ._spark import materialize, table

SAMPLE, BUCKETS, DOMAINS, WEIGHT, STEPS, CLOSE = 4_000, 1 << 14, 64, 64.0, 60, 1e-6
#: Steps between written rates, and the relative error of a domain's total from which the caller is warned.
WRITE, FAR = 8, 1e-3
#: Weights of the registered query, by language.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def _words() -> Column:
    return F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")


def _bucket() -> Column:
    return F.expr(f"cast(pmod(xxhash64(word), {BUCKETS}) as int)").alias("bucket")


def model(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE) -> tuple[list[str], list[float], DataFrame]:
    """Domains, log shares, and a row with an array w0, w1, ... of log P(bucket | domain) for each domain; docs: doc_id, text; labelled: doc_id, domain.

    Of rows that repeat a labelled id one text is read, the one with the least hash, so the sample bounds what is read.
    """
    chosen = L.sample(labelled.where("doc_id is not null and domain is not null").select("doc_id", F.col("domain").cast("string").alias("domain")).dropDuplicates(), most)
    one = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select("domain", F.posexplode(_words()).alias("pos", "word"))
    counts = rows.groupBy("domain", _bucket()).agg(F.sum((F.col("word") != "").cast("long")).alias("n"), F.sum((F.col("pos") == 0).cast("long")).alias("docs"))
    counts = materialize(counts, "counts")
    of = {r["domain"]: (r["n"] or 0, r["docs"] or 0) for r in counts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).limit(DOMAINS + 1).collect()}
    if not of or len(of) > DOMAINS:
        raise ValueError(f"the labelled rows have {'no domain' if not of else f'more than {DOMAINS} domains'}")
    names = sorted(of)
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    wide = counts.groupBy("bucket").agg(*(F.sum(F.when(F.col("domain") == d, F.col("n"))).alias(f"c{k}") for k, d in enumerate(names)))
    logs = [F.log((F.coalesce(f"c{k}", F.lit(0)) + 0.5) / (of[d][0] + 0.5 * BUCKETS)).alias(f"w{k}") for k, d in enumerate(names)]
    rows = F.array_sort(F.collect_list(F.struct("bucket", *(f"w{k}" for k in range(len(names))))))
    one = every.join(wide, "bucket", "left").select("bucket", *logs).agg(rows.alias("rows"))
    total = sum(n for _, n in of.values())
    shares = [math.log(max(of[d][1], 1) / max(total, 1)) for d in names]
    return names, shares, materialize(one.select(*(F.col(f"rows.w{k}").alias(f"w{k}") for k in range(len(names)))), "weights")


def posteriors(docs: DataFrame, names: list[str], shares: list[float], weights: DataFrame) -> DataFrame:
    """One row a document: doc_id, key (a hash of the text), n_tokens, posterior (array, by `names`); docs: doc_id, text.

    Weights come as scalar subqueries, arrays of BUCKETS numbers a domain, so a word is looked up by its position, in
    generated code, without a join.
    """
    many = len(names)
    tables = [weights.select(f"w{k}").scalar() for k in range(many)]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))  # before the words: it would be hashed anew for each
    words = keyed.select("doc_id", "key", F.posexplode(_words()).alias("pos", "word"))
    met = words.select("doc_id", "key", "pos", F.when(F.col("word") != "", _bucket()).alias("bucket"))
    solid = F.col("bucket").isNotNull()
    sums = met.groupBy("doc_id", "key").agg(F.sum((F.col("pos") == 0).cast("long")).alias("rows"), F.sum(solid.cast("long")).alias("n"), *(F.sum(F.when(solid, t[F.col("bucket")]).otherwise(0.0)).alias(f"w{k}") for k, t in enumerate(tables)))
    sums = sums.withColumn("n", F.expr("n div rows"))
    scale = F.least(F.lit(1.0), F.lit(WEIGHT) / F.greatest("n", F.lit(1))) / F.col("rows")
    logs = sums.select("doc_id", "key", "rows", F.col("n").alias("n_tokens"), *(F.round(F.col(f"w{k}") * scale, 6).alias(f"w{k}") for k in range(many)))
    logs = logs.select("doc_id", "key", "rows", "n_tokens", *((F.col(f"w{k}") + shares[k]).alias(f"w{k}") for k in range(many)))
    top = F.greatest(*(F.col(f"w{k}") for k in range(many))) if many > 1 else F.col("w0")
    exps = logs.select("doc_id", "key", "rows", "n_tokens", *(F.exp(F.col(f"w{k}") - top).alias(f"p{k}") for k in range(many)))
    total = sum((F.col(f"p{k}") for k in range(1, many)), F.col("p0"))
    out = exps.select("doc_id", "key", "n_tokens", F.array(*(F.col(f"p{k}") / total for k in range(many))).alias("posterior"), F.explode(F.expr("sequence(1L, rows)")).alias("nth"))
    return out.drop("nth")


def _largest(gram: list[list[float]]) -> float:
    """The largest eigenvalue of a small matrix that is symmetric and not negative, by the power method."""
    v = [1.0] * len(gram)
    size = 0.0
    for _ in range(200):
        u = [sum(a * b for a, b in zip(row, v)) for row in gram]
        size = max(map(abs, u), default=0.0)
        if not size:
            return 1.0
        v = [x / size for x in u]
    return size


def rates(found: DataFrame, names: list[str], targets: dict[str, float], steps: int = STEPS) -> tuple[DataFrame, list[float]]:
    """found with `rate`, and the relative errors that are left; found: n_tokens, posterior, and others."""
    many = len(names)
    p = [F.col("posterior")[k] for k in range(many)]
    pairs = [(i, j) for i in range(many) for j in range(i, many)]
    first = found.agg(*(F.sum(F.col("n_tokens") * x).alias(f"m{k}") for k, x in enumerate(p)), *(F.sum(F.col("n_tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
    mass = [first[f"m{k}"] or 0.0 for k in range(many)]
    total = sum(mass)
    goal = [max(targets.get(d, 0.0), 0.0) if m > 0 else 0.0 for d, m in zip(names, mass)]
    goal = [g / sum(goal) * total for g in goal] if sum(goal) else [m and total / sum(1 for x in mass if x) for m in mass]
    if not total:
        return found.withColumn("rate", F.lit(1.0)), [0.0] * many
    size = [math.sqrt(m) or 1.0 for m in mass]
    gram = [[0.0] * many for _ in names]
    for i, j in pairs:
        gram[i][j] = gram[j][i] = (first[f"g{i}_{j}"] or 0.0) / size[i] / size[j]
    step = 1.0 / _largest(gram)
    rate, now, error = F.lit(1.0), mass, [0.0] * many
    for k in range(steps + 1):
        error = [(a - b) / total for a, b in zip(now, goal)]
        if k == steps or max(map(abs, error)) < CLOSE:
            break
        if k and k % WRITE == 0:  # or expressions would grow with the steps
            found, rate = materialize(found.withColumn("rate", rate), "rates"), F.col("rate")
        pull = [step * (a - b) / s / s for a, b, s in zip(now, goal, size)]
        rate = F.greatest(F.lit(0.0), rate - sum((x * F.lit(g) for x, g in zip(p[1:], pull[1:])), p[0] * F.lit(pull[0])))
        got = found.agg(*(F.sum(F.col("n_tokens") * rate * x).alias(f"m{i}") for i, x in enumerate(p))).first()
        now = [got[f"m{i}"] for i in range(many)]
    if max(map(abs, error)) >= FAR:
        warnings.warn(f"no rates give these targets; relative errors of the totals: {dict(zip(names, error))}")
    return found.withColumn("rate", rate), error


def mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], most: int = SAMPLE) -> DataFrame:
    """One row a document: doc_id, key, n_tokens, posterior, rate, copies, residual; docs: doc_id, text; labelled: doc_id, domain."""
    docs = docs.select(F.col("doc_id"), F.col("text"))
    names, shares, weights = model(docs, labelled, most)
    found, error = rates(materialize(posteriors(docs, names, shares, weights), "posteriors"), names, targets)
    chance = F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 30)) / float(1 << 30)
    return found.withColumn("copies", F.floor(F.col("rate") + chance).cast("int")).withColumn("residual", F.lit(max(map(abs, error))))


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], most: int = SAMPLE) -> DataFrame:
    """The documents with all their columns, each as often as its `copies` says; needs doc_id and text."""
    made = mixture(docs, labelled, targets, most).select(F.col("doc_id").alias("__m_id"), F.col("key").alias("__m_key"), F.col("copies").alias("__m_copies"))
    made = made.where("__m_copies > 0").dropDuplicates(["__m_id", "__m_key"])
    met = docs.withColumn("__m_hash", F.xxhash64("text")).join(made.hint("shuffle_hash"), F.expr("doc_id <=> __m_id and __m_hash = __m_key"))
    return met.withColumn("__m_nth", F.explode(F.expr("sequence(1, __m_copies)"))).select(*docs.columns)


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the documents in the table of labels, by language."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixture(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), TARGETS).drop("key")


QUERIES, SQL = {"op8_source_mixing": op8_source_mixing}, {}
