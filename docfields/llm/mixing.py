"""Mixing documents to target weights with soft domain membership, in DataFrame operations only.

A naive Bayes classifier over hashed words, fitted on at most ``SAMPLE`` labelled rows, gives every
document a posterior over the domains clean / low / toxic.  The rates r >= 0 of the documents minimise

    sum over domains of (expected share of tokens - target share)^2 / present share

and, of all that do, change the documents least (sum of tokens * (r - 1)^2, weight ``RIDGE`` beside the
shares).  They are found by projected gradient steps: the gradient moves the rate of every document by
sum_k p_k g_k, g being the gap of each domain's share, and rates below 0 are clipped to 0.  The sum of the
steps so far, one number G a domain, is all that is kept: a rate is max(0, 1 - sum_k p_k G_k), and no rate is
stored or sent.  The gap is scaled by the inverse of its 3 x 3 curvature over the documents with a rate above 0
(for these three unknowns, a Newton step), and the step is halved until the value falls, so it converges
whatever the spread of the posteriors.  A step is one aggregate over the narrow table of posteriors: the
expected tokens by domain and by pair of domains.  It ends at the optimum (gradient below
``OPTIMAL``); the remaining gap of targets that cannot be met (a domain that no document belongs to) is
logged.

Defined results: null or blank text has no words, the prior as posterior and takes no part in the
token totals; rows that repeat id and text get one rate each, the same; null ids are rows like any
other; labels of unknown ids or with nulls do not train; an empty table gives no rows; texts of any
length are read whole; further columns ride in a struct.
"""
from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import keyed, same_row, write_table

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.05, "toxic": 0.05}
BUCKETS, SAMPLE, EVIDENCE = 1 << 14, 20_000, 64
TOLERANCE, OPTIMAL, RIDGE = 1e-4, 1e-7, 1e-6
LOG = logging.getLogger(__name__)


def _words(d: DataFrame, *keys: str) -> DataFrame:
    """One row per word (a blank text keeps one row with bucket -1)."""
    w = d.select(*keys, F.posexplode(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+")).alias("pos", "word"))
    return w.select(*keys, "pos", F.when(F.col("word") == "", F.lit(-1)).otherwise(
        F.pmod(F.xxhash64("word"), F.lit(BUCKETS))).cast("int").alias("bucket"))


def domain_weights(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(bucket, w_<domain>...) with BUCKETS + 1 rows, and the log prior of each domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")
    chosen = F.broadcast(labels.where("doc_id is not null and toxic is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("labelled"), domain.alias("domain")).orderBy(
        F.xxhash64("labelled"), "labelled", "domain").limit(SAMPLE))  # SAMPLE rows at most
    d = keyed(docs)
    rows = d.join(chosen, d["doc_id"] == chosen["labelled"]).select("domain", "text")
    prior = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    seen = _words(rows, "domain").where("bucket >= 0")
    counts = write_table(seen.groupBy("bucket").agg(
        *[F.count(F.when(F.col("domain") == k, 1)).alias(k) for k in DOMAINS]), "domain-counts")
    totals = counts.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in DOMAINS]).first()
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    weight = every.join(counts, "bucket", "left").select("bucket", *[
        F.log((F.coalesce(F.col(k), F.lit(0)) + 1) / F.lit(float(totals[k] + BUCKETS))).alias(f"w_{k}") for k in DOMAINS])
    blank = docs.sparkSession.range(1).select(F.lit(-1).alias("bucket"), *[F.lit(0.0).alias(f"w_{k}") for k in DOMAINS])
    n = sum(prior.values()) + len(DOMAINS)
    return write_table(weight.union(blank), "domain-weights"), {k: math.log((prior.get(k, 0) + 1) / n) for k in DOMAINS}


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, tkey, copies, n_words, p_clean, p_low, p_toxic); copies counts repeated rows."""
    weight, prior = domain_weights(docs, labels)
    w = _words(keyed(docs), "doc_id", "tkey").join(F.broadcast(weight), "bucket")  # BUCKETS + 1 rows
    per = w.groupBy("doc_id", "tkey").agg(
        F.count(F.when(F.col("pos") == 0, 1)).alias("copies"), F.count(F.when(F.col("bucket") >= 0, 1)).alias("n"),
        *[F.sum(f"w_{k}").alias(k) for k in DOMAINS])
    # mean evidence a word, counted for at most EVIDENCE words: posteriors stay soft for long texts
    n = F.greatest(F.col("n"), F.lit(1))
    per = per.withColumn("n_words", F.expr("n div copies"))
    log = {k: F.lit(prior[k]) + F.col(k) / n * F.least(F.col("n_words"), F.lit(EVIDENCE)) for k in DOMAINS}
    top = F.greatest(*log.values())
    odds = {k: F.exp(v - top) for k, v in log.items()}
    total = sum(odds.values(), F.lit(0.0))
    return per.select("doc_id", "tkey", "copies", "n_words", *[(odds[k] / total).alias(f"p_{k}") for k in DOMAINS])


def _rate(gradient: list[float]) -> Column:
    """Rate of a document after gradients that add up to ``gradient``."""
    pull = sum((F.col(f"p_{k}") * F.lit(float(g)) for k, g in zip(DOMAINS, gradient)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.lit(1.0) - pull)


def _token_shares(p: DataFrame, tokens: Column) -> tuple[int, np.ndarray]:
    """All tokens, and the present share of each domain."""
    row = p.agg(F.sum(tokens).alias("n"), *[F.sum(tokens * F.col(f"p_{k}")).alias(k) for k in DOMAINS]).first()
    n = row["n"] or 0
    return n, np.array([(row[k] or 0.0) / n if n else 0.0 for k in DOMAINS])


def solve_rates(p: DataFrame, targets: dict[str, float]) -> list[float]:
    """G by domain: minimum of sum n r(G)^2 / 2N + goal G + RIDGE / 2 sum present G^2, by damped Newton steps."""
    tokens, pairs = F.col("copies") * F.col("n_words"), [(i, j) for i in range(len(DOMAINS)) for j in range(i + 1)]
    n, present = _token_shares(p, tokens)
    if not n:
        return [0.0] * len(DOMAINS)
    goal = np.array([targets[k] / sum(targets.values()) for k in DOMAINS])

    def look(g):
        """Value, gradient, curvature and shares at ``g``."""
        rate = _rate(g.tolist())
        live = F.when(rate > 0, tokens).otherwise(0)
        row = p.agg(F.sum(tokens * rate * rate), *[F.sum(tokens * F.col(f"p_{k}") * rate) for k in DOMAINS],
                    *[F.sum(live * F.col(f"p_{DOMAINS[i]}") * F.col(f"p_{DOMAINS[j]}")) for i, j in pairs]).first()
        v = np.array(row, float) / n
        share, bend = v[1:4], np.zeros((len(DOMAINS),) * 2)
        for (i, j), x in zip(pairs, v[4:]):
            bend[i, j] = bend[j, i] = x
        pull = RIDGE * present
        return (v[0] / 2 + goal @ g + pull @ (g * g) / 2, np.where(present > 0, goal - share + pull * g, 0.0),
                bend + np.diag(pull), share)
    g = np.zeros(len(DOMAINS))
    value, slope, bend, share = look(g)
    while np.abs(slope).max() > OPTIMAL:
        step = np.linalg.lstsq(bend, -slope, rcond=None)[0]
        size, fall = 1.0, slope @ step
        while size > 1e-4:
            new = look(g + size * step)
            if new[0] < value and new[0] <= value + 1e-4 * size * fall:
                break
            size /= 2
        else:  # no lower value within the precision of the sums
            LOG.warning("mixing: stopped at gradient %.3g", np.abs(slope).max())
            break
        g = g + size * step
        value, slope, bend, share = new
    if np.abs(share - goal).max() > TOLERANCE:
        LOG.warning("mixing: shares %s miss the targets %s", dict(zip(DOMAINS, share)), dict(zip(DOMAINS, goal)))
    return g.tolist()


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, tkey, copies, n_words, p_..., rate, times): ``times`` is the whole part of the rate plus
    one where a hash of the row falls below its fraction."""
    p = write_table(posteriors(docs, labels), "posteriors")
    out = p.withColumn("rate", _rate(solve_rates(p, targets or TARGETS)))
    draw = F.pmod(F.xxhash64("doc_id", "tkey", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn("times", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def mixing_table(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, posteriors, rate and times."""
    r = mixing_rates(docs, labels, targets)
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "n_words", *[f"p_{k}" for k in DOMAINS], "rate", "times")


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with each row repeated ``times`` times (not at all where that is 0)."""
    r = mixing_rates(docs, labels, targets).where("times > 0").select("doc_id", "tkey", "times")
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64(text).alias("tkey"))
    hit = d.join(r.hint("shuffle_hash"), same_row(d, r)).select("row", "times")
    return hit.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("i")).select("row.*")
