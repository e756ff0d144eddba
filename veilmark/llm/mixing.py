"""Mixing sources to target weights with soft membership, in DataFrame expressions only.

A naive Bayes classifier over hashed words, fitted on the labelled table, gives each document's posterior over
the domains clean, low and toxic. Projected gradient descent then fits a nonnegative rate per document so that
the expected tokens of each domain, the sum of rate * tokens * posterior, meet their targets in the least
squares sense. Each step is one sum over all documents; the rates are a fold over the steps' gradients, so
nothing per document is kept between steps. A rate becomes whole copies by a hash of the document.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .quality_rules import word_list

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.9, "low": 0.06, "toxic": 0.04}
BUCKETS, MAX_LABELLED, STEPS, TOLERANCE = 1 << 16, 20_000, 40, 1e-6


def _bucketed(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.explode(word_list(F.lower("text"))).alias("w")).select(*keys, F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b"))


def classifier(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[DataFrame, list[float]]:
    """(b, l_clean, l_low, l_toxic): log odds of a bucket in a domain against all text; and the domains' log priors.

    At most ``most`` labelled rows are used, those of smallest hash of doc_id; the table has BUCKETS rows at most.
    """
    q, t = F.col("quality"), F.col("toxic")
    domain = F.when(t == 1, "toxic").when(q == 0, "low").when(q == 1, "clean")
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most)
    seen = docs.join(F.broadcast(picked), "doc_id")  # at most ``most`` rows of about 20 bytes
    sizes = {r.domain: r.n for r in picked.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values()) + len(DOMAINS)
    counts = cut(_bucketed(seen, "domain").groupBy("b").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS)))
    sums = counts.agg(*(F.sum(d).alias(d) for d in DOMAINS)).first()
    sums = {d: (sums[d] or 0) for d in DOMAINS}
    everything = reduce(lambda a, b: a + b, (F.col(d) for d in DOMAINS))
    odds = [F.log(((F.col(d) + everything / max(1, sum(sums.values()))) / (sums[d] + 1)) / (everything / max(1, sum(sums.values())))).alias(f"l_{d}") for d in DOMAINS]
    return counts.select("b", *odds), [math.log((sizes.get(d, 0) + 1) / total) for d in DOMAINS]


def posteriors(df: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, h, n_tokens, p_clean, p_low, p_toxic) per distinct (doc_id, hash of text). No words: the priors."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    weights, priors = classifier(docs, labels, most)
    words = _bucketed(docs.withColumn("d", F.coalesce("doc_id", F.lit(-1))).withColumn("none", F.col("doc_id").isNull()), "d", "none", "h")
    words = words.join(F.broadcast(weights), "b", "left")
    sums = words.groupBy("d", "none", "h").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(f"l_{d}"), F.lit(0.0)).alias(f"s_{d}") for d in DOMAINS))
    sums = sums.withColumn("doc_id", F.when(~F.col("none"), F.col("d")))
    rows = docs.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    out = rows.join(sums, rows.doc_id.eqNullSafe(sums.doc_id) & (rows.h == sums.h), "left").select(rows.doc_id, rows.h, "rows", (F.coalesce("n", F.lit(0)) / F.col("rows")).cast("long").alias("n_tokens"), *(F.coalesce(f"s_{d}", F.lit(0.0)).alias(f"s_{d}") for d in DOMAINS), F.greatest(F.lit(1.0), F.sqrt(F.coalesce("n", F.lit(0)).cast("double"))).alias("root"))
    logits = [F.lit(p) + F.col(f"s_{d}") / F.col("root") for d, p in zip(DOMAINS, priors, strict=True)]
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    norm = reduce(lambda a, b: a + b, powers)
    return out.select("doc_id", "h", "rows", "n_tokens", *((p / norm).alias(f"p_{d}") for d, p in zip(DOMAINS, powers, strict=True)))


def _rate(steps: list[list[float]]) -> Column:
    """max(0, rate - p . g) for each step's gradient g, from rate 1."""
    if not steps:
        return F.lit(1.0)
    past = F.expr("array(" + ",".join("named_struct(" + ",".join(f"'{d}', {x!r}D" for d, x in zip(DOMAINS, g, strict=True)) + ")" for g in steps) + ")")
    return F.aggregate(past, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - reduce(lambda a, b: a + b, (F.col(f"p_{d}") * g[d] for d in DOMAINS))))


def copies_of(rate: Column) -> Column:
    """A whole number whose mean over documents (doc_id, h) of one rate is that rate, drawn by their hash."""
    u = F.pmod(F.xxhash64("doc_id", "h", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def mix(df: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, most: int = MAX_LABELLED, steps: int = STEPS) -> DataFrame:
    """doc_id, h, n_tokens, p_clean, p_low, p_toxic, rate, copies, off_target per distinct (doc_id, text) of df.

    Targets: weights times a total at which clean text keeps its own token count, so clean documents get rates
    near 1 and the others what their weight leaves. copies is the whole part of rate plus one where a hash of
    the document falls under the fraction, so the copies expected of each document are its rate, and those of
    each domain meet its target as the rates do. Log odds of a document's words are divided by the square root of their
    number, since words of one text are not independent. Descent ends when every domain is within TOLERANCE of its target,
    relative to its own tokens, or after steps; off_target, the same in all rows, says how far the worst domain is,
    so a fit that did not get there shows (no rates can give text of one kind the shares of three). A null text is empty: no tokens, the priors. Rows equal in doc_id and
    text share one row here (h is the text's hash). An empty table gives an empty one; other columns are ignored.
    """
    weights = weights or WEIGHTS
    p = cut(posteriors(df, labels, most))
    mass = F.col("n_tokens") * F.col("rows")

    def tokens(rate: Column) -> list[float]:
        r = p.withColumn("r", rate).agg(*(F.sum(F.col("r") * mass * F.col(f"p_{d}")).alias(d) for d in DOMAINS)).first()
        return [float(r[d] or 0.0) for d in DOMAINS]

    own = tokens(F.lit(1.0))
    share = sum(weights.values())
    total = own[0] / (weights["clean"] / share)
    target = [total * weights[d] / share for d in DOMAINS]
    past: list[list[float]] = []
    now = own
    for k in range(steps + 1):
        gap = [(e - t) / max(n, 1.0) for e, t, n in zip(now, target, own, strict=True)]
        off = max(map(abs, gap))
        if off < TOLERANCE or k == steps:
            break
        past.append(gap)
        now = tokens(_rate(past))
    rate = _rate(past)
    out = p.withColumn("rate", rate)
    return out.select("doc_id", "h", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", copies_of(F.col("rate")).alias("copies"), F.lit(off).alias("off_target"))
