"""Naive Bayes on long tables: counts per class are conditional sums of one groupBy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, with_stats
from .terms import lookup, vocab_top


def class_totals(terms: DataFrame, value="cnt", label="label") -> DataFrame:
    """(block, term, df, c0, c1): per-class sums side by side, so zero cells need no filling."""
    of = lambda c: F.sum(F.when(F.col(label) == c, F.col(value)).otherwise(0)).alias(f"c{c}")
    return terms.groupBy("block", "term").agg(F.count(F.lit(1)).alias("df"), of(0), of(1))


def multinomial_model(terms, alpha=1.0, max_vocab=None, label="label") -> DataFrame:
    """Lidstone-smoothed class log-probabilities lp0, lp1 per term."""
    t = class_totals(terms, label=label)
    t = cut_lineage(t)  # counted once; totals and weights read the table
    if max_vocab:
        t = vocab_top(t.withColumn("cf", F.col("c0") + F.col("c1")), max_vocab, "cf").drop("cf")
    tot = t.agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"), F.count(F.lit(1)).alias("v"))
    lp = lambda c: F.log((F.col(f"c{c}") + alpha) / (F.col(f"t{c}") + F.lit(alpha) * F.col("v"))).alias(f"lp{c}")
    return with_stats(t, tot).select("block", "term", "df", "c0", "c1", lp(0), lp(1))


def prior_gap(docs, label="label") -> DataFrame:
    """One row: log P(1) - log P(0)."""
    n = lambda c: F.sum(F.when(F.col(label) == c, 1).otherwise(0))
    return docs.agg(F.log(n(1) / n(0)).alias("prior_gap"))


def score(docs, terms, model, prior=None) -> DataFrame:
    """Log-odds per document; a document without a known term keeps the prior."""
    hit = lookup(terms, model.select("block", "term", "df", (F.col("lp1") - F.col("lp0")).alias("w")))
    s = hit.groupBy("doc_id").agg(F.sum(F.col("cnt") * F.col("w")).alias("s"))
    out = docs.select("doc_id").join(s, "doc_id", "left")
    if prior is None:
        return out.select("doc_id", F.coalesce("s", F.lit(0.0)).alias("margin"))
    return with_stats(out, prior).select(
        "doc_id", (F.coalesce("s", F.lit(0.0)) + F.col("prior_gap")).alias("margin"))


def sigmoid(x, clip=500.0):
    z = F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))
    return 1.0 / (1.0 + F.exp(-z))


def logit(p, eps=1e-9):
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(q / (1 - q))


def logsumexp(*cols):
    top = F.greatest(*cols)
    return top + F.log(sum((F.exp(c - top) for c in cols[1:]), F.exp(cols[0] - top)))


def gaussian_score(long, stats) -> DataFrame:
    """Log-odds under per-class normals; ``stats`` has one row per class and feature."""
    wide = stats.groupBy("feature").agg(*[
        F.max(F.when(F.col("label") == c, F.col(k))).alias(f"{k}{c}")
        for c in (0, 1) for k in ("mean", "var", "log_prior")])
    j = long.join(F.broadcast(wide), "feature")
    ll = lambda c: (-0.5 * F.log(2 * math.pi * F.col(f"var{c}"))
                    - (F.col("value") - F.col(f"mean{c}")) ** 2 / (2 * F.col(f"var{c}")))
    return j.groupBy("doc_id").agg(
        (F.sum(ll(1) - ll(0)) + F.max("log_prior1") - F.max("log_prior0")).alias("margin"))


def opinion_pool(p_style, p_word, weight=0.5):
    """Weighted mean of log-odds, back to a probability."""
    return sigmoid(weight * logit(p_style) + (1 - weight) * logit(p_word))


def log_ratio(vectors, alpha=1.0, binary=False, block=None, label="label") -> DataFrame:
    """r = log of the normalised class sums; terms outside ``block`` keep r = 1."""
    v = F.lit(1.0) if binary else F.col("value")
    of = lambda c: (F.lit(float(alpha)) + F.sum(F.when(F.col(label) == c, v).otherwise(0.0))).alias("pq"[1 - c])
    t = cut_lineage(vectors.groupBy("block", "term").agg(F.count(F.lit(1)).alias("df"), of(1), of(0)))
    used = t if block is None else t.where(F.col("block") == block)
    tot = used.agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    r = F.log((F.col("p") / F.col("_p")) / (F.col("q") / F.col("_q")))
    if block is not None:
        r = F.when(F.col("block") == block, r).otherwise(F.lit(1.0))
    return with_stats(t, tot).select("block", "term", "df", r.alias("r"))


def diagnostic_terms(model, n=15) -> DataFrame:
    """The n terms that speak most for each class."""
    d = model.select("term", F.round(F.col("lp1") - F.col("lp0"), 6).alias("log_odds"))
    top = d.orderBy(F.col("log_odds").desc(), "term").limit(n).withColumn("side", F.lit(1))
    low = d.orderBy("log_odds", "term").limit(n).withColumn("side", F.lit(0))
    return top.unionByName(low)


def param_sweep(train_terms, eval_terms, docs, sizes, alphas, label="label"):
    """Multinomial NB for every (vocabulary size, alpha) in one pass.

    The vocabulary is built once at the largest size with a rank; each setting is
    one conditional sum, so the term table is joined once for the whole grid.
    ``docs`` carries doc_id, label, split and prior_gap.
    """
    from pyspark.sql import Window

    t = class_totals(train_terms, label=label).withColumn("cf", F.col("c0") + F.col("c1"))
    top = vocab_top(t, max(sizes), "cf")
    top = cut_lineage(top).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("cf").desc(), "block", "term")))
    stats = top.agg(*[F.sum(F.when(F.col("rank") <= k, F.col(f"c{c}"))).alias(f"t{c}_{k}") for k in sizes for c in (0, 1)],
                    *[F.sum(F.when(F.col("rank") <= k, 1)).alias(f"v_{k}") for k in sizes])
    grid = [(k, a) for k in sizes for a in alphas]
    lp = lambda c, k, a: F.log((F.col(f"c{c}") + a) / (F.col(f"t{c}_{k}") + F.lit(a) * F.col(f"v_{k}")))
    weights = cut_lineage(with_stats(top, stats).select("block", "term", "df", *[
        F.when(F.col("rank") <= k, lp(1, k, a) - lp(0, k, a)).otherwise(F.lit(0.0)).alias(f"w{i}")
        for i, (k, a) in enumerate(grid)]))
    sums = lookup(eval_terms, weights).groupBy("doc_id").agg(
        *[F.sum(F.col("cnt") * F.col(f"w{i}")).alias(f"s{i}") for i in range(len(grid))])
    cells = F.array(*[
        F.struct(F.lit(k).alias("vocab_size"), F.lit(float(a)).alias("alpha"),
                 (F.round(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.col("prior_gap"), 6) >= 0).cast("int").alias("pred"))
        for i, (k, a) in enumerate(grid)])
    return docs.join(sums, "doc_id", "left").select("doc_id", label, "split", F.explode(cells).alias("g")).select(
        "doc_id", F.col(label).alias("y"), "split", "g.vocab_size", "g.alpha", "g.pred")
