"""Blends, votes and rank averages of score legs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_stats
from .ranks import rank_share


def softmax_p1(a, b):
    """P(1) of two scores, shifted by their maximum."""
    top = F.greatest(a, b)
    e0, e1 = F.exp(a - top), F.exp(b - top)
    return e1 / (e0 + e1)


def soft_vote(columns, weights=None):
    weights = weights or [1.0] * len(columns)
    total = sum(weights)
    return reduce(lambda x, y: x + y, [F.col(c) * F.lit(w / total) for c, w in zip(columns, weights)])


def blend_grid(df, a, b, weights, keep) -> DataFrame:
    """One row per document and weight (a fixed, short list)."""
    cells = F.array(*[F.struct(F.lit(float(w)).alias("w"), (F.lit(float(w)) * F.col(a) + F.lit(1.0 - float(w)) * F.col(b)).alias("p"))
                      for w in weights])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.w", "c.p")


def seed_average(scores) -> DataFrame:
    return scores.groupBy("doc_id").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n_seeds"))


def margin_zscore(df, a, b) -> DataFrame:
    """Sum of the two margins' z-scores (population sd)."""
    st = df.agg(F.avg(a).alias("_ma"), F.stddev_pop(a).alias("_sa"), F.avg(b).alias("_mb"), F.stddev_pop(b).alias("_sb"))
    z = lambda c, s: (F.col(c) - F.col(f"_m{s}")) / (F.col(f"_s{s}") + 1e-9)
    return with_stats(df, st).withColumn("margin", z(a, "a") + z(b, "b")).drop("_ma", "_sa", "_mb", "_sb")


def rank_average(df, a, b, key="doc_id") -> DataFrame:
    ra = rank_share(df, a, key, "_ra").select(key, "_ra")
    rb = rank_share(df, b, key, "_rb")
    return rb.join(ra, key).withColumn("p", 0.5 * F.col("_ra") + 0.5 * F.col("_rb")).drop("_ra", "_rb")


def leg_audit(a, b, key="doc_id") -> DataFrame:
    """Do two legs cover the same rows? One partial aggregate over the stacked ids."""
    s = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return s.agg(
        n((F.col("l") > 0) & (F.col("r") > 0)).alias("matched"), n(F.col("r") == 0).alias("left_only"),
        n(F.col("l") == 0).alias("right_only"), n((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated"))
