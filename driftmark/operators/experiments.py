"""Results tables: (lens, fold, cand, f1) to deltas, gates and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import macro_f1


def results(preds: DataFrame) -> DataFrame:
    """One pass over (lens, fold, cand, y, pred) rows."""
    return macro_f1(preds, by=["lens", "fold", "cand"]).withColumnRenamed("macro_f1", "f1")


def fold_delta(res, base="base") -> DataFrame:
    b = res.where(F.col("cand") == base).select("lens", "fold", F.col("f1").alias("base_f1"))
    return res.where(F.col("cand") != base).join(b, ["lens", "fold"]).withColumn("delta", F.col("f1") - F.col("base_f1"))


def lens_delta(res, base="base") -> DataFrame:
    return fold_delta(res, base).groupBy("cand", "lens").agg(
        F.avg("delta").alias("mean_delta"), F.min("delta").alias("worst"),
        F.sum((F.col("delta") > 0).cast("long")).alias("folds_won"), F.count(F.lit(1)).alias("n_folds"))


def gate(deltas, rule="min_mean", loss_lens=None, max_loss=0.005, min_won=4) -> DataFrame:
    """``min_mean``: every lens must gain. ``two_lens``: gain and enough folds won on
    every lens but ``loss_lens``, which may lose at most ``max_loss``."""
    if rule == "min_mean":
        ok = F.min("mean_delta") > 0
    else:
        other = F.col("lens") != F.lit(loss_lens)
        ok = F.min(F.when(other, (F.round("mean_delta", 9) > 0) & (F.col("folds_won") >= min_won))
                   .otherwise(F.round("mean_delta", 9) >= -max_loss))
    return deltas.groupBy("cand").agg(
        F.min("mean_delta").alias("min_delta"), F.min("worst").alias("worst"),
        F.sum((F.col("mean_delta") > 0).cast("long")).alias("lenses_won"), ok.cast("int").alias("passed"))


def additivity(deltas, a, b, both) -> DataFrame:
    of = lambda c: F.max(F.when(F.col("cand") == c, F.col("mean_delta")))
    return deltas.groupBy("lens").agg(
        of(both).alias("joint"), (of(a) + of(b)).alias("summed"), (of(both) - of(a) - of(b)).alias("surplus"))


def fold_summary(res) -> DataFrame:
    return res.groupBy("lens", "cand").agg(
        F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"), F.min("f1").alias("worst"), F.max("f1").alias("best"))


def race_summary(res) -> DataFrame:
    return res.groupBy("cand").agg(F.avg("f1").alias("f1")).orderBy(F.round("f1", 9).desc(), "cand")


def rank_candidates(gates) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(
        F.col("passed").desc(), F.round("min_delta", 9).desc(), F.round("worst", 9).desc(), "cand")
    return gates.select("cand", "passed", F.row_number().over(w).alias("rank"))


def screen(res, folds=(0, 1), keep=2) -> DataFrame:
    """Candidates ranked on a few folds; the best ``keep`` get their mean over all folds."""
    first = res.where(F.col("fold").isin(*folds)).groupBy("cand").agg(F.avg("f1").alias("screen_f1"))
    best = first.orderBy(F.round("screen_f1", 9).desc(), "cand").limit(keep)
    full = res.groupBy("cand").agg(F.avg("f1").alias("full_f1"))
    return full.join(F.broadcast(best), "cand")


def repro_gate(value: float, anchor: float, tol: float) -> None:
    """Stop when a reproduced number strays from its anchor."""
    if abs(value - anchor) > tol:
        raise ValueError(f"anchor not reproduced: {value:.4f} against {anchor:.4f} (tolerance {tol})")


def repro_report(measured, anchors, tol) -> DataFrame:
    j = measured.join(anchors, "name")
    return j.withColumn("ok", (F.abs(F.col("value") - F.col("anchor")) <= tol).cast("int"))


def coordinate_descent(score, space: dict, start: dict, passes=2):
    """Move one setting at a time while it improves ``score(config)``; settings are few."""
    best, best_score = dict(start), score(start)
    for _ in range(passes):
        moved = False
        for name, options in space.items():
            for value in options:
                if value == best[name]:
                    continue
                s = score({**best, name: value})
                if s > best_score + 1e-12:
                    best, best_score, moved = {**best, name: value}, s, True
        if not moved:
            break
    return best, best_score
