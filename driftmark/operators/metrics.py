"""Classification metrics as partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_div
from .ranks import running_totals


def _when(c):
    return F.sum(F.when(c, 1).otherwise(0))


def _f1(tp, fp, fn):
    return safe_div(2 * tp, 2 * tp + fp + fn)


def macro_f1_expr(y="y", pred="pred"):
    """Mean F1 of classes 0 and 1 as an aggregate expression; 0 on zero division."""
    y, p = F.col(y), F.col(pred)
    t11, t01, t10, t00 = (_when((y == a) & (p == b)) for a, b in ((1, 1), (0, 1), (1, 0), (0, 0)))
    return (_f1(t11, t01, t10) + _f1(t00, t10, t01)) / 2


def macro_f1(df: DataFrame, y="y", pred="pred", by=()) -> DataFrame:
    return df.groupBy(*by).agg(macro_f1_expr(y, pred).alias("macro_f1"))


def macro_f1_foldmean(df, y="y", pred="pred", fold="fold", by=()):
    per = macro_f1(df, y, pred, [*by, fold])
    return per.groupBy(*by).agg(F.avg("macro_f1").alias("macro_f1"))


def accuracy(df, y="y", pred="pred"):
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(df, y="y", pred="pred"):
    return df.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n"))


def roc_auc(df: DataFrame, y="y", score="p", by=()) -> DataFrame:
    """Rank-sum AUC with mean ranks for ties, on counts per distinct score."""
    by = list(by)
    counts = df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(
        F.count(F.lit(1)).alias("c"), _when(F.col(y) == 1).alias("pos"))
    cum = running_totals(counts, "s", ["c"], by)
    ranked = cum.withColumn("rank", F.col("cum_c") - (F.col("c") - 1) / 2)
    agg = ranked.groupBy(*by).agg(
        F.sum(F.col("rank") * F.col("pos")).alias("rs"), F.sum("pos").alias("np"),
        F.sum(F.col("c") - F.col("pos")).alias("nn"))
    auc = F.try_divide(F.col("rs") - F.col("np") * (F.col("np") + 1) / 2, (F.col("np") * F.col("nn")).cast("double"))
    return agg.select(*by, auc.alias("auc"))


def log_loss(df, y="y", p="p", weight=None, eps=1e-12):
    """Weighted binary cross-entropy on clipped probabilities."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    bce = -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))
    w = F.col(weight) if weight else F.lit(1.0)
    return df.agg((F.sum(w * bce) / F.sum(w)).alias("log_loss"))


def class_balance(df, label="label"):
    """Rows per label; share of all rows from the same small table."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    from ..session import with_stats
    return with_stats(n, n.agg(F.sum("n").alias("_all"))).select(
        label, "n", (F.col("n") / F.col("_all")).alias("share"))


def threshold_sweep(df, grid, y="y", score="p", strict=False, by=()) -> DataFrame:
    """Macro-F1 at every cut of a grid in one pass over the rows.

    Each row falls in one grid cell; the counts at a cut are suffix sums over the
    (classes x cells) table, so rows are never repeated per cut.
    """
    by = list(by)
    cuts = F.array(*[F.lit(float(t)) for t in grid])
    above = (lambda t: t < F.col(score)) if strict else (lambda t: t <= F.col(score))
    cells = df.groupBy(*by, F.size(F.filter(cuts, above)).alias("cell")).agg(
        _when(F.col(y) == 1).alias("pos"), _when(F.col(y) == 0).alias("neg"))
    # at most (cells x grid) rows per group, whatever the size of the input
    wide = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))).withColumn(
        "t", F.get(cuts, F.col("i")))
    hit = F.col("cell") > F.col("i")
    tp, fp = (F.sum(F.when(hit, F.col(c)).otherwise(0)) for c in ("pos", "neg"))
    fn, tn = (F.sum(F.when(~hit, F.col(c)).otherwise(0)) for c in ("pos", "neg"))
    return wide.groupBy(*by, "t").agg(((_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2).alias("macro_f1"))
