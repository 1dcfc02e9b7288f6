"""Statistics of feature columns: per class, against the label, against each other."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import find_all, safe_div
from ..session import with_stats


def melt(df: DataFrame, columns, keep=("doc_id",)) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")


def gaussian_stats(long, label="label", smoothing=1e-2):
    """Per class and feature: mean, population variance + smoothing x mean global variance, log prior.

    One partial aggregate over the rows; global variance comes from the class rows.
    """
    per = long.groupBy(label, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("v"))
    glob = long.groupBy("feature").agg(F.var_pop("value").alias("g"), F.count(F.lit(1)).alias("all"))
    eps = glob.agg((F.avg("g") * smoothing).alias("eps"), F.max("all").alias("rows"))
    return with_stats(per, eps).select(
        label, "feature", "mean", (F.col("v") + F.col("eps")).alias("var"),
        F.log(F.col("n") / F.col("rows")).alias("log_prior"))


def _by(cls, agg, label="label"):
    return agg(F.when(F.col(label) == cls, F.col("value")))


def separation_score(long):
    gap = F.abs(_by(1, F.avg) - _by(0, F.avg))
    pooled = F.sqrt((_by(1, F.var_pop) + _by(0, F.var_pop)) / 2) + 1e-9
    return long.groupBy("feature").agg((gap / pooled).alias("score"))


def feature_rank(scores):
    """Rank of at most a few hundred features."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.round("score", 6).desc(), "feature")
    return scores.select("feature", "score", F.row_number().over(w).alias("rank"))


def cohens_d(long):
    d = (_by(1, F.avg) - _by(0, F.avg)) / (F.stddev_samp("value") + 1e-9)
    return long.groupBy("feature").agg(
        _by(0, F.avg).alias("mean0"), _by(1, F.avg).alias("mean1"), d.alias("d"),
        (F.abs(d) > 0.5).cast("int").alias("strong"))


def pairwise_corr(df, columns):
    """Pearson correlation of all pairs of a column list (a, b, corr), 0 where a column is constant.

    One aggregate over a vector of all columns (MLlib's correlation), however many there are; the matrix of columns x
    columns is what comes back. Columns are centred first, so that large means don't cost digits. Null values count
    as the column's mean.
    """
    names = sorted(columns)
    if df.isEmpty() or len(names) < 2:
        return df.sparkSession.createDataFrame([(a, b, 0.0) for i, a in enumerate(names) for b in names[i + 1:]], "a string, b string, corr double")
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first()
    centred = F.array(*[F.coalesce(F.col(c).cast("double") - F.lit(float(means[c] or 0.0)), F.lit(0.0)) for c in names])
    one = Correlation.corr(df.select(array_to_vector(centred).alias("v")), "v").first()[0].toArray()
    cells = [(a, b, float(one[i, j]) if one[i, j] == one[i, j] else 0.0) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return df.sparkSession.createDataFrame(cells, "a string, b string, corr double")


def label_corr(long, label="label"):
    c = F.when(F.var_pop("value") > 0, F.corr("value", F.col(label).cast("double"))).otherwise(F.lit(0.0))
    return long.groupBy("feature").agg(F.round(c, 6).alias("corr"))


def greedy_decorrelate(scores, corr, limit=0.6):
    """Greedy pick over the (few hundred) feature names; the matrix is already small."""
    spark = scores.sparkSession
    cm = {}
    for a, b, v in corr.select("a", "b", "corr").collect():
        cm[a, b] = cm[b, a] = abs(v)
    kept = []
    for name, score in scores.orderBy(F.round("score", 6).desc(), "feature").select("feature", "score").collect():
        if all(cm.get((name, k), 0.0) <= limit for k, _ in kept):
            kept.append((name, score))
    return spark.createDataFrame([(i + 1, n, s) for i, (n, s) in enumerate(kept)], "pick int, feature string, score double")


def greedy_diverse(quality, corr, floor=0.55, size=4, always=None):
    """Start from the best model, then add the largest (F1 - max |corr|); a bounded list of models."""
    spark = quality.sparkSession
    f1 = {m: v for m, v in quality.select("model", "f1").collect()}
    cm = {}
    for a, b, v in corr.select("a", "b", "corr").collect():
        cm[a, b] = cm[b, a] = abs(v)
    pool = sorted(m for m in f1 if f1[m] >= floor) or sorted(f1)
    picked = [max(pool, key=lambda m: f1[m])]
    while len(picked) < min(size, len(pool)):
        rest = [m for m in pool if m not in picked]
        picked.append(max(rest, key=lambda m: f1[m] - max(cm.get((m, p), 0.0) for p in picked)))
    if always and always in f1 and always not in picked:
        picked.append(always)
    return spark.createDataFrame([(i + 1, m, f1[m]) for i, m in enumerate(picked)], "pick int, model string, f1 double")


def array_profile(df, col="x"):
    """Range, mean, zero and integer shares over all cells; mean row sums."""
    add = lambda f: F.aggregate(col, F.lit(0.0), lambda a, v: a + f(v))
    rows = df.select(
        F.size(col).alias("d"), F.array_min(col).alias("lo"), F.array_max(col).alias("hi"),
        add(lambda v: v).alias("s"), add(lambda v: v * v).alias("ss"),
        F.size(F.filter(col, lambda v: v == 0)).alias("z"),
        F.size(F.filter(col, lambda v: v == F.rint(v))).alias("i"))
    return rows.agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("s") / F.sum("d")).alias("mean"),
        (F.sum("z") / F.sum("d")).alias("zero_share"), (F.sum("i") / F.sum("d")).alias("integer_share"),
        F.avg("ss").alias("row_sumsq"), F.avg("s").alias("row_sum"))


def zscore(long, fit=None, floor=1e-12):
    fit = long if fit is None else fit
    st = fit.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    sd = F.when(F.col("_s") > floor, F.col("_s")).otherwise(F.lit(1.0))
    return long.join(st, "feature").withColumn("z", (F.col("value") - F.col("_m")) / sd).drop("_m", "_s")


def word_rates(df, words, label="label"):
    """Share of documents per class holding each listed word.

    The listed words found in a row are exploded (at most the list), so the texts
    never meet the word list in a join.
    """
    listed = F.array(*[F.lit(w) for w in words])
    toks = find_all(F.lower(F.col("text")), r"[\p{L}\p{N}_]+")
    hits = df.select(label, F.array_intersect(listed, toks).alias("h"))
    per = hits.agg(*[
        safe_div(F.sum(F.when((F.col(label) == c) & F.array_contains("h", w), 1).otherwise(0)),
                 F.sum(F.when(F.col(label) == c, 1).otherwise(0))).alias(f"{c}_{i}")
        for i, w in enumerate(words) for c in (0, 1)])
    cells = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"0_{i}").alias("rate0"), F.col(f"1_{i}").alias("rate1"))
                      for i, w in enumerate(words)])
    return per.select(F.explode(cells).alias("c")).select(
        "c.word", "c.rate0", "c.rate1", (F.col("c.rate1") - F.col("c.rate0")).alias("delta"))
