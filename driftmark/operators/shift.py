"""Importance weights, pseudo-label selection and row stacking for adaptation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_stats
from .ranks import _join_small, exact_quantiles, global_rank, quantile_value


def density_ratio(df, p="p", clip_p=(0.05, 0.95), clip_w=(0.0, 10.0), out="w") -> DataFrame:
    """p / (1 - p) on clipped probabilities, clipped again, scaled to mean 1."""
    c = F.greatest(F.least(F.col(p), F.lit(clip_p[1])), F.lit(clip_p[0]))
    w = df.withColumn("_w", F.greatest(F.least(c / (1 - c), F.lit(clip_w[1])), F.lit(clip_w[0])))
    return with_stats(w, w.agg(F.avg("_w").alias("_m"))).withColumn(out, F.col("_w") / F.col("_m")).drop("_w", "_m")


def weight_soften(df, gamma, w="w") -> DataFrame:
    """w ** gamma at mean 1; gamma <= 0 switches weighting off."""
    if gamma <= 0:
        return df.withColumn(w, F.lit(1.0))
    s = df.withColumn(w, F.pow(w, F.lit(float(gamma))))
    return with_stats(s, s.agg(F.avg(w).alias("_m"))).withColumn(w, F.col(w) / F.col("_m")).drop("_m")


def weight_summary(df, w="w", p="p") -> DataFrame:
    med = exact_quantiles(df, w, [0.5]).select(F.col("value").alias("median_w"))
    base = df.agg(F.min(w).alias("min_w"), F.max(w).alias("max_w"), F.avg(p).alias("mean_p"))
    return with_stats(base, med)


def length_histogram_weights(train, target, value="log_tokens", bins=20, clip=(0.25, 4.0)) -> DataFrame:
    """Target/train share per bin of the length range, clipped, mean 1 over the training rows.

    The bin table has ``bins`` rows, so it is joined by broadcast.
    """
    both = train.select(value).unionByName(target.select(value))
    span = both.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))

    def binned(df):
        w = (F.col("_hi") - F.col("_lo")) / bins
        pos = F.when(w > 0, F.floor((F.col(value) - F.col("_lo")) / w)).otherwise(F.lit(0))
        return with_stats(df, span).withColumn("bin", F.least(pos, F.lit(bins - 1)).cast("int")).drop("_lo", "_hi")

    def shares(df, name):
        c = binned(df).groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
        return with_stats(c, c.agg(F.sum("c").alias("n"))).select("bin", (F.col("c") / F.col("n")).alias(name))

    r = shares(train, "a").join(shares(target, "b"), "bin", "left")
    ratio = F.greatest(F.least(F.coalesce(F.col("b"), F.lit(0.0)) / F.col("a"), F.lit(clip[1])), F.lit(clip[0]))
    w = binned(train).join(F.broadcast(r.select("bin", ratio.alias("w"))), "bin")
    return weight_soften(w, 1.0)


def length_kde_weights(train, target, value="log_tokens", grid=256, clip=(0.25, 4.0)) -> DataFrame:
    """Ratio of two Gaussian kernel densities (Scott's rule), interpolated on a grid.

    Lengths are counted per distinct value first; the densities are sums over
    (distinct value, nearby grid point) pairs, with the kernel cut at 5 widths.
    """
    spark = train.sparkSession
    st = train.select(value).unionByName(target.select(value)).agg(F.min(value), F.max(value)).first()
    lo, hi = float(st[0]), float(st[1])
    step = (hi - lo) / (grid - 1) or 1.0

    def density(df, name):
        c = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
        one = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd"))
        h = F.greatest(F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(1e-6))
        v = with_stats(c, one).withColumn("h", h)
        first = F.greatest(F.floor((F.col("v") - 5 * F.col("h") - lo) / step), F.lit(0)).cast("int")
        last = F.least(F.ceil((F.col("v") + 5 * F.col("h") - lo) / step), F.lit(grid - 1)).cast("int")
        pts = v.withColumn("g", F.explode(F.sequence(F.least(first, last), F.greatest(first, last))))
        z = (F.col("v") - (F.lit(lo) + F.col("g") * step)) / F.col("h")
        return pts.groupBy("g").agg(F.sum(F.col("c") * F.exp(-0.5 * z * z) / (F.col("h") * F.col("n"))).alias(name))

    ratio = density(train, "a").join(density(target, "b"), "g", "left").select(
        "g", F.greatest(F.least(F.coalesce("b", F.lit(0.0)) / F.greatest("a", F.lit(1e-9)), F.lit(clip[1])), F.lit(clip[0])).alias("w"))
    near = train.withColumn("g", F.rint((F.col(value) - lo) / step).cast("int"))
    return weight_soften(near.join(F.broadcast(ratio), "g").drop("g"), 1.0)


# --- pseudo-label selection -------------------------------------------------------------

def balanced_select(scores, frac, margin="margin", key="doc_id") -> DataFrame:
    """Per predicted class (margin > 0) the max(1, floor(n * frac)) most confident rows."""
    s = scores.select(key, margin, (F.col(margin) > 0).cast("int").alias("label"), F.abs(margin).alias("_c"))
    n = s.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    ranked = _join_small(global_rank(s, "_c", key, ["label"], descending=True), n, ["label"])
    keep = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(frac))))
    return ranked.where(F.col("rk") < keep).select(key, margin, "label")


def unbalanced_select(scores, frac, margin="margin", key="doc_id") -> DataFrame:
    """Rows whose |margin| reaches the (1 - frac) quantile."""
    s = scores.select(key, margin, (F.col(margin) > 0).cast("int").alias("label"), F.abs(margin).alias("_c"))
    return with_stats(s, quantile_value(s, "_c", 1 - frac)).where(F.col("_c") >= F.col("q")).select(key, margin, "label")


def append_pseudo(train, picks, weight=1.0) -> DataFrame:
    """Training rows plus selected target rows; ``kind`` tells them apart."""
    return train.select("doc_id", "label", "weight", F.lit("train").alias("kind")).unionByName(
        picks.select("doc_id", "label", F.lit(float(weight)).alias("weight"), F.lit("pseudo").alias("kind")))


def cotrain_union(word_picks, char_picks) -> DataFrame:
    """Rows taught by either view. Each view teaches the other, so the character
    view's label comes first where both or only it picked the row."""
    w = word_picks.select("doc_id", F.col("label").alias("by_word"))
    c = char_picks.select("doc_id", F.col("label").alias("by_char"))
    return w.join(c, "doc_id", "full").select("doc_id", F.coalesce("by_char", "by_word").alias("label"))


def agreed(word_picks, char_picks) -> DataFrame:
    """Rows both views picked with the same label."""
    return word_picks.select("doc_id", "label").join(char_picks.select("doc_id", "label"), ["doc_id", "label"])


def class_weight_balanced(df, label="label") -> DataFrame:
    """n / (2 n_c), as a two-row table."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    return with_stats(c, c.agg(F.sum("_c").alias("_n"))).select(label, (F.col("_n") / (2 * F.col("_c"))).alias("class_weight"))
