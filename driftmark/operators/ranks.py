"""Orders, ranks, running totals and quantiles without one-task windows.

A window over a whole table (or over one class of it) would sort everything in
one task. Here rows are first cut into ordered buckets; the small bucket table
gives each bucket's offset, and only rows of one bucket are ordered together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import with_stats

BUCKETS = 128


def md5_order(seed, key: Column) -> Column:
    """Reproducible shuffle key, identical in any SQL engine; ``seed`` may be a column."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed, F.lit(":"), key.cast("string")))


def _offsets(bucketed: DataFrame, group, order, sums: dict) -> DataFrame:
    """Per (group, bucket) totals of all earlier buckets; at most groups x buckets rows."""
    small = bucketed.groupBy(*group, *order).agg(*[e.alias(f"_t_{k}") for k, e in sums.items()])
    by = [F.col(g) for g in group] or [F.lit(0)]
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return small.select(
        *group, *order,
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
    )


def _join_small(df, small, keys):
    """Join the bucket table back (null-safe); its row count is bounded by construction."""
    right = small.select(*[F.col(k).alias(f"_j_{k}") for k in keys],
                         *[c for c in small.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    return df.join(F.broadcast(right), cond).drop(*[f"_j_{k}" for k in keys])


def hash_rank(df: DataFrame, seed, key: str, group=(), out="rk") -> DataFrame:
    """0-based rank of each row in md5 order within its group (4,096 even buckets)."""
    group = list(group)
    b = df.withColumn("_h", md5_order(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    off = _offsets(b, group, ["_b"], {"n": F.count(F.lit(1))})
    w = Window.partitionBy(*group, "_b").orderBy("_h", key)
    return (
        _join_small(b, off, group + ["_b"])
        .withColumn(out, F.col("_o_n") + F.row_number().over(w) - 1)
        .drop("_h", "_b", "_o_n")
    )


def bucket_bounds(df: DataFrame, value: str, group=(), n=BUCKETS) -> DataFrame | list:
    """Sorted distinct cut points of ``value`` (per group), fixed once on the driver.

    Collected on purpose: every later pass must use the same cut points, and the
    result holds at most ``n`` numbers per group.
    """
    probs = [(i + 1) / n for i in range(n)]
    cuts = F.array_sort(F.array_distinct(F.percentile_approx(value, probs, 10 * n)))
    if not group:
        row = df.agg(cuts.alias("cuts")).first()
        return list(row["cuts"] or [])
    rows = df.groupBy(*group).agg(cuts.alias("cuts"))
    data = [tuple(x) for x in rows.collect()]
    return df.sparkSession.createDataFrame(data, rows.schema)


def tie_bounds(df: DataFrame, key: str, n=BUCKETS) -> list:
    """At most ``n`` sorted cut points of a column of any ordered type: every 20th of the 20 n distinct values
    with the least hashes."""
    rows = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(20 * n).collect()
    return sorted(r[0] for r in rows)[20::20]


def _with_cuts(df, bounds, group):
    if isinstance(bounds, list):
        cuts = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
        return df.withColumn("cuts", cuts)
    return _join_small(df, bounds, list(group))


def running_totals(df: DataFrame, key: str, sums, group=(), following=None) -> DataFrame:
    """Add ``cum_<c>``: inclusive running sums in ascending ``key`` order, and on
    request the ``following`` key of the group.

    ``df`` has one row per (group, key): aggregate first, so that a value shared
    by a third of the table is one row here.
    """
    group = list(group)
    bounds = bucket_bounds(df, key, group)
    b = _with_cuts(df, bounds, group).withColumn(
        "_b", F.size(F.filter("cuts", lambda x: x < F.col(key))))
    off = _offsets(b, group, ["_b"], {c: F.sum(c) for c in sums})
    w = Window.partitionBy(*group, "_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = _join_small(b, off, group + ["_b"])
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(w))
    if following:
        by = [F.col(g) for g in group] or [F.lit(0)]
        first = b.groupBy(*group, "_b").agg(F.min(key).alias("_first"))
        nxt = first.select(*group, "_b", F.lead("_first").over(Window.partitionBy(*by).orderBy("_b")).alias("_next"))
        inside = F.lead(key).over(Window.partitionBy(*group, "_b").orderBy(key))
        out = _join_small(out, nxt, group + ["_b"]).withColumn(following, F.coalesce(inside, "_next")).drop("_next")
    return out.drop("cuts", "_b", *[f"_o_{c}" for c in sums])


def global_rank(df: DataFrame, value: str, tie: str, group=(), descending=False, out="rk") -> DataFrame:
    """0-based rank by (value, tie) within a group.

    Rows equal to a cut point form their own buckets, cut again by the tie
    column, so one value held by a third of all rows is still spread out.
    """
    group = list(group)
    df = df.withColumn("_v", (-F.col(value) if descending else F.col(value)).cast("double")).withColumn("_k", F.col(tie))
    vb = _with_cuts(df, bucket_bounds(df, "_v", group), group).withColumnRenamed("cuts", "_vc")
    kb = tie_bounds(df, "_k")
    b = _with_cuts(vb, kb, []).select(
        "*",
        F.size(F.filter("_vc", lambda x: x < F.col("_v"))).alias("_b"),
        F.array_contains("_vc", F.col("_v")).cast("int").alias("_e"),
    ).withColumn(
        "_s", F.when(F.col("_e") == 1, F.size(F.filter("cuts", lambda x: x < F.col("_k"))) if kb else F.lit(0)).otherwise(F.lit(0)))
    order = ["_b", "_e", "_s"]
    off = _offsets(b, group, order, {"n": F.count(F.lit(1))})
    w = Window.partitionBy(*group, *order).orderBy("_v", tie)
    return (
        _join_small(b, off, group + order)
        .withColumn(out, F.col("_o_n") + F.row_number().over(w) - 1)
        .drop("_v", "_k", "_vc", "cuts", *order, "_o_n")
    )


def exact_quantiles(df: DataFrame, value: str, probs) -> DataFrame:
    """(prob, value) with linear interpolation between the two nearest ranks.

    Ranks are found on running totals over distinct values, so no task ever
    holds the whole column (the built-in exact percentile would).
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c"))
    cum = with_stats(running_totals(counts, "v", ["c"]), counts.agg(F.sum("c").alias("n")))
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("cum_c") - F.col("c") <= rank) & (rank < F.col("cum_c"))
            aggs.append(F.max(F.when(hit, F.col("v"))).alias(f"{side}{i}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"w{i}"))
    one = cum.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"),
                 (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias("value"))
        for i, p in enumerate(probs)
    ])
    return one.select(F.explode(rows).alias("r")).select("r.prob", "r.value")


def quantile_value(df, value, prob) -> DataFrame:
    """One-row table ``q`` for use with ``with_stats``."""
    return exact_quantiles(df, value, [prob]).select(F.col("value").alias("q"))


# --- splits -----------------------------------------------------------------------

def stratified_holdout(df, label="label", key="doc_id", frac=0.1, seed=42):
    """``split`` = val for the first round(n * frac) rows of each class, else train."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = _join_small(hash_rank(df, seed, key, [label]), n, [label])
    val = F.col("rk") < F.bround(F.col("_n") * F.lit(frac))
    return ranked.withColumn("split", F.when(val, "val").otherwise("train")).drop("rk", "_n")


def seeded_holdouts(df, seed, label="label", key="doc_id", frac=0.1):
    """``stratified_holdout`` for every value of the column ``seed`` at once."""
    n = df.groupBy(seed, label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = _join_small(hash_rank(df, F.col(seed), key, [seed, label]), n, [seed, label])
    val = F.col("rk") < F.bround(F.col("_n") * F.lit(frac))
    return ranked.withColumn("split", F.when(val, "val").otherwise("train")).drop("rk", "_n")


def run_of(rank, n, k):
    """Which of ``k`` near-equal runs a rank falls in; the first n mod k runs are longer."""
    q, m = F.floor(n / F.lit(k)), n % F.lit(k)
    head = (q + 1) * m
    return F.when(rank < head, F.floor(rank / (q + 1))).otherwise(
        m + F.floor((rank - head) / F.greatest(q, F.lit(1)))).cast("int")


def stratified_kfold(df, label="label", key="doc_id", k=5, seed=42):
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = _join_small(hash_rank(df, seed, key, [label]), n, [label])
    return ranked.withColumn("fold", run_of(F.col("rk"), F.col("_n"), k)).drop("rk", "_n")


def pool_eval_split(df, key="doc_id", seed=42, group=()):
    """First half in md5 order = unlabelled pool, the rest = evaluation rows."""
    group = list(group)
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")) if group else df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(df, seed, key, group)
    ranked = _join_small(ranked, n, group) if group else with_stats(ranked, n)
    part = F.when(F.col("rk") < F.floor(F.col("_n") / 2), "pool").otherwise("eval")
    return ranked.withColumn("part", part).drop("rk", "_n")


def quintiles(df, value, key="doc_id", k=5):
    """Group q holds ranks [q*n//k, (q+1)*n//k) in ascending value order."""
    ranked = with_stats(global_rank(df, value, key), df.agg(F.count(F.lit(1)).alias("_n")))
    fold = F.floor(((F.col("rk") + 1) * k - 1) / F.col("_n")).cast("int")
    return ranked.withColumn("fold", fold).drop("rk", "_n")


def rank_share(df, value, key="doc_id", out="r"):
    """Mean-tie rank divided by n."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    cum = with_stats(running_totals(counts, value, ["c"]), df.agg(F.count(F.lit(1)).alias("n")))
    ranks = cum.select(value, ((F.col("cum_c") - (F.col("c") - 1) / 2) / F.col("n")).alias(out))
    return df.join(ranks, value)
