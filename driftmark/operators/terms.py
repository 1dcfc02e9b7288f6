"""Long term tables: counts, document frequency, vocabularies, TF-IDF.

A block is one representation ("w" word n-grams, "c" character n-grams, ...).
Every table is (doc_id, block, term, cnt|value), so blocks are stacked by union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage, with_stats

HOT_SHARE = 10_000  # a key with more than 1/HOT_SHARE of all rows is hot: at most that many exist
HOT_ROWS = 100_000.0  # fewer rows than this cannot slow a task
SMALL_ROWS, SMALL_CHARS = 1_000_000, 16_000_000  # a table within both takes some 100 MB of a task's memory


def word_terms(df, lo=1, hi=1, tok=X.tok_vectorizer, block="w", sep=" ", keep=("doc_id",), unigram_filter=None):
    """Counted word n-grams, sizes lo..hi."""
    toks = df.select(*keep, tok(F.col("text")).alias("_tok"))
    uni = F.col("_tok") if unigram_filter is None else F.filter("_tok", unigram_filter)
    parts = [uni if n == 1 else X.word_ngrams(F.col("_tok"), n, sep) for n in range(lo, hi + 1)]
    arr = parts[0] if len(parts) == 1 else F.concat(*parts)
    return X.count_terms(toks.select(*keep, F.lit(block).alias("block"), arr.alias("terms")), keep=[*keep, "block"])


def char_wb_terms(df, lo, hi, block="c", short="once", keep=("doc_id",)):
    """Counted character n-grams inside padded whitespace chunks.

    Each size is one row of the document, so a row never holds more than about
    one short string per character.
    """
    padded = df.select(*keep, X.padded_chunks(F.col("text")).alias("_p"))
    return _sizes(padded, lo, hi, lambda n: X.char_wb_ngrams(F.col("_p"), n, short, n == lo), block, keep)


def char_terms(df, lo, hi, block="c", keep=("doc_id",), text="text"):
    """Counted unpadded character n-grams."""
    base = df.select(*keep, F.col(text).alias("_p"))
    return _sizes(base, lo, hi, lambda n: X.char_windows(F.col("_p"), n), block, keep)


def _sizes(base, lo, hi, grams, block, keep):
    sized = base.select("*", F.explode(F.array(*[F.lit(n) for n in range(lo, hi + 1)])).alias("_n"))
    arr = F.when(F.col("_n") == lo, grams(lo))
    for n in range(lo + 1, hi + 1):
        arr = arr.when(F.col("_n") == n, grams(n))
    return X.count_terms(sized.select(*keep, F.lit(block).alias("block"), arr.alias("terms")), keep=[*keep, "block"])


def doc_freq(terms):
    """df and total count per (block, term), combined map-side before the shuffle."""
    return terms.groupBy("block", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("cf"))


def vocab_prune(freq, n_docs=None, min_df=1, max_df=None, stop_words=None):
    """Filter the frequency table; ``max_df`` is a share of ``n_docs`` (one-row table)."""
    out = freq.where(F.col("df") >= min_df)
    if max_df is not None:
        out = with_stats(out, n_docs).where(F.col("df") <= F.lit(float(max_df)) * F.col("n_docs")).select(*freq.columns)
    if stop_words:
        out = out.where(~F.col("term").isin(list(stop_words)))
    return out


def vocab_top(freq, k, by="df"):
    """The ``k`` most frequent terms, ties by term (distributed top-k)."""
    return freq.orderBy(F.col(by).desc(), "block", "term").limit(k)


def n_docs(df):
    return df.agg(F.count(F.lit(1)).alias("n_docs"))


def idf(vocab, docs):
    """ln((1 + N) / (1 + df)) + 1."""
    return with_stats(vocab, n_docs(docs)).withColumn(
        "idf", F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0)


def lookup(facts, dim, on=("block", "term"), weight="df", salt="doc_id"):
    """Inner join of a term table with a fitted (materialised) per-term table.

    ``weight`` bounds the number of fact rows of a term, so skew is known before
    the join.
    """
    return salted_join(facts, dim, on, dim.select(*on, F.col(weight).alias("_n")), salt)


def lookup_small(facts, dim, on=("block", "term"), weight="df", salt="doc_id"):
    """``lookup`` where the fitted table may be small for its facts: within SMALL_ROWS and SMALL_CHARS it is sent to
    the tasks, so no fact is shuffled and no key is hot; a larger one is joined as in ``lookup``."""
    rows, chars = dim.agg(F.count(F.lit(1)), F.sum(F.length("term"))).first()
    if rows <= SMALL_ROWS and (chars or 0) <= SMALL_CHARS:
        return facts.join(F.broadcast(dim), list(on))
    return lookup(facts, dim, on, weight, salt)


def key_lookup(left, right, on, salt="doc_id", how="left"):
    """Join to a side with one row per key where the left side may be skewed.

    ``left`` is scanned twice: pass a narrow, materialised table.
    """
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    return salted_join(left, right, on, sizes, salt, how)


def salted_join(left, right, on, sizes, salt, how="inner", parts=64):
    """Spread the rows of hot keys over ``parts`` join keys; other keys keep one.

    A key is hot when it holds more than 1/HOT_SHARE of all rows (and enough rows
    to slow a task), so there are fewer than HOT_SHARE hot keys: that list is
    small whatever the size of the data, and is the only thing broadcast here.
    Without a hot key the join stays a plain one.
    """
    on = list(on)
    top, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    cut = max((total or 0) / HOT_SHARE, HOT_ROWS)
    if (top or 0) <= cut:
        return left.join(right, on, how)
    hot = F.broadcast(sizes.where(F.col("_n") > F.lit(float(cut))).select(*on, F.lit(True).alias("_hot")))
    salted = left.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt), F.lit(parts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    spreadout = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(spreadout, [*on, "_salt"], how).drop("_salt")


def tf(kind="sublinear"):
    return {
        "sublinear": F.lit(1.0) + F.log(F.col("cnt").cast("double")),
        "binary": F.lit(1.0),
        "raw": F.col("cnt").cast("double"),
    }[kind]


def normalize(vectors, norm="l2", scope=("doc_id", "block"), value="value"):
    """Divide by the row norm; ``scope`` is the block or the whole document.

    Rows are placed by document, which serves the norm of either scope and any
    later grouping per document with a single shuffle.
    """
    if norm is None:
        return vectors
    vectors = vectors.repartition("doc_id")
    w = Window.partitionBy(*scope)
    size = F.sum(F.abs(value)).over(w) if norm == "l1" else F.sqrt(F.sum(F.col(value) * F.col(value)).over(w))
    return vectors.withColumn("_norm", size).withColumn(
        value, F.when(F.col("_norm") > 0, F.col(value) / F.col("_norm")).otherwise(F.lit(0.0))).drop("_norm")


def weigh(terms, weights, kind="sublinear", norm="l2", scope=("doc_id", "block")):
    """TF-IDF values of a term table under a fitted vocabulary (block, term, df, idf).

    Where the vocabulary has a column number (``linear.indexed``), rows carry ``idx`` in place of the term, so no
    later shuffle moves strings.
    """
    name = "idx" if "idx" in weights.columns else "term"
    joined = lookup(terms, weights.select(*dict.fromkeys(["block", "term", "df", "idf", name])))
    vec = joined.select("doc_id", "block", name, (tf(kind) * F.col("idf")).alias("value"))
    return normalize(vec, norm, scope)


def fit_vocab(terms, docs, min_df=2, max_features=None, max_df=None, stop_words=None, cap_by="cf"):
    """Vocabulary with IDF from training terms only; the cap keeps the most frequent.

    The fitted table is written once, so later joins do not tokenise again.
    """
    v = vocab_prune(doc_freq(terms), n_docs(docs), min_df, max_df, stop_words)
    if max_features:
        v = vocab_top(v, max_features, cap_by)
    return cut_lineage(idf(v, docs))


def block_scale(vectors, scales: dict):
    """Multiply each block by its factor; blocks not named keep 1."""
    f = F.lit(1.0)
    for b, s in scales.items():
        f = F.when(F.col("block") == b, F.lit(float(s))).otherwise(f)
    return vectors.withColumn("value", F.col("value") * f)


def stack_blocks(*tables):
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def dense_block(df, columns, block, keep="doc_id"):
    """Dense columns as rows (doc_id, block, term=column name, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(keep, F.lit(block).alias("block"), F.explode(pairs).alias("p")).select(
        keep, "block", "p.term", "p.value")


def standardize(long, fit=None, floor=1e-12):
    """(x - mean) / population sd per (block, term), fitted on ``fit``; tiny sd counts as 1.

    The statistics table has one row per dense column; Spark's own size check decides how it is joined.
    """
    fit = long if fit is None else fit
    st = fit.groupBy("block", "term").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return long.join(st, ["block", "term"]).select(
        "doc_id", "block", "term",
        ((F.col("value") - F.col("_m")) / F.when(F.col("_s") > floor, F.col("_s")).otherwise(F.lit(1.0))).alias("value"))


def log1p_l2(df, col="x"):
    """log1p of an array column, then row L2 (negative entries are clamped at 0 first)."""
    logged = df.withColumn("_l", F.transform(col, lambda v: F.log1p(F.greatest(v, F.lit(0.0)))))
    n = logged.withColumn("_n", F.sqrt(F.aggregate("_l", F.lit(0.0), lambda a, v: a + v * v)))
    return n.withColumn(col, F.transform("_l", lambda v: F.when(F.col("_n") > 0, v / F.col("_n")).otherwise(v))).drop("_l", "_n")


def chi2_terms(vectors, clusters):
    """Chi-square of each term against a cluster label, from observed and expected sums.

    Both sums run over the clusters to the same total, so chi2 = sum(observed^2 / expected) - total: only the
    cells that occur are needed.
    """
    x = vectors.join(clusters, "doc_id")
    obs = x.groupBy("block", "term", "cluster").agg(F.sum("value").alias("obs"))
    tot = obs.groupBy("block", "term").agg(F.sum("obs").alias("feat"))
    share = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"))
    share = with_stats(share, share.agg(F.sum("c").alias("n"))).select("cluster", (F.col("c") / F.col("n")).alias("prob"))
    cells = obs.join(share, "cluster").groupBy("block", "term").agg(
        F.sum(F.col("obs") * F.col("obs") / F.col("prob")).alias("_q"))
    chi2 = F.col("_q") / F.when(F.col("feat") != 0, F.col("feat")) - F.col("feat")
    return cells.join(tot, ["block", "term"]).select("block", "term", F.greatest(chi2, F.lit(0.0)).alias("chi2"))
