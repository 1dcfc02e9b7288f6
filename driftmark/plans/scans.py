"""Scans, sinks, filters and simple projections."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import style as S
from ..functions import text as X
from ..operators import ranks
from ..operators.cache import cached
from ..session import cut_lineage
from ..sources import corpus as C
from ..sources import sinks
from . import common as U
from .registry import query, r


@query("scan_corpus", f"""WITH {U.CORPUS}
SELECT doc_id, coalesce(label, -1)::INT AS label, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM corpus""")
def scan_corpus(spark, sf):
    """CSV round trip: quoted multi-line text read back with a declared schema."""
    path = U.scratch(spark)
    C.corpus(spark, sf).select("doc_id", "text", "label").write.csv(
        path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    t = C.scan_csv(spark, path).select("doc_id", C.clean_text().alias("text"), "label")
    return t.select("doc_id", F.coalesce("label", F.lit(-1)).alias("label"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("scan_features", f"""SELECT vec_id, (label >= 5)::INT AS label, len(embedding)::INT AS n_features,
  {r("list_sum(list_transform(embedding, lambda v: v::DOUBLE))", "row_sum")} FROM embeddings""")
def scan_features(spark, sf):
    return C.features(spark, sf).select(
        "vec_id", "label", F.size("x").alias("n_features"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("row_sum"))


@query("dense_to_sparse", f"""SELECT count(*) AS n_rows, sum(len(embedding))::BIGINT AS n_cells,
  sum(len(list_filter(embedding, lambda v: v > 0)))::BIGINT AS nnz,
  {r("sum(len(list_filter(embedding, lambda v: v > 0)))::DOUBLE / sum(len(embedding))", "density")} FROM embeddings""")
def dense_to_sparse(spark, sf):
    """Dense rows clamped at 0, kept as (index, value) pairs; density of the result."""
    pairs = F.filter(
        F.transform("x", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] > 0)
    s = C.features(spark, sf).select("vec_id", F.size("x").alias("d"), pairs.alias("nz"))
    return s.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("d").alias("n_cells"), F.sum(F.size("nz")).alias("nnz"),
        (F.sum(F.size("nz")) / F.sum("d")).alias("density"))


TRIM = f"regexp_replace(coalesce(%s, ''), {U.q('^' + K.SPACE + '+|' + K.SPACE + '+$')}, '', 'g')"


@query("scan_paired", f"""WITH pairs AS (SELECT a.text AS human_text, b.text AS machine_text FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
long AS (SELECT 0 AS label, {TRIM % 'human_text'} AS text FROM pairs
  UNION ALL SELECT 1, {TRIM % 'machine_text'} FROM pairs)
SELECT md5(text) AS text_md5, min(label)::INT AS label, length(text)::INT AS n_chars FROM long
WHERE len({U.WS_TOK}) >= 20 GROUP BY text""")
def scan_paired(spark, sf):
    """Adjacent turns as (human, machine) text pairs, unpivoted, filtered and deduplicated."""
    c = C.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("machine_text"))
    pairs = c.withColumnRenamed("text", "human_text").join(b, ["conv_id", "turn"])
    return C.scan_paired(pairs).select(F.md5("text").alias("text_md5"), "label", F.length("text").alias("n_chars"))


@query("scan_preview", """SELECT doc_id, lang, source, length(text)::INT AS n_chars FROM documents
ORDER BY doc_id LIMIT 3""")
def scan_preview(spark, sf):
    """First rows by id (the feature is the limit)."""
    return C.table(spark, sf, "documents").orderBy("doc_id").limit(3).select(
        "doc_id", "lang", "source", F.length("text").alias("n_chars"))


@query("cache_folds", f"WITH {U.LEGS}, {U.FOLDS} SELECT 'strat' AS lens, doc_id, fold FROM folded")
def cache_folds(spark, sf):
    """Folds computed once for these rows and found again by every later call."""
    rows = cut_lineage(U.scored(spark, sf).select("doc_id", "y"))
    folds = lambda: ranks.stratified_kfold(rows, "y").select(F.lit("strat").alias("lens"), "doc_id", "fold")
    return cached(spark, "folds", {"rows": rows}, {"lens": "strat", "k": 5, "seed": 42}, folds)


@query("sink_predictions", f"WITH {U.LEGS} SELECT doc_id, (p_a >= 0.5)::INT AS label FROM legs WHERE y IS NULL")
def sink_predictions(spark, sf):
    path = U.scratch(spark)
    sinks.write_predictions(_predictions(spark, sf), path)
    return spark.read.schema("doc_id long, label int").csv(path, header=True)


def _predictions(spark, sf):
    return U.legs(spark, sf).where(F.col("y").isNull()).select("doc_id", (F.col("p_a") >= 0.5).cast("int").alias("label"))


@query("sink_scores", f"""WITH {U.LEGS} SELECT doc_id, 'a' AS leg, p_a AS p FROM legs
UNION ALL SELECT doc_id, 'b', p_b FROM legs""")
def sink_scores(spark, sf):
    path = U.scratch(spark)
    s = U.legs(spark, sf).select("doc_id", F.explode(F.array(
        F.struct(F.lit("a").alias("leg"), F.col("p_a").alias("p")),
        F.struct(F.lit("b").alias("leg"), F.col("p_b").alias("p")))).alias("s")).select("doc_id", "s.leg", "s.p")
    sinks.write_scores(s, path)
    return spark.read.parquet(path).select("doc_id", "leg", "p")


@query("sink_metrics", f"""WITH {U.LEGS} SELECT 'accuracy' AS metric,
{r("avg(((p_a >= 0.5)::INT = y)::INT)", "value")} FROM scored""")
def sink_metrics(spark, sf):
    path = U.scratch(spark)
    m = U.scored(spark, sf).agg(F.avg(((F.col("p_a") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("value"))
    sinks.write_metrics(m.select(F.lit("accuracy").alias("metric"), "value"), path)
    return spark.read.schema("metric string, value double").json(path)


@query("verify_sink", f"""WITH {U.LEGS}, p AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 7 ELSE (p_a >= 0.5)::INT END AS label FROM legs WHERE y IS NULL),
f AS (SELECT doc_id, label FROM p WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, label FROM p WHERE doc_id % 11 = 0
 UNION ALL SELECT -1 - doc_id, label FROM p WHERE doc_id % 17 = 0),
g AS (SELECT doc_id, count(*) AS got, sum((label NOT IN (0, 1))::INT) AS bad FROM f GROUP BY doc_id),
j AS (SELECT g.doc_id AS a, p.doc_id AS b, got, bad FROM g FULL JOIN p ON g.doc_id = p.doc_id)
SELECT coalesce(sum(got), 0)::BIGINT AS n_rows, count(b) AS n_expected, sum((a IS NULL)::INT)::BIGINT AS missing_ids,
sum((b IS NULL)::INT)::BIGINT AS unexpected_ids, coalesce(sum((got > 1)::INT), 0)::BIGINT AS repeated_ids,
coalesce(sum(CASE WHEN got = 1 OR bad > 0 THEN bad END), 0)::BIGINT AS bad_labels FROM j""")
def verify_sink(spark, sf):
    """Audit of a faulty prediction table: ids left out, repeated or made up, and labels out of range."""
    p = U.stored(_predictions(spark, sf)).withColumn("label", F.when(F.col("doc_id") % 13 == 0, 7).otherwise(F.col("label")))
    faulty = p.where(F.col("doc_id") % 7 != 0).unionByName(p.where(F.col("doc_id") % 11 == 0)).unionByName(
        p.where(F.col("doc_id") % 17 == 0).withColumn("doc_id", -1 - F.col("doc_id")))
    return sinks.verify_predictions(faulty, p.select("doc_id"))


# --- projections and filters --------------------------------------------------------

@query("fold_filter", f"""WITH {U.LEGS}, {U.FOLDS}
SELECT doc_id, y, CASE WHEN fold = 2 THEN 'val' ELSE 'train' END AS part FROM folded""")
def fold_filter(spark, sf):
    """Train and validation side of one fold."""
    return U.folded(spark, sf).select(
        "doc_id", "y", F.when(F.col("fold") == 2, "val").otherwise("train").alias("part"))


@query("min_words_filter", f"""SELECT doc_id, len({U.WS_TOK})::INT AS n_words FROM documents
WHERE len({U.WS_TOK}) >= 20""")
def min_words_filter(spark, sf):
    return C.min_words(C.documents(spark, sf)).select("doc_id", F.size(X.tok_ws(F.col("text"))).alias("n_words"))


@query("testlike_filter", f"""WITH {U.LEGS}, c AS (SELECT quantile_cont(p_b, 0.6) AS q FROM scored)
SELECT doc_id, y, p_b FROM scored, c WHERE p_b >= q""")
def testlike_filter(spark, sf):
    s = U.scored(spark, sf)
    return ranks.with_stats(s, ranks.quantile_value(s, "p_b", 0.6)).where("p_b >= q").select("doc_id", "y", "p_b")


@query("length_holdout", f"""WITH {U.CORPUS}, t AS (SELECT doc_id, label, len({U.WS_TOK})::INT AS n_tokens FROM corpus
  WHERE label IS NOT NULL), c AS (SELECT quantile_cont(n_tokens, 0.6) AS q FROM t)
SELECT doc_id, n_tokens, CASE WHEN n_tokens <= q THEN 'train' ELSE 'val' END AS split FROM t, c""")
def length_holdout(spark, sf):
    """Short 60 % to train on, the long rest to validate on."""
    t = C.labelled(spark, sf).select("doc_id", F.size(X.tok_ws(F.col("text"))).alias("n_tokens"))
    return ranks.with_stats(t, ranks.quantile_value(t, "n_tokens", 0.6)).select(
        "doc_id", "n_tokens", F.when(F.col("n_tokens") <= F.col("q"), "train").otherwise("val").alias("split"))


@query("confidence_filter", f"WITH {U.LEGS} SELECT doc_id, m_a, (m_a > 0)::INT AS label FROM legs WHERE y IS NULL AND abs(m_a) >= 0.5")
def confidence_filter(spark, sf):
    return U.legs(spark, sf).where(F.col("y").isNull() & (F.abs("m_a") >= 0.5)).select(
        "doc_id", "m_a", (F.col("m_a") > 0).cast("int").alias("label"))


@query("clean_nulls", f"""WITH x AS (SELECT doc_id, n_chars::DOUBLE / nullif(doc_id % 3, 0) AS v FROM documents)
SELECT doc_id, {r("CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0 ELSE v END", "v")} FROM x""")
def clean_nulls(spark, sf):
    d = C.table(spark, sf, "documents")
    v = F.try_divide(F.col("n_chars").cast("double"), F.col("doc_id") % 3)
    return d.select("doc_id", C.clean_number(v).alias("v"))


@query("smoke_sample", f"WITH {U.CORPUS} SELECT doc_id, coalesce(label, -1)::INT AS label FROM corpus ORDER BY md5('42:' || doc_id), doc_id LIMIT 400")
def smoke_sample(spark, sf):
    """Seeded sample of 400 rows (the sampling operator)."""
    return C.seeded_sample(C.corpus(spark, sf).select("doc_id", F.coalesce("label", F.lit(-1)).alias("label")), 400, "doc_id")


# --- splits -----------------------------------------------------------------------

@query("stratified_holdout", f"""WITH {U.CORPUS}, t AS (SELECT doc_id, label,
  row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rk,
  count(*) OVER (PARTITION BY label) AS n FROM corpus WHERE label IS NOT NULL)
SELECT doc_id, label, CASE WHEN rk < round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM t""")
def stratified_holdout(spark, sf):
    return ranks.stratified_holdout(C.labelled(spark, sf).select("doc_id", "label"))


@query("stratified_kfold", f"WITH {U.LEGS}, {U.FOLDS} SELECT doc_id, y, fold FROM folded")
def stratified_kfold(spark, sf):
    return U.folded(spark, sf).select("doc_id", "y", "fold")


@query("pool_eval_split", f"""WITH {U.LEGS}, {U.FOLDS}, t AS (SELECT doc_id, fold,
  row_number() OVER (PARTITION BY fold ORDER BY md5('7:' || doc_id), doc_id) - 1 AS rk, count(*) OVER (PARTITION BY fold) AS n FROM folded)
SELECT doc_id, fold, CASE WHEN rk < n // 2 THEN 'pool' ELSE 'eval' END AS part FROM t""")
def pool_eval_split(spark, sf):
    return ranks.pool_eval_split(U.folded(spark, sf).select("doc_id", "fold"), seed=7, group=["fold"])


@query("train_complement", f"""WITH {U.LEGS}, {U.FOLDS}
SELECT g.fold AS held, f.doc_id FROM folded f JOIN (SELECT DISTINCT fold FROM folded) g ON f.fold <> g.fold""")
def train_complement(spark, sf):
    """Training rows of every fold: each row belongs to all folds but its own."""
    f = U.folded(spark, sf).select("doc_id", "fold")
    return f.select("doc_id", "fold", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("held")).where(
        F.col("held") != F.col("fold")).select("held", "doc_id")


@query("testlike_quintiles", f"""WITH {U.LEGS}, t AS (SELECT doc_id, p_b, row_number() OVER (ORDER BY p_b, doc_id) - 1 AS rk,
  count(*) OVER () AS n FROM scored)
SELECT doc_id, (((rk + 1) * 5 - 1) // n)::INT AS fold FROM t""")
def testlike_quintiles(spark, sf):
    return ranks.quintiles(U.stored(U.scored(spark, sf).select("doc_id", "p_b")), "p_b").select("doc_id", "fold")


@query("fold_two_class_guard", f"""WITH {U.LEGS}, {U.FOLDS}, g AS (SELECT (doc_id % 37)::INT AS grp, y FROM folded)
SELECT grp, count(*) AS n FROM g GROUP BY grp HAVING count(DISTINCT y) = 2""")
def fold_two_class_guard(spark, sf):
    """Groups whose held-out side has both classes (min <> max needs no distinct set)."""
    g = U.folded(spark, sf).select((F.col("doc_id") % 37).cast("int").alias("grp"), "y")
    return g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).where(
        "lo <> hi").select("grp", "n")


@query("id_drift", f"""WITH {U.LEGS}, t AS (SELECT doc_id, y, row_number() OVER (ORDER BY doc_id) - 1 AS rk, count(*) OVER () AS n FROM scored)
SELECT (((rk + 1) * 5 - 1) // n)::INT AS quintile, {r('avg(y)', 'positive_rate')}, min(doc_id) AS min_id, max(doc_id) AS max_id
FROM t GROUP BY 1""")
def id_drift(spark, sf):
    s = U.stored(U.scored(spark, sf).select("doc_id", "y"))
    return ranks.quintiles(s, "doc_id").groupBy(F.col("fold").alias("quintile")).agg(
        F.avg("y").alias("positive_rate"), F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"))
