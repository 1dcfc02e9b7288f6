"""Naive Bayes, language models and duplicates: relational models with exact SQL."""

import math

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import style as S
from ..operators import bayes as B
from ..operators import dedup as D
from ..operators import langmodel as L
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import ranks
from ..operators import terms as T
from ..session import cut_lineage, with_stats
from ..sources import corpus as C
from . import common as U
from .registry import query, r
from .styles import LONG14
from .text import WORD_TFIDF, char_sql, _pair_sql

LAB = ("doc_id", "label")


def train_terms(spark, sf):
    return T.word_terms(C.labelled(spark, sf), keep=LAB)


TOTALS = f"""{U.WORDS}, tot AS (SELECT term, coalesce(sum(cnt) FILTER (label = 0), 0) AS c0,
  coalesce(sum(cnt) FILTER (label = 1), 0) AS c1 FROM terms WHERE label IS NOT NULL GROUP BY term),
mod AS (SELECT term, c0, c1, ln((c0 + 1.0) / (sum(c0) OVER () + count(*) OVER ())) AS lp0,
  ln((c1 + 1.0) / (sum(c1) OVER () + count(*) OVER ())) AS lp1 FROM tot),
prior AS (SELECT ln(sum((label = 1)::INT)::DOUBLE / sum((label = 0)::INT)) AS g FROM corpus WHERE label IS NOT NULL),
mnb AS (SELECT c.doc_id, c.label, coalesce(s, 0) AS s, coalesce(s, 0) + g AS margin FROM corpus c LEFT JOIN
  (SELECT doc_id, sum(cnt * (lp1 - lp0)) AS s FROM terms JOIN mod USING (term) GROUP BY doc_id) x USING (doc_id), prior)"""
NORMED = f"""normed AS (SELECT doc_id, label, md5({U.NORM}) AS key FROM corpus),
known AS (SELECT key, min(label) AS lo, max(label) AS hi FROM normed WHERE label IS NOT NULL GROUP BY key)"""


def clip(x):
    return f"greatest(least({x}, 500), -500)"


@query("class_term_totals", f"""WITH {TOTALS} SELECT term, c0::BIGINT AS c0, c1::BIGINT AS c1, {r('lp0', 'lp0')}, {r('lp1', 'lp1')} FROM mod""")
def class_term_totals(spark, sf):
    return B.multinomial_model(train_terms(spark, sf)).select("term", "c0", "c1", "lp0", "lp1")


@query("nb_multinomial", f"""WITH {TOTALS}, {NORMED}
SELECT m.doc_id, {r(f"1 / (1 + exp(-{clip('margin')}))", 'p')}, {r('margin', 'log_odds', 5)},
CASE WHEN lo = hi THEN lo ELSE (round(margin, 6) >= 0)::INT END AS label
FROM mnb m JOIN normed n USING (doc_id) LEFT JOIN known k ON k.key = n.key WHERE m.label IS NULL""")
def nb_multinomial(spark, sf):
    """Train on labelled text, score the target, then override exact duplicates."""
    target = C.target(spark, sf)
    model = B.multinomial_model(train_terms(spark, sf))
    s = B.score(target, T.word_terms(target), model, B.prior_gap(C.labelled(spark, sf)))
    pred = s.select("doc_id", "margin", (F.round("margin", 6) >= 0).cast("int").alias("label"))
    over = D.label_override(pred.select("doc_id", "label"), target, C.labelled(spark, sf))
    return pred.drop("label").join(over, "doc_id").select(
        "doc_id", B.sigmoid(F.col("margin")).alias("p"), F.round("margin", 5).alias("log_odds"), "label")


@query("nb_complement", f"""WITH {TOTALS} SELECT doc_id, {r('s', 'margin', 5)}, (round(s, 6) > 0)::INT AS label FROM mnb WHERE label IS NULL""")
def nb_complement(spark, sf):
    """Two classes: each class scores by the other's counts, without a prior."""
    target = C.target(spark, sf)
    s = B.score(target, T.word_terms(target), B.multinomial_model(train_terms(spark, sf)))
    return s.select("doc_id", F.round("margin", 5).alias("margin"), (F.round("margin", 6) > 0).cast("int").alias("label"))


GNB = f"""{LONG14}, ge AS (SELECT 0.01 * avg(v) AS eps FROM (SELECT var_pop(value) AS v FROM lf GROUP BY feature)),
gs AS (SELECT feature, avg(value) FILTER (label = 0) AS m0, avg(value) FILTER (label = 1) AS m1,
 var_pop(value) FILTER (label = 0) + max(eps) AS v0, var_pop(value) FILTER (label = 1) + max(eps) AS v1,
 ln(sum((label = 1)::INT)::DOUBLE / sum((label = 0)::INT)) AS g FROM lf, ge GROUP BY feature),
tl AS ({' UNION ALL '.join(f"SELECT doc_id, '{c}' AS feature, {c}::DOUBLE AS value FROM s14 WHERE label IS NULL" for c in K.STYLE14)}),
gnb AS (SELECT doc_id, max(g) + sum(-0.5 * ln(2 * pi() * v1) - (value - m1) ** 2 / (2 * v1)
  + 0.5 * ln(2 * pi() * v0) + (value - m0) ** 2 / (2 * v0)) AS gm FROM tl JOIN gs USING (feature) GROUP BY doc_id)"""


def gaussian_margin(spark, sf):
    lab = P.melt(S.style14(C.labelled(spark, sf), keep=LAB), K.STYLE14, LAB)
    tgt = P.melt(S.style14(C.target(spark, sf)), K.STYLE14)
    return B.gaussian_score(tgt, P.gaussian_stats(lab))


@query("nb_gaussian", f"""WITH {GNB} SELECT doc_id, {r('gm', 'margin', 5)}, {r(f"1 / (1 + exp(-{clip('gm')}))", 'p')} FROM gnb""")
def nb_gaussian(spark, sf):
    g = gaussian_margin(spark, sf)
    return g.select("doc_id", F.round("margin", 5).alias("margin"), B.sigmoid(F.col("margin")).alias("p"))


def lg(p):
    return f"ln(greatest(least({p}, 1 - 1e-9), 1e-9) / (1 - greatest(least({p}, 1 - 1e-9), 1e-9)))"


_PS, _PW = f"(1 / (1 + exp(-{clip('gm')})))", f"(1 / (1 + exp(-{clip('margin')})))"


@query("nb_hybrid", f"""WITH {TOTALS}, {GNB[len(U.CORPUS) + 1:]}
SELECT doc_id, {r(f"1 / (1 + exp(-(0.5 * {lg(_PS)} + 0.5 * {lg(_PW)})))", 'p', 5)} FROM gnb JOIN mnb USING (doc_id)""", digits=5)
def nb_hybrid(spark, sf):
    """Style and word posteriors pooled in log-odds space."""
    target = C.target(spark, sf)
    w = B.score(target, T.word_terms(target), B.multinomial_model(train_terms(spark, sf)), B.prior_gap(C.labelled(spark, sf)))
    g = gaussian_margin(spark, sf).withColumnRenamed("margin", "gm")
    return g.join(w, "doc_id").select(
        "doc_id", B.opinion_pool(B.sigmoid(F.col("gm")), B.sigmoid(F.col("margin"))).alias("p"))


def _log_ratio(name, value, binary):
    @query(name, f"""WITH {WORD_TFIDF}, pq AS (SELECT term, 1.0 + coalesce(sum({value}) FILTER (label = 1), 0) AS p,
 1.0 + coalesce(sum({value}) FILTER (label = 0), 0) AS q FROM tfidf WHERE label IS NOT NULL GROUP BY term)
SELECT term, {r('ln((p / sum(p) OVER ()) / (q / sum(q) OVER ()))', 'r')} FROM pq""")
    def run(spark, sf):
        tr = C.labelled(spark, sf)
        t = T.word_terms(tr)
        v = T.weigh(t, T.fit_vocab(t, tr)).join(tr.select(*LAB), "doc_id")
        return B.log_ratio(v, binary=binary).select("term", "r")


_log_ratio("nb_log_ratio", "value", False)
_log_ratio("nb_log_ratio_binary", "1.0", True)


@query("diagnostic_terms", f"""WITH {TOTALS}, d AS (SELECT term, {r('lp1 - lp0', 'log_odds')} FROM mod)
(SELECT *, 1 AS side FROM d ORDER BY log_odds DESC, term LIMIT 15) UNION ALL
(SELECT *, 0 AS side FROM d ORDER BY log_odds, term LIMIT 15)""")
def diagnostic_terms(spark, sf):
    return B.diagnostic_terms(B.multinomial_model(train_terms(spark, sf)))


SIZES, ALPHAS = [500, 2000, 8000], [0.1, 0.5, 1.0]
_W = " UNION ALL ".join(
    f"SELECT {k} AS vocab_size, {a}::DOUBLE AS alpha, term, ln((c1 + {a}) / (sum(c1) OVER () + {a} * count(*) OVER ())) - "
    f"ln((c0 + {a}) / (sum(c0) OVER () + {a} * count(*) OVER ())) AS w FROM ranked_v WHERE rank <= {k}" for k in SIZES for a in ALPHAS)


@query("param_sweep", f"""WITH {U.WORDS}, sp AS (SELECT doc_id, label, CASE WHEN rk < round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rk,
  count(*) OVER (PARTITION BY label) AS n FROM corpus WHERE label IS NOT NULL)),
tot AS (SELECT term, coalesce(sum(cnt) FILTER (sp.label = 0), 0) AS c0, coalesce(sum(cnt) FILTER (sp.label = 1), 0) AS c1
  FROM terms JOIN sp USING (doc_id) WHERE split = 'train' GROUP BY term),
ranked_v AS (SELECT *, row_number() OVER (ORDER BY c0 + c1 DESC, term) AS rank FROM tot),
g AS (SELECT ln(sum((label = 1)::INT)::DOUBLE / sum((label = 0)::INT)) AS g FROM sp WHERE split = 'train'),
w AS ({_W}), grid AS (SELECT DISTINCT vocab_size, alpha FROM w),
s AS (SELECT t.doc_id, vocab_size, alpha, sum(cnt * w) AS s FROM terms t JOIN sp USING (doc_id) JOIN w USING (term) GROUP BY ALL),
p AS (SELECT sp.doc_id, sp.label AS y, split, grid.vocab_size, grid.alpha, (round(coalesce(s, 0) + g, 6) >= 0)::INT AS pred
  FROM sp CROSS JOIN grid CROSS JOIN g LEFT JOIN s ON s.doc_id = sp.doc_id AND s.vocab_size = grid.vocab_size AND s.alpha = grid.alpha),
f AS (SELECT vocab_size, alpha, split, {U.f1_sql()} AS f1 FROM p GROUP BY ALL)
SELECT vocab_size, alpha, {r("max(f1) FILTER (split = 'train')", 'train_f1')}, {r("max(f1) FILTER (split = 'val')", 'val_f1')},
{r("max(f1) FILTER (split = 'train') - max(f1) FILTER (split = 'val')", 'gap')} FROM f GROUP BY ALL""")
def param_sweep(spark, sf):
    """Vocabulary size x alpha: train and validation macro-F1 and their gap."""
    lab = C.labelled(spark, sf)
    split = ranks.stratified_holdout(lab.select(*LAB))
    tr = split.where("split = 'train'")
    terms = T.word_terms(lab)
    docs = with_stats(split, B.prior_gap(tr))
    p = B.param_sweep(terms.join(tr.select(*LAB), "doc_id"), terms, docs, SIZES, ALPHAS)
    f = M.macro_f1(p, by=["vocab_size", "alpha", "split"])
    of = lambda s: F.max(F.when(F.col("split") == s, F.col("macro_f1")))
    return f.groupBy("vocab_size", "alpha").agg(
        of("train").alias("train_f1"), of("val").alias("val_f1"), (of("train") - of("val")).alias("gap"))


# --- language models --------------------------------------------------------------------

_BANK_BLOCKS = f"""{U.CORPUS}, {char_sql(3, 4)},
short4 AS (SELECT doc_id, p AS term FROM chunks WHERE length(p) < 4),
wt AS (SELECT doc_id, {U.TOK} AS tok FROM corpus),
bt AS (SELECT doc_id, 'c' || n AS block, term, count(*) AS cnt FROM (SELECT doc_id, n, term FROM grams
   UNION ALL SELECT doc_id, 4, term FROM short4) GROUP BY ALL
 UNION ALL SELECT doc_id, 'w1', term, count(*) FROM (SELECT doc_id, unnest(tok) AS term FROM wt) GROUP BY ALL
 UNION ALL SELECT doc_id, 'w2', term, count(*) FROM (SELECT doc_id, unnest({_pair_sql()}) AS term FROM wt) GROUP BY ALL),
bm0 AS (SELECT block, term, coalesce(sum(cnt) FILTER (label = 0), 0) AS c0, coalesce(sum(cnt) FILTER (label = 1), 0) AS c1
 FROM bt JOIN corpus USING (doc_id) WHERE label IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
bm AS (SELECT block, term, ln((c0 + 1.0) / (sum(c0) OVER w + count(*) OVER w)) AS lp0,
 ln((c1 + 1.0) / (sum(c1) OVER w + count(*) OVER w)) AS lp1 FROM bm0 WINDOW w AS (PARTITION BY block)),
bs AS (SELECT doc_id, block, sum(cnt) AS n, sum(cnt * lp0) AS s0, sum(cnt * lp1) AS s1 FROM bt JOIN bm USING (block, term) GROUP BY ALL)"""


def _mean(c, b):
    return f"coalesce(max(s{c}) FILTER (block = '{b}'), 0) / (coalesce(max(n) FILTER (block = '{b}'), 0) + 1e-9)"


@query("ngram_logprob", f"""WITH {_BANK_BLOCKS} SELECT doc_id, {', '.join(
    r(_mean(0, b), f'{b}_lp0') + ', ' + r(_mean(1, b), f'{b}_lp1') + ', ' + r(_mean(0, b) + ' - ' + _mean(1, b), f'{b}_llr')
    for b in L.BANK)} FROM corpus LEFT JOIN bs USING (doc_id) GROUP BY doc_id""")
def ngram_logprob(spark, sf):
    """Mean log-probability of each document under the two class models, four n-gram kinds."""
    docs = C.corpus(spark, sf)
    terms = L.counted_bank(docs)
    model = L.bank_model(terms.where("label IS NOT NULL"))
    return L.bank_features(docs, terms.drop("label"), model)


@query("ngram_logprob_cross", f"""WITH {_BANK_BLOCKS.split('bm0 AS (')[0]} sp AS (SELECT doc_id, label, label AS y FROM corpus WHERE label IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rk, count(*) OVER (PARTITION BY y) AS n FROM sp),
fo AS (SELECT doc_id, label, (CASE WHEN rk < (n // 5 + 1) * (n % 5) THEN rk // (n // 5 + 1)
    ELSE n % 5 + (rk - (n // 5 + 1) * (n % 5)) // greatest(n // 5, 1) END)::INT AS fold FROM ranked),
hs AS (SELECT DISTINCT fold AS held FROM fo),
bm0 AS (SELECT held, block, term, coalesce(sum(cnt) FILTER (label = 0), 0) AS c0, coalesce(sum(cnt) FILTER (label = 1), 0) AS c1
 FROM bt JOIN fo USING (doc_id), hs WHERE fold <> held GROUP BY ALL HAVING count(*) >= 3),
bm AS (SELECT held, block, term, ln((c0 + 1.0) / (sum(c0) OVER w + count(*) OVER w)) AS lp0,
 ln((c1 + 1.0) / (sum(c1) OVER w + count(*) OVER w)) AS lp1 FROM bm0 WINDOW w AS (PARTITION BY held, block)),
bs AS (SELECT doc_id, bt.block AS block, sum(cnt) AS n, sum(cnt * lp0) AS s0, sum(cnt * lp1) AS s1
 FROM bt JOIN fo USING (doc_id) JOIN bm ON bm.block = bt.block AND bm.term = bt.term AND bm.held = fo.fold GROUP BY ALL)
SELECT doc_id, max(fold)::INT AS fold, {', '.join(
    r(_mean(0, b), f'{b}_lp0') + ', ' + r(_mean(1, b), f'{b}_lp1') + ', ' + r(_mean(0, b) + ' - ' + _mean(1, b), f'{b}_llr')
    for b in L.BANK)} FROM fo LEFT JOIN bs USING (doc_id) GROUP BY doc_id""")
def ngram_logprob_cross(spark, sf):
    """The same columns for the labelled documents, each under the model of the other folds (five, stratified)."""
    folds = ranks.stratified_kfold(cut_lineage(C.labelled(spark, sf).select("doc_id", "label"))).select("doc_id", "label", "fold")
    folds = cut_lineage(folds)
    # the fold joins the texts, not their terms
    texts = C.labelled(spark, sf).select("doc_id", "text").join(folds, "doc_id")
    terms = cut_lineage(L.bank_terms(texts, ("doc_id", "label", "fold")))
    feats = L.bank_features(folds, terms, L.bank_model_cross(terms), on=("fold", "block", "term"))
    return feats.join(folds.select("doc_id", "fold"), "doc_id")


@query("llr_bank16")
def llr_bank16(spark, sf):
    """The 12 model columns (checked in ngram_logprob), compression and repetition rates."""
    return L.bank16(C.documents(spark, sf), C.labelled(spark, sf))


def _bk(c):
    return f"""g{c} AS (SELECT g, length(g) AS n, count(*) AS k FROM gr WHERE label = {c} GROUP BY ALL),
x{c} AS (SELECT left(g, n - 1) AS ctx, n, sum(k) AS k FROM g{c} WHERE n > 1 GROUP BY ALL),
q{c} AS (SELECT g, 0.4 ** (4 - g{c}.n) * g{c}.k / x{c}.k AS p FROM g{c} JOIN x{c} ON x{c}.ctx = left(g, g{c}.n - 1) AND x{c}.n = g{c}.n),
u{c} AS (SELECT sum(k) + count(*) AS d FROM g{c} WHERE n = 1)"""


def _sc(c):
    return (f"ln(coalesce(a{c}.p, b{c}.p, e{c}.p, 0.4 ** 3 * (coalesce(z{c}.k, 0) + 1) / u{c}.d)) AS s{c}",
            f"LEFT JOIN q{c} a{c} ON a{c}.g = CASE WHEN length(w) >= 4 THEN right(w, 4) END "
            f"LEFT JOIN q{c} b{c} ON b{c}.g = CASE WHEN length(w) >= 3 THEN right(w, 3) END "
            f"LEFT JOIN q{c} e{c} ON e{c}.g = right(w, 2) LEFT JOIN g{c} z{c} ON z{c}.g = right(w, 1) CROSS JOIN u{c}")


BACKOFF = f"""{U.CORPUS}, ch AS (SELECT doc_id, label, unnest(string_split(chr(2) || text || chr(3), '')) AS c,
  unnest(range(0, length(text) + 2)) AS i FROM corpus),
lg AS (SELECT doc_id, label, i, c, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3 FROM ch
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
gr AS (SELECT label, c AS g FROM lg UNION ALL SELECT label, c1 || c FROM lg WHERE c1 IS NOT NULL
  UNION ALL SELECT label, c2 || c1 || c FROM lg WHERE c2 IS NOT NULL UNION ALL SELECT label, c3 || c2 || c1 || c FROM lg WHERE c3 IS NOT NULL),
{_bk(0)}, {_bk(1)},
win AS (SELECT doc_id, coalesce(c3, '') || coalesce(c2, '') || c1 || c AS w FROM lg WHERE i > 0 AND label IS NULL),
dw AS (SELECT w, count(DISTINCT doc_id) AS df FROM win GROUP BY w),
ws AS (SELECT w, df, {_sc(0)[0]}, {_sc(1)[0]} FROM dw {_sc(0)[1]} {_sc(1)[1]})"""


@query("backoff_join", f"WITH {BACKOFF} SELECT w AS window, df, {r('s0', 's0')}, {r('s1', 's1')} FROM ws")
def backoff_join(spark, sf):
    """Back-off log-score of every distinct character window of the target."""
    return L.backoff_scores(L.windows(C.target(spark, sf)), L.backoff_tables(C.labelled(spark, sf)))


@query("perplexity_feats", f"""WITH {BACKOFF} SELECT doc_id, {r('avg(s0)', 'llp_human')}, {r('avg(s1)', 'llp_machine')},
{r('avg(s1) - avg(s0)', 'llr')}, {r('exp(-avg(s0))', 'ppl_human', 5)}, {r('stddev_pop(s1)', 'surprisal_std_machine', 5)}
FROM win JOIN ws USING (w) GROUP BY doc_id""")
def perplexity_feats(spark, sf):
    f = L.perplexity_features(C.target(spark, sf), C.labelled(spark, sf))
    return f.withColumn("ppl_human", F.round("ppl_human", 5)).withColumn(
        "surprisal_std_machine", F.round("surprisal_std_machine", 5))


# --- duplicates ---------------------------------------------------------------------------

@query("exact_overlap", f"""WITH {U.CORPUS}, {NORMED} SELECT doc_id, (lo = hi)::INT AS single_label
FROM normed JOIN known USING (key) WHERE label IS NULL""")
def exact_overlap(spark, sf):
    return D.overlap(C.target(spark, sf), C.labelled(spark, sf))


@query("prefix_neardup", f"""WITH {U.CORPUS}, p AS (SELECT doc_id, label, md5(left({U.NORM}, 120)) AS key FROM corpus),
k AS (SELECT key, min(label) AS lo, max(label) AS hi FROM p WHERE label IS NOT NULL GROUP BY key)
SELECT doc_id, (lo = hi)::INT AS single_label FROM p JOIN k USING (key) WHERE label IS NULL""")
def prefix_neardup(spark, sf):
    """Documents sharing the digest of the first 120 normalised characters (the operator's key)."""
    return D.overlap(C.target(spark, sf), C.labelled(spark, sf), "prefix")


@query("label_override", f"""WITH {U.LEGS}, {NORMED}
SELECT l.doc_id, CASE WHEN lo = hi THEN lo ELSE (p_a >= 0.5)::INT END AS label,
(lo = hi AND lo <> (p_a >= 0.5)::INT AND lo IS NOT NULL)::INT AS overridden
FROM legs l JOIN normed n USING (doc_id) LEFT JOIN known k ON k.key = n.key WHERE y IS NULL"""
       .replace("(lo = hi AND", "coalesce(lo = hi AND").replace("lo IS NOT NULL)::INT AS overridden", "lo IS NOT NULL, false)::INT AS overridden"))
def label_override(spark, sf):
    pred = U.legs(spark, sf).where(F.col("y").isNull()).select("doc_id", (F.col("p_a") >= 0.5).cast("int").alias("label"))
    return D.label_override(pred, C.target(spark, sf), C.labelled(spark, sf))


@query("dup_groups", f"""WITH {U.CORPUS}, {NORMED}, g AS (SELECT key, count(*) AS n, count(DISTINCT label) AS k FROM normed
  WHERE label IS NOT NULL GROUP BY key)
SELECT count(*) AS n_groups, sum((n > 1)::INT)::BIGINT AS dup_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS dup_rows,
sum((k > 1)::INT)::BIGINT AS mixed_groups FROM g""")
def dup_groups(spark, sf):
    return D.dup_groups(C.labelled(spark, sf))


@query("dedup_texts", f"WITH {U.CORPUS} SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM corpus GROUP BY 1")
def dedup_texts(spark, sf):
    return D.first_of_each(C.documents(spark, sf))


@query("id_overlap", """SELECT (SELECT count(*) FROM labels) AS n_labelled,
(SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS n_shared,
(SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS n_target""")
def id_overlap(spark, sf):
    """Ids on both sides, from one aggregate over the stacked id lists."""
    d = C.table(spark, sf, "documents").select("doc_id", F.lit(1).alias("d"), F.lit(0).alias("l"))
    l = C.table(spark, sf, "labels").select("doc_id", F.lit(0).alias("d"), F.lit(1).alias("l"))
    g = d.unionByName(l).groupBy("doc_id").agg(F.max("d").alias("d"), F.max("l").alias("l"))
    return g.agg(F.sum("l").alias("n_labelled"), F.sum(F.col("d") * F.col("l")).alias("n_shared"),
                 F.sum(F.col("d") * (1 - F.col("l"))).alias("n_target"))
