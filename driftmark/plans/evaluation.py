"""Metrics, blends, weights, selections and experiment tables on two score legs."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import bayes as B
from ..operators import ensemble as N
from ..operators import experiments as E
from ..operators import lenses as Z
from ..operators import metrics as M
from ..operators import ranks
from ..operators import shift as H
from ..session import cut_lineage
from ..sources import corpus as C
from . import common as U
from .registry import query, r

PRED = f"{U.LEGS}, {U.FOLDS}, preds AS (SELECT *, (p_a >= 0.5)::INT AS pred FROM folded)"
AUC = """(sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))"""


def preds(spark, sf):
    return U.folded(spark, sf).withColumn("pred", (F.col("p_a") >= 0.5).cast("int"))


# --- metrics ------------------------------------------------------------------------------

@query("class_balance", """SELECT quality AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM labels GROUP BY quality""")
def class_balance(spark, sf):
    return M.class_balance(C.table(spark, sf, "labels").select(F.col("quality").alias("label")))


@query("macro_f1", f"WITH {PRED} SELECT {r(U.f1_sql(), 'macro_f1')} FROM preds")
def macro_f1(spark, sf):
    return M.macro_f1(preds(spark, sf))


@query("macro_f1_pooled", f"WITH {PRED} SELECT fold, {r(U.f1_sql(), 'macro_f1')} FROM preds GROUP BY fold UNION ALL SELECT -1, {r(U.f1_sql(), 'macro_f1')} FROM preds")
def macro_f1_pooled(spark, sf):
    """Pooled over all held-out rows (fold -1) next to every fold."""
    p = preds(spark, sf)
    return M.macro_f1(p, by=["fold"]).unionByName(M.macro_f1(p).select(F.lit(-1).alias("fold"), "macro_f1"))


@query("macro_f1_foldmean", f"WITH {PRED} SELECT {r('avg(f)', 'macro_f1')} FROM (SELECT {U.f1_sql()} AS f FROM preds GROUP BY fold)")
def macro_f1_foldmean(spark, sf):
    return M.macro_f1_foldmean(preds(spark, sf))


@query("accuracy", f"WITH {PRED} SELECT {r('avg((y = pred)::INT)', 'accuracy')} FROM preds")
def accuracy(spark, sf):
    return M.accuracy(preds(spark, sf))


@query("confusion", f"WITH {PRED} SELECT y, pred, count(*) AS n FROM preds GROUP BY ALL")
def confusion(spark, sf):
    return M.confusion(preds(spark, sf))


@query("roc_auc", f"""WITH {PRED}, rk AS (SELECT fold, y, rank() OVER w + (count(*) OVER (PARTITION BY fold, p_b) - 1) / 2.0 AS rk
 FROM preds WINDOW w AS (PARTITION BY fold ORDER BY p_b)) SELECT fold, {r(AUC, 'auc')} FROM rk GROUP BY fold""")
def roc_auc(spark, sf):
    return M.roc_auc(preds(spark, sf), "y", "p_b", ["fold"])


@query("log_loss", f"""WITH {PRED}, cw AS (SELECT y, (SELECT count(*) FROM preds) / (2.0 * count(*)) AS w FROM preds GROUP BY y)
SELECT {r('sum(-w * (y * ln(p_a) + (1 - y) * ln(1 - p_a))) / sum(w)', 'log_loss')} FROM preds JOIN cw USING (y)""")
def log_loss(spark, sf):
    """Class-weighted cross-entropy."""
    p = preds(spark, sf)
    w = H.class_weight_balanced(p, "y")
    return M.log_loss(p.join(F.broadcast(w), "y"), "y", "p_a", "class_weight")


@query("class_weight_balanced", f"WITH {PRED} SELECT y AS label, {r('(SELECT count(*) FROM preds) / (2.0 * count(*))', 'class_weight')} FROM preds GROUP BY y")
def class_weight_balanced(spark, sf):
    return H.class_weight_balanced(preds(spark, sf).select(F.col("y").alias("label")))


GRID = [i / 20 for i in range(21)]
SWEEP = f"grid AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS t)"


@query("threshold_sweep", f"""WITH {PRED}, {SWEEP}, s AS (SELECT t, y, (p_a >= t)::INT AS pred FROM folded, grid)
SELECT t, {r(U.f1_sql(), 'macro_f1')} FROM s GROUP BY t""")
def threshold_sweep(spark, sf):
    """Macro-F1 at every cut, from one pass of counts per grid cell."""
    return M.threshold_sweep(U.scored(spark, sf), GRID, "y", "p_a")


@query("best_threshold", f"""WITH {PRED}, {SWEEP}, s AS (SELECT t, y, (p_a >= t)::INT AS pred FROM folded, grid),
f AS (SELECT t, {r(U.f1_sql(), 'macro_f1')} FROM s GROUP BY t) SELECT * FROM f ORDER BY macro_f1 DESC, t LIMIT 1""")
def best_threshold(spark, sf):
    f = M.threshold_sweep(U.scored(spark, sf), GRID, "y", "p_a").withColumn("macro_f1", F.round("macro_f1", 6))
    return f.orderBy(F.col("macro_f1").desc(), "t").limit(1)


@query("robust_threshold", f"""WITH {PRED}, {SWEEP}, s AS (SELECT t, fold < 2 AS lens_a, y, (p_a > t)::INT AS pred FROM folded, grid),
f AS (SELECT t, lens_a, {U.f1_sql()} AS f FROM s GROUP BY ALL)
SELECT t, {r('max(f) FILTER (lens_a)', 'f1_a')}, {r('max(f) FILTER (NOT lens_a)', 'f1_b')}, {r('min(f)', 'worst')} FROM f GROUP BY t""")
def robust_threshold(spark, sf):
    """Both lenses' F1 per cut and the smaller of the two."""
    d = U.folded(spark, sf).withColumn("lens", F.when(F.col("fold") < 2, "a").otherwise("b"))
    f = M.threshold_sweep(d, GRID, "y", "p_a", strict=True, by=["lens"])
    of = lambda l: F.max(F.when(F.col("lens") == l, F.col("macro_f1")))
    return f.groupBy("t").agg(of("a").alias("f1_a"), of("b").alias("f1_b"), F.min("macro_f1").alias("worst"))


@query("train_val_gap", f"""WITH {PRED}, g AS (SELECT h.f AS held, p.fold = h.f AS val, y, pred FROM preds p, (SELECT DISTINCT fold AS f FROM preds) h),
f AS (SELECT held, val, {U.f1_sql()} AS f FROM g GROUP BY ALL)
SELECT held, {r('max(f) FILTER (NOT val)', 'train_f1')}, {r('max(f) FILTER (val)', 'val_f1')},
{r('max(f) FILTER (NOT val) - max(f) FILTER (val)', 'gap')} FROM f GROUP BY held""")
def train_val_gap(spark, sf):
    """Train F1 minus validation F1 for every held fold.

    Confusion counts are taken once per fold; a fold's train counts are the total
    minus its own, so no row is repeated.
    """
    p = preds(spark, sf)
    cells = p.groupBy(F.col("fold").alias("held")).agg(*[
        F.sum(F.when((F.col("y") == a) & (F.col("pred") == b), 1).otherwise(0)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    names = ["n00", "n01", "n10", "n11"]
    both = ranks.with_stats(cells, cells.agg(*[F.sum(n).alias(f"t_{n}") for n in names]))

    def f1(c):
        one = lambda tp, off: X.safe_div(2 * tp, 2 * tp + off)
        off = c["n01"] + c["n10"]
        return (one(c["n00"], off) + one(c["n11"], off)) / 2

    val = f1({n: F.col(n) for n in names})
    train = f1({n: F.col(f"t_{n}") - F.col(n) for n in names})
    return both.select("held", train.alias("train_f1"), val.alias("val_f1"), (train - val).alias("gap"))


# --- lenses -----------------------------------------------------------------------------------

SIZES = f"{U.CORPUS}, sizes AS (SELECT source AS cluster, count(*) AS n FROM corpus GROUP BY source)"


def clusters(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", F.col("source").alias("cluster"))


@query("cluster_sizes", f"WITH {SIZES} SELECT cluster, n FROM sizes")
def cluster_sizes(spark, sf):
    return Z.cluster_sizes(clusters(spark, sf))


RR = f"{SIZES}, rr AS (SELECT cluster, n, ((row_number() OVER (ORDER BY n DESC, cluster) - 1) % 5)::INT AS fold FROM sizes)"


@query("cluster_round_robin", f"WITH {RR} SELECT * FROM rr")
def cluster_round_robin(spark, sf):
    return Z.round_robin(Z.cluster_sizes(clusters(spark, sf)))


@query("cluster_greedy_balance", f"""WITH RECURSIVE {SIZES}, o AS (SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS i FROM sizes),
st AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS cluster, 0::BIGINT AS n, 0 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS tot
 UNION ALL SELECT o.i, o.cluster, o.n, (list_position(tot, list_min(tot)) - 1)::INT,
  list_transform(tot, lambda v, k: CASE WHEN k = list_position(tot, list_min(tot)) THEN v + o.n ELSE v END)
  FROM st JOIN o ON o.i = st.i + 1) SELECT cluster, n, fold FROM st WHERE i > 0""")
def cluster_greedy_balance(spark, sf):
    return Z.greedy_balance(Z.cluster_sizes(clusters(spark, sf)))


@query("fold_crosstab_join", f"""WITH {PRED}, s2 AS (SELECT source AS cluster, count(*) AS n FROM corpus GROUP BY source),
rr AS (SELECT cluster, ((row_number() OVER (ORDER BY n DESC, cluster) - 1) % 5)::INT AS fold_b FROM s2)
SELECT p.fold AS fold_a, fold_b, count(*) AS n FROM preds p JOIN corpus c USING (doc_id) JOIN rr ON rr.cluster = c.source GROUP BY ALL""")
def fold_crosstab_join(spark, sf):
    """Two lens assignments joined and counted."""
    cl = clusters(spark, sf)
    b = Z.assign(cl, Z.round_robin(Z.cluster_sizes(cl))).select("doc_id", F.col("fold").alias("fold_b"))
    return preds(spark, sf).select("doc_id", F.col("fold").alias("fold_a")).join(b, "doc_id").groupBy("fold_a", "fold_b").agg(
        F.count(F.lit(1)).alias("n"))


@query("crosstab", f"""WITH {PRED}, x AS (SELECT lang, fold FROM preds JOIN corpus USING (doc_id)),
c AS (SELECT lang, fold, count(*) AS n FROM x GROUP BY ALL)
SELECT lang, {', '.join(f'coalesce(max(n) FILTER (fold = {i}), 0)::BIGINT AS f{i}' for i in range(5))},
{r('max(n)::DOUBLE / (SELECT count(*) FROM x)', 'max_share')} FROM c GROUP BY lang""")
def crosstab(spark, sf):
    d = C.table(spark, sf, "documents").select("doc_id", "lang")
    x = preds(spark, sf).select("doc_id", "fold").join(d, "doc_id")
    c = x.groupBy("lang").pivot("fold", [0, 1, 2, 3, 4]).agg(F.count(F.lit(1)))
    cols = [F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias(f"f{i}") for i in range(5)]
    wide = ranks.with_stats(c, x.agg(F.count(F.lit(1)).alias("_n")))
    return wide.select("lang", *cols, (F.greatest(*[F.coalesce(F.col(str(i)), F.lit(0)) for i in range(5)]) / F.col("_n")).alias("max_share"))


# --- blends -----------------------------------------------------------------------------------

@query("sigmoid", f"WITH {U.LEGS} SELECT doc_id, {r('1 / (1 + exp(-greatest(least(m_a * 300, 500), -500)))', 's')} FROM legs")
def sigmoid(spark, sf):
    return U.legs(spark, sf).select("doc_id", B.sigmoid(F.col("m_a") * 300).alias("s"))


@query("logit", f"WITH {U.LEGS} SELECT doc_id, {r('ln(p_b / (1 - p_b))', 'm')} FROM legs")
def logit(spark, sf):
    return U.legs(spark, sf).select("doc_id", B.logit(F.col("p_b")).alias("m"))


@query("logsumexp", f"WITH {U.LEGS} SELECT doc_id, {r('ln(exp(m_a) + exp(m_b))', 'lse')} FROM legs")
def logsumexp(spark, sf):
    return U.legs(spark, sf).select("doc_id", B.logsumexp(F.col("m_a"), F.col("m_b")).alias("lse"))


@query("softmax_p1", f"WITH {U.LEGS} SELECT doc_id, {r('exp(m_b) / (exp(m_a) + exp(m_b))', 'p1')} FROM legs")
def softmax_p1(spark, sf):
    return U.legs(spark, sf).select("doc_id", N.softmax_p1(F.col("m_a"), F.col("m_b")).alias("p1"))


@query("log_opinion_pool", f"WITH {U.LEGS} SELECT doc_id, {r('1 / (1 + exp(-(0.3 * ln(p_a / (1 - p_a)) + 0.7 * ln(p_b / (1 - p_b)))))', 'p')} FROM legs")
def log_opinion_pool(spark, sf):
    return U.legs(spark, sf).select("doc_id", B.opinion_pool(F.col("p_a"), F.col("p_b"), 0.3).alias("p"))


@query("soft_vote", f"WITH {U.LEGS} SELECT doc_id, {r('(p_a + 3 * p_b) / 4', 'p', 9)} FROM legs", digits=9)
def soft_vote(spark, sf):
    return U.legs(spark, sf).select("doc_id", N.soft_vote(["p_a", "p_b"], [1.0, 3.0]).alias("p"))


BLEND_W = [i / 10 for i in range(11)]


@query("prob_blend", f"""WITH {PRED}, w AS (SELECT unnest({BLEND_W})::DOUBLE AS w),
s AS (SELECT w, fold, y, (round(w * p_a + (1 - w) * p_b, 9) >= 0.5)::INT AS pred FROM folded, w)
SELECT w, fold, {r(U.f1_sql(), 'macro_f1')} FROM s GROUP BY ALL""")
def prob_blend(spark, sf):
    """Macro-F1 of every blend weight on every fold."""
    g = N.blend_grid(U.folded(spark, sf), "p_a", "p_b", BLEND_W, ["fold", "y"])
    return M.macro_f1(g.withColumn("pred", (F.round("p", 9) >= 0.5).cast("int")), by=["w", "fold"])


@query("seed_average", f"""WITH {U.CORPUS}, t AS (SELECT doc_id, text, {U.WS_TOK} AS tok, unnest([1, 2, 3]) AS seed FROM corpus),
h AS (SELECT *, ('0x' || substr(md5(seed || ':' || doc_id), 1, 12))::BIGINT AS h FROM t),
c AS (SELECT doc_id, length(CASE WHEN len(tok) > 187 THEN array_to_string(tok[h % (len(tok) - 186) + 1 : h % (len(tok) - 186) + 187], ' ') ELSE text END) AS n FROM h)
SELECT doc_id, {r('avg(1 / (1 + exp(7 - ln(1.0 + n))))', 'p', 8)}, count(*) AS n_seeds FROM c GROUP BY doc_id""", digits=8)
def seed_average(spark, sf):
    """Mean over three seeds of the length leg on a random crop of each document."""
    t = C.corpus(spark, sf).select("doc_id", "text", X.tok_ws(F.col("text")).alias("tok"))
    p = [1.0 / (1.0 + F.exp(7.0 - F.log(1.0 + F.length(X.crop_random(F.col("text"), F.col("tok"), F.col("doc_id"), K.CROP, seed)))))
         for seed in (1, 2, 3)]
    return N.seed_average(t.select("doc_id", F.explode(F.array(*p)).alias("p")))


@query("margin_zscore", f"""WITH {U.LEGS}, s AS (SELECT avg(m_a) AS ma, stddev_pop(m_a) AS sa, avg(m_b) AS mb, stddev_pop(m_b) AS sb FROM scored)
SELECT doc_id, {r('(m_a - ma) / (sa + 1e-9) + (m_b - mb) / (sb + 1e-9)', 'margin')} FROM scored, s""")
def margin_zscore(spark, sf):
    return N.margin_zscore(U.scored(spark, sf), "m_a", "m_b").select("doc_id", "margin")


def _rk(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


@query("rank_average", f"WITH {U.LEGS} SELECT doc_id, {r(f'0.5 * {_rk('p_a')} + 0.5 * {_rk('p_b')}', 'p')} FROM scored")
def rank_average(spark, sf):
    return N.rank_average(U.scored(spark, sf).select("doc_id", "p_a", "p_b"), "p_a", "p_b").select("doc_id", "p")


@query("leg_align", f"""WITH {U.LEGS}, a AS (SELECT doc_id, count(*) AS n FROM legs WHERE doc_id % 10 <> 3 GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 10 = 4) GROUP BY doc_id)
SELECT sum((a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL)::INT)::BIGINT AS matched, sum((b.doc_id IS NULL)::INT)::BIGINT AS left_only,
sum((a.doc_id IS NULL)::INT)::BIGINT AS right_only, sum((coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1)::INT)::BIGINT AS repeated
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def leg_align(spark, sf):
    """A score leg with gaps against a label leg with repeated rows: matched, one-sided and repeated ids."""
    a, b = U.legs(spark, sf).where(F.col("doc_id") % 10 != 3), C.table(spark, sf, "labels").select("doc_id")
    return N.leg_audit(a, b.unionByName(b.where(F.col("doc_id") % 10 == 4)))


@query("align_features", f"""WITH {U.CORPUS} SELECT c.doc_id, coalesce(c.label, -1)::INT AS label, len(e.embedding)::INT AS n_features, length(c.text)::INT AS n_chars
FROM corpus c JOIN embeddings e ON e.vec_id = c.doc_id""")
def align_features(spark, sf):
    """Feature rows joined to texts on the id; positions never matter."""
    e = C.features(spark, sf).select(F.col("vec_id").alias("doc_id"), F.size("x").alias("n_features"))
    return C.corpus(spark, sf).select("doc_id", F.coalesce("label", F.lit(-1)).alias("label"), F.length("text").alias("n_chars")).join(e, "doc_id")


# --- weights and selections -------------------------------------------------------------------

RATIO = f"""{U.LEGS}, wr AS (SELECT doc_id, y, p_b, least(greatest(least(p_b, 0.95), 0.05) / (1 - greatest(least(p_b, 0.95), 0.05)), 10) AS w0 FROM scored),
wt AS (SELECT doc_id, y, p_b, w0 / avg(w0) OVER () AS w FROM wr)"""


def weighted(spark, sf):
    return H.density_ratio(U.scored(spark, sf), "p_b")


@query("density_ratio", f"WITH {RATIO} SELECT doc_id, {r('w', 'w')} FROM wt")
def density_ratio(spark, sf):
    return weighted(spark, sf).select("doc_id", "w")


@query("weight_soften", f"WITH {RATIO} SELECT doc_id, {r('w ** 0.5 / avg(w ** 0.5) OVER ()', 'w')} FROM wt")
def weight_soften(spark, sf):
    return H.weight_soften(weighted(spark, sf), 0.5).select("doc_id", "w")


@query("weight_summary", f"WITH {RATIO} SELECT {r('min(w)', 'min_w')}, {r('median(w)', 'median_w')}, {r('max(w)', 'max_w')}, {r('avg(p_b)', 'mean_p')} FROM wt")
def weight_summary(spark, sf):
    return H.weight_summary(weighted(spark, sf), "w", "p_b")


@query("length_iw", f"""WITH {U.CORPUS}, t AS (SELECT doc_id, label, ln(1.0 + len({U.WS_TOK})) AS v FROM corpus),
sp AS (SELECT min(v) AS lo, max(v) AS hi FROM t),
bn AS (SELECT doc_id, label, least(floor((v - lo) / ((hi - lo) / 20)), 19)::INT AS bin FROM t, sp),
a AS (SELECT bin, count(*) / (SELECT count(*)::DOUBLE FROM bn WHERE label IS NOT NULL) AS a FROM bn WHERE label IS NOT NULL GROUP BY bin),
b AS (SELECT bin, count(*) / (SELECT count(*)::DOUBLE FROM bn WHERE label IS NULL) AS b FROM bn WHERE label IS NULL GROUP BY bin),
w AS (SELECT doc_id, greatest(least(coalesce(b, 0) / a, 4), 0.25) AS w FROM bn JOIN a USING (bin) LEFT JOIN b USING (bin) WHERE label IS NOT NULL)
SELECT doc_id, {r('w / avg(w) OVER ()', 'w')} FROM w""")
def length_iw(spark, sf):
    """Length weights from the histogram ratio of target and training lengths."""
    size = lambda d: d.select("doc_id", F.log1p(F.size(X.tok_ws(F.col("text"))).cast("double")).alias("log_tokens"))
    return H.length_histogram_weights(size(C.labelled(spark, sf)), size(C.target(spark, sf))).select("doc_id", "w")


@query("length_iw_kde", f"""WITH {U.CORPUS}, t AS (SELECT doc_id, label IS NULL AS tg, ln(1.0 + len({U.WS_TOK})) AS v FROM corpus),
sp AS (SELECT min(v) AS lo, CASE WHEN max(v) > min(v) THEN (max(v) - min(v)) / 255 ELSE 1 END AS st FROM t),
s AS (SELECT tg, count(*) AS n, greatest(stddev_samp(v) * pow(count(*), -0.2), 1e-6) AS h FROM t GROUP BY tg),
c AS (SELECT tg, v, count(*) AS c FROM t GROUP BY ALL),
k AS (SELECT tg, v, c, n, h, lo, st, unnest(range(least(greatest(floor((v - 5 * h - lo) / st), 0), least(ceil((v + 5 * h - lo) / st), 255))::BIGINT,
 1 + greatest(greatest(floor((v - 5 * h - lo) / st), 0), least(ceil((v + 5 * h - lo) / st), 255))::BIGINT)) AS g FROM c JOIN s USING (tg), sp),
d AS (SELECT tg, g, sum(c * exp(-0.5 * ((v - lo - g * st) / h) ** 2) / (h * n)) AS d FROM k GROUP BY ALL),
w AS (SELECT a.g, greatest(least(coalesce(b.d, 0) / greatest(a.d, 1e-9), 4.0), 0.25) AS w FROM (FROM d WHERE NOT tg) a LEFT JOIN (FROM d WHERE tg) b USING (g)),
o AS (SELECT doc_id, w FROM t, sp, w WHERE NOT tg AND round_even((v - lo) / st, 0)::BIGINT = w.g)
SELECT doc_id, {r('w / avg(w) OVER ()', 'w')} FROM o""")
def length_iw_kde(spark, sf):
    """The same weights from Gaussian kernel densities on a grid."""
    size = lambda d: d.select("doc_id", F.log1p(F.size(X.tok_ws(F.col("text"))).cast("double")).alias("log_tokens"))
    return H.length_kde_weights(size(C.labelled(spark, sf)), size(C.target(spark, sf))).select("doc_id", "w")


SEL = f"""{U.LEGS}, pool AS (SELECT doc_id, m_a, m_b, (m_a > 0)::INT AS la, (m_b > 0)::INT AS lb FROM legs WHERE y IS NULL),
pa AS (SELECT doc_id, m_a, la FROM (SELECT *, row_number() OVER (PARTITION BY la ORDER BY abs(m_a) DESC, doc_id) AS rk,
  count(*) OVER (PARTITION BY la) AS n FROM pool) WHERE rk <= greatest(1, floor(n * 0.5))),
pb AS (SELECT doc_id, m_b, lb FROM (SELECT *, row_number() OVER (PARTITION BY lb ORDER BY abs(m_b) DESC, doc_id) AS rk,
  count(*) OVER (PARTITION BY lb) AS n FROM pool) WHERE rk <= greatest(1, floor(n * 0.5)))"""


def pool(spark, sf):
    return U.stored(U.legs(spark, sf).where(F.col("y").isNull()))


@query("balanced_select", f"WITH {SEL} SELECT doc_id, m_a AS margin, la AS label FROM pa")
def balanced_select(spark, sf):
    p = pool(spark, sf).select("doc_id", F.col("m_a").alias("margin"))
    return H.balanced_select(p, 0.5)


@query("unbalanced_select", f"""WITH {SEL}, c AS (SELECT quantile_cont(abs(m_a), 0.5) AS q FROM pool)
SELECT doc_id, m_a AS margin, la AS label FROM pool, c WHERE abs(m_a) >= q""")
def unbalanced_select(spark, sf):
    p = pool(spark, sf).select("doc_id", F.col("m_a").alias("margin"))
    return H.unbalanced_select(p, 0.5)


@query("append_pseudo", f"""WITH {SEL} SELECT doc_id, y AS label, 1.0::DOUBLE AS weight, 'train' AS kind FROM scored
UNION ALL SELECT doc_id, la, 0.5::DOUBLE, 'pseudo' FROM pa""")
def append_pseudo(spark, sf):
    tr = U.scored(spark, sf).select("doc_id", F.col("y").alias("label"), F.lit(1.0).alias("weight"))
    return H.append_pseudo(tr, balanced_select(spark, sf), 0.5)


@query("cotrain_union", f"WITH {SEL} SELECT doc_id, coalesce(lb, la) AS label FROM pa FULL JOIN pb USING (doc_id)")
def cotrain_union(spark, sf):
    p = pool(spark, sf)
    w = H.balanced_select(p.select("doc_id", F.col("m_a").alias("margin")), 0.5)
    c = H.balanced_select(p.select("doc_id", F.col("m_b").alias("margin")), 0.5)
    return H.cotrain_union(w, c)


@query("agree_select", f"WITH {SEL} SELECT doc_id, la AS label FROM pa JOIN pb USING (doc_id) WHERE la = lb")
def agree_select(spark, sf):
    """Rows both views picked with the same label."""
    p = pool(spark, sf)
    w = H.balanced_select(p.select("doc_id", F.col("m_a").alias("margin")), 0.5)
    c = H.balanced_select(p.select("doc_id", F.col("m_b").alias("margin")), 0.5)
    return H.agreed(w, c)


@query("pseudo_quality", f"""WITH {U.LEGS}, s AS (SELECT y, m_a, abs(m_a) >= 0.5 AS used, ((m_a > 0)::INT = y) AS hit FROM scored)
SELECT count(*) AS n, {r('avg(used::INT)', 'coverage')}, {r('avg(hit::INT) FILTER (used)', 'precision')} FROM s""")
def pseudo_quality(spark, sf):
    """Coverage and precision of confident pseudo labels against known labels."""
    s = U.scored(spark, sf)
    used = F.abs("m_a") >= 0.5
    hit = ((F.col("m_a") > 0).cast("int") == F.col("y")).cast("double")
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg(used.cast("double")).alias("coverage"), F.avg(F.when(used, hit)).alias("precision"))


@query("pred_diff", f"""WITH {SEL} SELECT count(*) AS n, {r('avg(la)', 'machine_share')}, sum((la <> lb)::INT)::BIGINT AS changed,
(SELECT count(*) FROM pa) AS pseudo_used FROM pool""")
def pred_diff(spark, sf):
    p = pool(spark, sf)
    a, b = (F.col("m_a") > 0).cast("int"), (F.col("m_b") > 0).cast("int")
    d = p.agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("machine_share"), F.sum((a != b).cast("long")).alias("changed"))
    return ranks.with_stats(d, balanced_select(spark, sf).agg(F.count(F.lit(1)).alias("pseudo_used")))


# --- row stacking ------------------------------------------------------------------------------

@query("union_corpora", f"WITH {U.CORPUS} SELECT doc_id, (label IS NULL)::INT AS domain FROM corpus")
def union_corpora(spark, sf):
    """Labelled and target rows stacked with their domain."""
    a = C.labelled(spark, sf).select("doc_id", F.lit(0).alias("domain"))
    return a.unionByName(C.target(spark, sf).select("doc_id", F.lit(1).alias("domain")))


@query("augment_union", f"""WITH {U.CORPUS}, t AS (SELECT doc_id, label, text, {U.WS_TOK} AS tok FROM corpus WHERE label IS NOT NULL)
SELECT doc_id, label, 'full' AS kind, md5(text) AS text_md5 FROM t UNION ALL
SELECT doc_id, label, 'crop', md5(CASE WHEN len(tok) > 187 THEN array_to_string(tok[1:187], ' ') ELSE text END) FROM t""")
def augment_union(spark, sf):
    """Originals plus one crop each, labels repeated; one scan, two rows per document."""
    t = C.labelled(spark, sf).select("doc_id", "label", "text", X.tok_ws(F.col("text")).alias("tok"))
    both = F.array(F.struct(F.lit("full").alias("kind"), F.col("text").alias("t")),
                   F.struct(F.lit("crop").alias("kind"), X.crop_head(F.col("text"), F.col("tok")).alias("t")))
    return t.select("doc_id", "label", F.explode(both).alias("c")).select("doc_id", "label", "c.kind", F.md5("c.t").alias("text_md5"))


@query("length_adapt_recipes", f"""WITH {U.CORPUS}, t AS (SELECT doc_id, label, text, {U.WS_TOK} AS tok,
 ('0x' || substr(md5('42:' || doc_id), 1, 12))::BIGINT AS h, [130, 190, 279][('0x' || substr(md5('5:' || doc_id), 1, 12))::BIGINT % 3 + 1] AS sc
 FROM corpus WHERE label IS NOT NULL)
SELECT doc_id, label, 'crop_replace' AS recipe, md5(CASE WHEN len(tok) > 187 THEN array_to_string(tok[h % (len(tok) - 186) + 1 : h % (len(tok) - 186) + 187], ' ') ELSE text END) AS text_md5 FROM t
UNION ALL SELECT doc_id, label, 'aug_full', md5(text) FROM t
UNION ALL SELECT doc_id, label, 'aug_crop', md5(CASE WHEN len(tok) > sc THEN array_to_string(tok[h % (len(tok) - sc + 1) + 1 : h % (len(tok) - sc + 1) + sc], ' ') ELSE text END) FROM t""")
def length_adapt_recipes(spark, sf):
    """Training rows of the crop recipes: replace, and augment at a seeded mixture of lengths."""
    t = C.labelled(spark, sf).select("doc_id", "label", "text", X.tok_ws(F.col("text")).alias("tok"))
    scales = F.array(*[F.lit(s) for s in K.CROP_SCALES])
    t = t.withColumn("sc", F.get(scales, F.pmod(X.hash_int(5, F.col("doc_id")), F.lit(3)).cast("int")))
    row = lambda name, text: F.struct(F.lit(name).alias("recipe"), text.alias("t"))
    crop = lambda n: X.crop_random(F.col("text"), F.col("tok"), F.col("doc_id"), n)
    rows = F.array(row("crop_replace", crop(K.CROP)), row("aug_full", F.col("text")), row("aug_crop", crop(F.col("sc"))))
    return t.select("doc_id", "label", F.explode(rows).alias("c")).select("doc_id", "label", "c.recipe", F.md5("c.t").alias("text_md5"))


@query("external_union", f"""WITH {U.CORPUS} SELECT 'own' AS origin, label, 1.0::DOUBLE AS weight, md5(text) AS text_md5 FROM corpus WHERE label IS NOT NULL
UNION ALL SELECT 'external', 0, 0.3::DOUBLE, md5(text) FROM benchmark""")
def external_union(spark, sf):
    """Own labelled rows at weight 1 and a second corpus at a smaller weight."""
    own = C.labelled(spark, sf).select(F.lit("own").alias("origin"), "label", F.lit(1.0).alias("weight"), F.md5("text").alias("text_md5"))
    ext = C.table(spark, sf, "benchmark").select(
        F.lit("external").alias("origin"), F.lit(0).alias("label"), F.lit(0.3).alias("weight"), F.md5("text").alias("text_md5"))
    return own.unionByName(ext)


# --- experiment tables -------------------------------------------------------------------------

CANDS = {"base": ("p_a >= 0.5", lambda: F.col("p_a") >= 0.5),
         "len": ("p_b >= 0.5", lambda: F.col("p_b") >= 0.5),
         "low": ("p_a >= 0.35", lambda: F.col("p_a") >= 0.35),
         "mix": ("round(0.5 * p_a + 0.5 * p_b, 9) >= 0.45", lambda: F.round(0.5 * F.col("p_a") + 0.5 * F.col("p_b"), 9) >= 0.45)}
LENSED = f"""{PRED}, qt AS (SELECT doc_id, row_number() OVER (ORDER BY p_b, doc_id) - 1 AS rk, count(*) OVER () AS n FROM scored),
s2 AS (SELECT source AS cluster, count(*) AS n FROM corpus GROUP BY source),
rr AS (SELECT cluster, ((row_number() OVER (ORDER BY n DESC, cluster) - 1) % 5)::INT AS fold FROM s2),
lensed AS (SELECT 'strat' AS lens, fold, p_a, p_b, y FROM folded
 UNION ALL SELECT 'quint', (((rk + 1) * 5 - 1) // n)::INT, p_a, p_b, y FROM scored JOIN qt USING (doc_id)
 UNION ALL SELECT 'topic', rr.fold, p_a, p_b, y FROM scored JOIN corpus c USING (doc_id) JOIN rr ON rr.cluster = c.source),
cp AS ({' UNION ALL '.join(f"SELECT lens, fold, '{k}' AS cand, y, ({v[0]})::INT AS pred FROM lensed" for k, v in CANDS.items())}),
res AS (SELECT lens, fold, cand, {U.f1_sql()} AS f1 FROM cp GROUP BY ALL),
dl AS (SELECT a.cand, a.lens, a.fold, a.f1 - b.f1 AS delta FROM res a JOIN res b USING (lens, fold) WHERE b.cand = 'base' AND a.cand <> 'base'),
ld AS (SELECT cand, lens, avg(delta) AS mean_delta, min(delta) AS worst, sum((delta > 0)::INT)::BIGINT AS folds_won, count(*) AS n_folds FROM dl GROUP BY ALL),
gt AS (SELECT cand, min(mean_delta) AS min_delta, min(worst) AS worst, sum((mean_delta > 0)::INT)::BIGINT AS lenses_won, (min(mean_delta) > 0)::INT AS passed FROM ld GROUP BY cand)"""


def results(spark, sf):
    """Macro-F1 of four decision rules on every fold of three lenses."""
    base = cut_lineage(U.folded(spark, sf))
    groups = cut_lineage(clusters(spark, sf))
    topic = Z.assign(groups, Z.round_robin(Z.cluster_sizes(groups))).select("doc_id", F.col("fold").alias("topic"))
    q = ranks.quintiles(base.select("doc_id", "p_b"), "p_b").select("doc_id", F.col("fold").alias("quint"))
    wide = base.join(topic, "doc_id").join(q, "doc_id")
    lens = F.array(*[F.struct(F.lit(n).alias("lens"), F.col(c).alias("fold")) for n, c in
                     (("strat", "fold"), ("quint", "quint"), ("topic", "topic"))])
    cand = F.array(*[F.struct(F.lit(k).alias("cand"), v[1]().cast("int").alias("pred")) for k, v in CANDS.items()])
    rows = wide.select("y", F.explode(lens).alias("l"), cand.alias("cs")).select(
        "y", "l.lens", "l.fold", F.explode("cs").alias("c")).select("lens", "fold", "c.cand", "y", "c.pred")
    # at most lenses x folds x candidates rows, which the summaries below read several times
    return cut_lineage(E.results(rows))


@query("fold_results", f"WITH {LENSED} SELECT lens, fold, cand, {r('f1', 'f1')} FROM res")
def fold_results(spark, sf):
    return results(spark, sf)


@query("fold_summary", f"WITH {LENSED} SELECT lens, cand, {r('avg(f1)', 'mean')}, {r('stddev_pop(f1)', 'std')}, {r('min(f1)', 'worst')}, {r('max(f1)', 'best')} FROM res GROUP BY ALL")
def fold_summary(spark, sf):
    return E.fold_summary(results(spark, sf))


@query("lens_delta", f"WITH {LENSED} SELECT cand, lens, {r('mean_delta', 'mean_delta')}, {r('worst', 'worst')}, folds_won, n_folds FROM ld")
def lens_delta(spark, sf):
    return E.lens_delta(results(spark, sf))


@query("gate", f"WITH {LENSED} SELECT cand, {r('min_delta', 'min_delta')}, {r('worst', 'worst')}, lenses_won, passed FROM gt")
def gate(spark, sf):
    return E.gate(E.lens_delta(results(spark, sf)))


@query("gate_two_lens", f"""WITH {LENSED} SELECT cand, {r('min(mean_delta)', 'min_delta')}, {r('min(worst)', 'worst')},
sum((mean_delta > 0)::INT)::BIGINT AS lenses_won, min(CASE WHEN lens <> 'quint' THEN (round(mean_delta, 9) > 0 AND folds_won >= 4)::INT
ELSE (round(mean_delta, 9) >= -0.005)::INT END) AS passed FROM ld GROUP BY cand""")
def gate_two_lens(spark, sf):
    """Gain and four folds on two lenses, bounded loss on the third."""
    return E.gate(E.lens_delta(results(spark, sf)), "two_lens", "quint")


@query("additivity", f"""WITH {LENSED}, p AS (SELECT lens, max(mean_delta) FILTER (cand = 'mix') AS j,
 max(mean_delta) FILTER (cand = 'len') + max(mean_delta) FILTER (cand = 'low') AS s FROM ld GROUP BY lens)
SELECT lens, {r('j', 'joint')}, {r('s', 'summed')}, {r('j - s', 'surplus')} FROM p""")
def additivity(spark, sf):
    return E.additivity(E.lens_delta(results(spark, sf)), "len", "low", "mix")


@query("race_summary", f"WITH {LENSED} SELECT cand, {r('avg(f1)', 'f1')} FROM res GROUP BY cand")
def race_summary(spark, sf):
    return E.race_summary(results(spark, sf))


@query("rank_candidates", f"""WITH {LENSED} SELECT cand, passed, row_number() OVER (ORDER BY passed DESC, round(min_delta, 9) DESC,
 round(worst, 9) DESC, cand)::INT AS rank FROM gt""")
def rank_candidates(spark, sf):
    return E.rank_candidates(E.gate(E.lens_delta(results(spark, sf))))


@query("screen_then_full", f"""WITH {LENSED}, s AS (SELECT cand, avg(f1) AS screen_f1 FROM res WHERE fold IN (0, 1) GROUP BY cand),
b AS (SELECT * FROM s ORDER BY round(screen_f1, 9) DESC, cand LIMIT 2)
SELECT cand, {r('avg(f1)', 'full_f1')}, {r('max(screen_f1)', 'screen_f1')} FROM res JOIN b USING (cand) GROUP BY cand""")
def screen_then_full(spark, sf):
    """Two folds decide which two candidates get the full evaluation."""
    return E.screen(results(spark, sf))


@query("repro_gate", f"""WITH {LENSED}, m AS (SELECT cand AS name, round(avg(f1), 6) AS value FROM res WHERE cand IN ('base', 'len') GROUP BY cand)
SELECT name, value, value AS anchor, 1 AS ok FROM m""")
def repro_gate(spark, sf):
    """A second run measured against the written means of a first one; the gate raises where they differ."""
    def means():
        return results(spark, sf).where(F.col("cand").isin("base", "len")).groupBy(F.col("cand").alias("name")).agg(
            F.round(F.avg("f1"), 6).alias("value"))

    anchors = cut_lineage(means().withColumnRenamed("value", "anchor"))
    report = cut_lineage(E.repro_report(means(), anchors, 0.003))
    for x in report.collect():  # two rows
        E.repro_gate(x["value"], x["anchor"], 0.003)
    return report


_SEEDS = [1, 2, 3, 4, 5]


@query("multi_seed", f"""WITH {U.LEGS}, sd AS (SELECT unnest({_SEEDS}) AS seed),
t AS (SELECT seed, doc_id, y, p_a, row_number() OVER (PARTITION BY seed, y ORDER BY md5(seed || ':' || doc_id), doc_id) - 1 AS rk,
 count(*) OVER (PARTITION BY seed, y) AS n FROM scored, sd),
v AS (SELECT seed, y, (p_a >= 0.5)::INT AS pred FROM t WHERE rk < round_even(n * 0.1, 0)),
f AS (SELECT seed, {U.f1_sql()} AS f FROM v GROUP BY seed)
SELECT count(*) AS n_seeds, {r('avg(f)', 'mean')}, {r('max(f) - min(f)', 'spread')}, {r('stddev_pop(f)', 'std')} FROM f""")
def multi_seed(spark, sf):
    """Five seeded holdouts in one pass: the seed is a column of the split."""
    s = U.scored(spark, sf).select("doc_id", "y", "p_a")
    s = U.stored(s.withColumn("seed", F.explode(F.array(*[F.lit(k) for k in _SEEDS]))))
    v = ranks.seeded_holdouts(s, "seed", "y").where("split = 'val'")
    f = M.macro_f1(v.withColumn("pred", (F.col("p_a") >= 0.5).cast("int")), by=["seed"])
    return f.agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("macro_f1").alias("mean"),
                 (F.max("macro_f1") - F.min("macro_f1")).alias("spread"), F.stddev_pop("macro_f1").alias("std"))
