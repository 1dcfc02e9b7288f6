"""Iterative fits and the loops around them (row checks), with their relational parts (SQL checks)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import style as S
from ..functions import text as X
from ..operators import adapt as A
from ..operators import ensemble as N
from ..operators import experiments as E
from ..operators import lenses as Z
from ..operators import linear as L
from ..operators import metrics as M
from ..operators import lsh as LS
from ..operators import neighbors as NN
from ..operators import profile as P
from ..operators import projection as PR
from ..operators import ranks
from ..operators import search as SE
from ..operators import shift as H
from ..operators import terms as T
from ..operators import trees as R
from ..operators.cache import cached
from ..operators import bayes as B
from ..session import cut_lineage, together, with_stats
from ..sources import corpus as C
from . import common as U
from .evaluation import clusters
from .registry import query, r
from .styles import LONG14
from .text import SLIDE, WORD_TFIDF


def light(spark, sf, fit_on="label IS NOT NULL", weight=None):
    """Word TF-IDF vectors of every document, fitted on the labelled text: doc_id, label, features; ``weight``
    (doc_id, w) is joined before the vectors are made."""
    d = C.corpus(spark, sf)
    tr = d.where(fit_on)
    vocab = L.indexed(T.fit_vocab(T.word_terms(tr), tr))
    rows = d.select("doc_id", "label")
    if weight is not None:
        rows = rows.join(weight.withColumnRenamed("w", "weight"), "doc_id", "left")
    return L.vectors(rows, T.weigh(T.word_terms(d), vocab), vocab)


def split_vectors(spark, sf, k=5):
    """Labelled vectors with a stratified fold, dealt before the vectors are made, so these are written once."""
    tr = C.labelled(spark, sf)
    vocab = L.indexed(T.fit_vocab(T.word_terms(tr), tr))
    folds = cut_lineage(ranks.stratified_kfold(cut_lineage(tr.select("doc_id", "label")), k=k))
    return L.vectors(folds, T.weigh(T.word_terms(tr), vocab), vocab)


#: Components of an LSA space, as in the reference's stacks and its label spreading.
COMPONENTS = 200


def labelled_style(spark, sf):
    """Vectors of the 18 style columns with a holdout split."""
    s = S.style18(C.labelled(spark, sf), keep=("doc_id", "label"))
    return cut_lineage(ranks.stratified_holdout(L.dense_vectors(s, K.STYLE18).select("doc_id", "label", "features")))


# --- relational parts with exact SQL -------------------------------------------------------

R_SQL = f"""{WORD_TFIDF}, pq AS (SELECT term, 1.0 + coalesce(sum(value) FILTER (label = 1), 0) AS p,
 1.0 + coalesce(sum(value) FILTER (label = 0), 0) AS q FROM tfidf WHERE label IS NOT NULL GROUP BY term),
coef AS (SELECT term, ln((p / sum(p) OVER ()) / (q / sum(q) OVER ())) AS w FROM pq)"""


def ratio_parts(spark, sf):
    d, tr = C.documents(spark, sf), C.labelled(spark, sf)
    v = T.fit_vocab(T.word_terms(tr), tr)
    long = T.weigh(T.word_terms(d), v)
    lab = T.weigh(T.word_terms(tr), v).join(tr.select("doc_id", "label"), "doc_id")
    return long, lab, B.log_ratio(lab)


@query("linear_score", f"WITH {R_SQL} SELECT doc_id, {r('sum(value * w) - 0.1', 'margin')}, (round(sum(value * w) - 0.1, 6) > 0)::INT AS label FROM tfidf JOIN coef USING (term) GROUP BY doc_id")
def linear_score(spark, sf):
    """X.w + b with the log-ratio table as coefficients."""
    long, _, ratio = ratio_parts(spark, sf)
    m = L.linear_score(long, ratio.withColumnRenamed("r", "w"), -0.1)
    return m.withColumn("label", (F.round("margin", 6) > 0).cast("int"))


@query("logreg_gradient", f"""WITH {R_SQL}, m AS (SELECT doc_id, label, sum(value * w) AS m FROM tfidf JOIN coef USING (term) WHERE label IS NOT NULL GROUP BY ALL),
e AS (SELECT c.doc_id, 1 / (1 + exp(-coalesce(m, 0))) - c.label AS e FROM corpus c LEFT JOIN m USING (doc_id) WHERE c.label IS NOT NULL)
SELECT term, {r('sum(value * e) / (SELECT count(*) FROM e) + 0.01 * max(w)', 'grad')} FROM tfidf JOIN e USING (doc_id) JOIN coef USING (term) GROUP BY term""")
def logreg_gradient(spark, sf):
    _, lab, ratio = ratio_parts(spark, sf)
    labels = C.labelled(spark, sf).select("doc_id", "label")
    return L.logreg_gradient(lab.drop("label"), labels, ratio.withColumnRenamed("r", "w"), 0.01).select("term", "grad")


@query("nbsvm_scale", f"WITH {R_SQL} SELECT doc_id, count(*) AS n_terms, {r('sum(value * w)', 'total')}, {r('sum(abs(value * w))', 'mass')} FROM tfidf JOIN coef USING (term) GROUP BY doc_id")
def nbsvm_scale(spark, sf):
    """TF-IDF rows scaled by the NB log-ratio (the input of the NB-SVM fit)."""
    long, _, ratio = ratio_parts(spark, sf)
    v = T.lookup(long, ratio).select("doc_id", (F.col("value") * F.col("r")).alias("v"))
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("v").alias("total"), F.sum(F.abs("v")).alias("mass"))


@query("gbt_gradients", f"""WITH {U.LEGS}, pr AS (SELECT avg(y) AS p FROM scored),
g AS (SELECT (m_a > -0.5)::INT AS leaf, 1 / (1 + exp(-(ln(p / (1 - p)) + 0.1 * m_b))) AS q, y FROM scored, pr)
SELECT leaf, count(*) AS n, {r('sum(q - y)', 'G')}, {r('sum(q * (1 - q))', 'H')}, {r('-sum(q - y) / (sum(q * (1 - q)) + 1)', 'value')} FROM g GROUP BY leaf""")
def gbt_gradients(spark, sf):
    """Gradients at the prior's log-odds plus one step, and Newton values of two leaves."""
    s = U.scored(spark, sf)
    p = s.agg(F.avg("y").alias("p"))
    f = with_stats(s, p).withColumn("f", F.log(F.col("p") / (1 - F.col("p"))) + 0.1 * F.col("m_b"))
    g = R.gradients(f, "y", "f").withColumn("leaf", (F.col("m_a") > -0.5).cast("int"))
    return R.leaf_values(g)


@query("split_gain", f"""WITH {LONG14}, pr AS (SELECT avg(label) AS p FROM lf),
v AS (SELECT feature, value, sum(p - label) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM lf, pr GROUP BY ALL),
c AS (SELECT feature, value, lead(value) OVER w AS nxt, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
 sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht, sum(n) OVER (PARTITION BY feature) AS nt
 FROM v WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
s AS (SELECT feature, round(gl * gl / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt * gt / (ht + 1), 6) AS gain, (value + nxt) / 2 AS threshold, nl
 FROM c WHERE nxt IS NOT NULL AND nl >= 20 AND nt - nl >= 20)
SELECT feature, gain, {r('threshold', 'threshold')}, nl::BIGINT AS n_left FROM s WHERE gain > 0
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, threshold) = 1""")
def split_gain(spark, sf):
    """Best second-order split of each of the 14 style columns."""
    lab = P.melt(S.style14(C.labelled(spark, sf), keep=("doc_id", "label")), K.STYLE14, ("doc_id", "label"))
    g = with_stats(lab, C.table(spark, sf, "labels").agg(F.avg("quality").alias("p")))
    g = g.select("feature", "value", (F.col("p") - F.col("label")).alias("g"), (F.col("p") * (1 - F.col("p"))).alias("h"))
    return R.split_gain(g)


@query("split_gain_hist", f"""WITH {LONG14}, pr AS (SELECT avg(label) AS p FROM lf),
rg AS (SELECT feature, min(value) AS a, max(value) AS b FROM lf GROUP BY feature),
bn AS (SELECT feature, value, label, len(list_filter(range(1, 32), lambda i: a + (b - a) * i / 32.0::DOUBLE <= value)) AS bin FROM lf JOIN rg USING (feature)),
v AS (SELECT feature, bin, sum(p - label) AS g, sum(p * (1 - p)) AS h, count(*) AS n, min(value) AS lo, max(value) AS hi FROM bn, pr GROUP BY ALL),
c AS (SELECT feature, hi, lead(lo) OVER w AS nxt, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
 sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht, sum(n) OVER (PARTITION BY feature) AS nt
 FROM v WINDOW w AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
s AS (SELECT feature, round(gl * gl / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt * gt / (ht + 1), 6) AS gain, (hi + nxt) / 2 AS threshold, nl
 FROM c WHERE nxt IS NOT NULL AND nl >= 20 AND nt - nl >= 20)
SELECT feature, gain, {r('threshold', 'threshold')}, nl::BIGINT AS n_left FROM s WHERE gain > 0
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, threshold) = 1""")
def split_gain_hist(spark, sf):
    """Best split of each of the 14 style columns at the borders of 32 bins of equal width."""
    lab = cut_lineage(P.melt(S.style14(C.labelled(spark, sf), keep=("doc_id", "label")), K.STYLE14, ("doc_id", "label")))
    g = with_stats(lab, C.table(spark, sf, "labels").agg(F.avg("quality").alias("p")))
    g = g.select("feature", "value", (F.col("p") - F.col("label")).alias("g"), (F.col("p") * (1 - F.col("p"))).alias("h"))
    rg = lab.groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    at = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / F.lit(32.0))
    return R.split_gain_hist(g, rg.select("feature", at.alias("cuts")), bins=32)


# --- neighbours and centres -------------------------------------------------------------------

E_SPLIT = """e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label FROM embeddings),
s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM e),
qs AS (SELECT * FROM s WHERE rk < round_even(n * 0.1, 0)), bs AS (SELECT * FROM s WHERE rk >= round_even(n * 0.1, 0)),
pd AS (SELECT q.id AS query, b.id AS neighbor, b.label, list_distance(q.x, b.x) AS dist FROM qs q, bs b),
nn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), neighbor) AS rank FROM pd QUALIFY rank <= 2)"""


def embedded(spark, sf):
    e = C.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")
    return ranks.stratified_holdout(e, key="id")


def knn2(spark, sf):
    e = cut_lineage(embedded(spark, sf))
    return NN.knn_join(e.where("split = 'val'").select("id", "x"), e.where("split = 'train'").select("id", "x"), 2), e


@query("knn_join", f"WITH {E_SPLIT} SELECT query, neighbor, rank::INT AS rank, {r('dist', 'dist')} FROM nn")
def knn_join(spark, sf):
    """Two nearest training vectors of every held-out vector, exactly."""
    return knn2(spark, sf)[0]


@query("knn_classify", f"""WITH {E_SPLIT}, v AS (SELECT query, label, count(*) AS n FROM nn GROUP BY ALL)
SELECT query, label, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1""")
def knn_classify(spark, sf):
    nn, e = knn2(spark, sf)
    return NN.vote(nn, e.select("id", "label"))


@query("knn_graph", f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
pd AS (SELECT a.id AS query, b.id AS neighbor, list_distance(a.x, b.x) AS dist FROM e a, e b),
nn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), neighbor) AS rank FROM pd QUALIFY rank <= 7)
SELECT query, neighbor, rank::INT AS rank, {r('dist', 'dist')} FROM nn""")
def knn_graph(spark, sf):
    """Seven-neighbour graph over all vectors (a vector is its own first neighbour)."""
    e = embedded(spark, sf).select("id", "x")
    return NN.knn_join(e, e, 7)


CENTRES = """e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
c0 AS (SELECT label AS cluster, i, avg(v) AS m FROM (SELECT label, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM e) GROUP BY ALL),
ct AS (SELECT cluster, list(m ORDER BY i) AS centre FROM c0 GROUP BY cluster)"""


@query("kmeans_assign", f"""WITH {CENTRES}, d AS (SELECT id, cluster, round(list_distance(x, centre), 9) AS dist FROM e, ct)
SELECT id, cluster, {r('dist', 'dist')} FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, cluster) = 1""")
def kmeans_assign(spark, sf):
    """Nearest of the ten class means, compared inside each row."""
    e = embedded(spark, sf).select("id", "x", "label")
    cells = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    ct = cells.groupBy(F.col("label").alias("cluster")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    return NN.nearest_centre(e, ct)


@query("knn_join_lsh")
def knn_join_lsh(spark, sf):
    """Two near training vectors of every held-out vector, by random-projection buckets and exact re-rank."""
    e = cut_lineage(embedded(spark, sf))
    return LS.knn_lsh(e.where("split = 'val'").select("id", "x"), e.where("split = 'train'").select("id", "x"), 2)


@query("knn_graph_lsh")
def knn_graph_lsh(spark, sf):
    """Near-neighbour graph (seven each, itself included) over all vectors."""
    e = embedded(spark, sf).select("id", "x")
    return LS.knn_lsh(e, e, 7)


@query("knn_classify_lsh")
def knn_classify_lsh(spark, sf):
    """Majority label of the two near training vectors of every held-out vector."""
    e = cut_lineage(embedded(spark, sf))
    nn = LS.knn_lsh(e.where("split = 'val'").select("id", "x"), e.where("split = 'train'").select("id", "x"), 2)
    return NN.vote(nn, e.select("id", "label"))


def text_space(spark, sf, k=COMPONENTS):
    """Every document in the LSA space of the labelled ones' words and character n-grams: (doc_id, x), and the model."""
    d = C.corpus(spark, sf)
    blocks = lambda x: T.stack_blocks(T.word_terms(x, 1, 2), T.char_wb_terms(x, 3, 4))
    terms = cut_lineage(blocks(d))
    tr = cut_lineage(d.where("label IS NOT NULL").select("doc_id"))
    vocab = L.indexed(T.fit_vocab(terms.join(tr, "doc_id", "left_semi"), tr))
    long = cut_lineage(T.weigh(terms, vocab))
    model, _ = PR.fit_lsa(long.join(tr, "doc_id", "left_semi"), k, vocab)
    return cut_lineage(model.project(long, d)), model


@query("label_spread")
def label_spread(spark, sf):
    """Labels of the labelled documents spread over the seven-neighbour graph of all documents (labelled, pool and
    evaluation rows alike) in the LSA space of their fused text; half of the labels are hidden and scored."""
    x = text_space(spark, sf)[0].withColumnRenamed("doc_id", "id")
    known = cut_lineage(ranks.pool_eval_split(C.labelled(spark, sf).select(F.col("doc_id").alias("id"), "label"), key="id"))
    seeds = x.select("id").join(known, "id", "left").select("id", F.when(F.col("part") == "pool", F.col("label")).alias("label"))
    edges = LS.knn_lsh(x, x, 7)
    return NN.label_spread(edges, seeds)


@query("pca")
def pca(spark, sf):
    """Scores of all vectors on principal components of the training side, at four sizes."""
    e = cut_lineage(embedded(spark, sf))
    parts = []
    for k in (8, 16, 32, 64):
        project, _ = PR.fit_pca(e.where("split = 'train'"), k)
        parts.append(project(e.select("id", "split", "x")).withColumn("k", F.lit(k)))
    return T.stack_blocks(*parts)


@query("explained_variance")
def explained_variance(spark, sf):
    """Variance share per component (at most k numbers) with its running sum, fitted on the training side."""
    _, model = PR.fit_pca(embedded(spark, sf).where("split = 'train'"), 32)
    total, rows = 0.0, []
    for i, v in enumerate(model.explainedVariance.toArray()):
        total += float(v)
        rows.append((i + 1, float(v), total))
    return spark.createDataFrame(rows, "component int, variance double, cumulative double")


@query("svd_lsa")
def svd_lsa(spark, sf):
    """All documents in the LSA space of the labelled ones, 200 components or as many as there are: the fit sees no other row."""
    d = C.corpus(spark, sf)
    tr = d.where("label IS NOT NULL")
    vocab = L.indexed(T.fit_vocab(T.word_terms(tr), tr))
    long = cut_lineage(T.weigh(T.word_terms(d), vocab))
    model, _ = PR.fit_lsa(long.join(tr.select("doc_id"), "doc_id", "left_semi"), COMPONENTS, vocab)
    return model.project(long, d)


@query("pca_knn")
def pca_knn(spark, sf):
    """Two-neighbour vote after a projection fitted on the training side."""
    e = cut_lineage(embedded(spark, sf))
    project, _ = PR.fit_pca(e.where("split = 'train'"), 16)
    z = cut_lineage(project(e.select("id", "label", "split", "x")))
    nn = NN.knn_join(z.where("split = 'val'").select("id", "x"), z.where("split = 'train'").select("id", "x"), 2)
    return NN.vote(nn, z.select("id", "label"))


# --- fits -----------------------------------------------------------------------------------

def _fit_query(name, kind, **kw):
    @query(name)
    def run(spark, sf):
        v = light(spark, sf)
        m = L.fit(kind, v.where("label IS NOT NULL"), **kw)
        s = m.score(v.where("label IS NULL"))
        return s.select("doc_id", "margin", (F.col("margin") > 0).cast("int").alias("label"))

    run.__doc__ = f"{kind} fit on the labelled vectors, scores of the target."


_fit_query("logreg", "logreg", C=1.0)
_fit_query("linear_svm", "svm", C=0.25)
_fit_query("ridge_clf", "ridge", alpha=0.9)


@query("ridge_cv_meta", f"""WITH {U.LEGS}, {U.FOLDS}, hs AS (SELECT unnest(range(5))::INT AS held),
al AS (SELECT pow(10.0, -2 + 5 * i / 11.0) AS alpha FROM (SELECT unnest(range(12)) AS i)),
cl AS (SELECT held, y, count(*) AS c FROM folded, hs WHERE fold <> held GROUP BY ALL),
wt AS (SELECT held, y, sum(c) OVER (PARTITION BY held) / (2.0 * c) AS w FROM cl),
tr AS (SELECT held, m_a, m_b, 2 * f.y - 1 AS t, w FROM folded f JOIN wt ON f.y = wt.y AND fold <> held),
mo AS (SELECT held, sum(w * m_a) / sum(w) AS a, sum(w * m_b) / sum(w) AS b, sum(w * t) / sum(w) AS tm FROM tr GROUP BY held),
ce AS (SELECT held, a, b, tm, sum(w * (m_a - a) * (m_a - a)) AS aa, sum(w * (m_a - a) * (m_b - b)) AS ab, sum(w * (m_b - b) * (m_b - b)) AS bb,
 sum(w * (m_a - a) * (t - tm)) AS yat, sum(w * (m_b - b) * (t - tm)) AS ybt FROM tr JOIN mo USING (held) GROUP BY ALL),
co AS (SELECT held, alpha, a, b, tm, ((bb + alpha) * yat - ab * ybt) / ((aa + alpha) * (bb + alpha) - ab * ab) AS ca,
 ((aa + alpha) * ybt - ab * yat) / ((aa + alpha) * (bb + alpha) - ab * ab) AS cb FROM ce, al),
pr AS (SELECT alpha, y, (tm + ca * (m_a - a) + cb * (m_b - b) > 0)::INT AS pred FROM folded JOIN co ON fold = held),
f1 AS (SELECT alpha, {U.f1_sql()} AS f FROM pr GROUP BY alpha)
SELECT {r('alpha', 'alpha')}, {r('f', 'macro_f1')}, (row_number() OVER (ORDER BY round(f, 9) DESC, alpha) = 1)::INT AS best FROM f1""")
def ridge_cv_meta(spark, sf):
    """Macro-F1 of ridge over twelve penalties, out of fold; the best one (the smallest on ties) marked."""
    s = L.ridge_path(cut_lineage(U.folded(spark, sf)), ["m_a", "m_b"], [10 ** (-2 + 5 * i / 11) for i in range(12)])
    f = M.macro_f1(s.withColumn("pred", (F.col("margin") > 0).cast("int")), by=["alpha"]).select("alpha", "macro_f1")
    best = f.agg(F.max(F.struct(F.round("macro_f1", 9).alias("f"), (-F.col("alpha")).alias("a"))).alias("b")).select((-F.col("b.a")).alias("_best"))
    return with_stats(f, best).select("alpha", "macro_f1", (F.col("alpha") == F.col("_best")).cast("int").alias("best"))


@query("nbsvm")
def nbsvm(spark, sf):
    """Linear fit on log-ratio scaled vectors, weights interpolated with their mean size."""
    long, lab, ratio = ratio_parts(spark, sf)
    train = C.labelled(spark, sf).select("doc_id", "label")
    _, score = L.nbsvm(lab.drop("label"), ratio, train, share=0.25)
    s = score(long).join(C.target(spark, sf).select("doc_id"), "doc_id", "left_semi")
    return s.withColumn("label", (F.col("margin") > 0).cast("int"))


def _tree_query(name, kind, **params):
    @query(name)
    def run(spark, sf):
        s = labelled_style(spark, sf)
        score = R.fit_trees(kind, s.where("split = 'train'"), **params)
        return score(s.where("split = 'val'")).select("doc_id", "label", "p")


_tree_query("random_forest", "forest", numTrees=100, maxDepth=8, featureSubsetStrategy="sqrt")
_tree_query("gbt", "boost", maxIter=20, maxDepth=3, stepSize=0.1)


@query("tree_calib")
def tree_calib(spark, sf):
    """Depth-3 tree on out-of-fold margin and log length, itself scored on folds it has not seen."""
    v = split_vectors(spark, sf)
    s = L.oof(v, lambda t: L.fit("ridge", t)).select("doc_id", "label", "fold", "margin")
    n = C.labelled(spark, sf).select("doc_id", F.log1p(F.length("text").cast("double")).alias("log_chars"))
    d = cut_lineage(L.dense_vectors(s.join(n, "doc_id"), ["margin", "log_chars"]))
    return L.oof(d, lambda t: R.Trees("tree", t, maxDepth=3)).select("doc_id", "label", "p")


@query("calibrate_sigmoid")
def calibrate_sigmoid(spark, sf):
    """Platt scaling of out-of-fold SVM margins, each row scaled by a fit on the other folds."""
    v = split_vectors(spark, sf)
    s = cut_lineage(L.oof(v, lambda t: L.fit("svm", t)).select("doc_id", "label", "fold", "margin"))
    d = L.dense_vectors(s, ["margin"]).select("doc_id", "label", "fold", "features")
    return L.oof(d, lambda t: L.fit("logreg", t, balanced=False, C=1e6)).select("doc_id", "label", "p")


@query("calibrate_cv")
def calibrate_cv(spark, sf):
    """Weighted sigmoid calibration over three folds of an SVM: the mean probability of every unlabelled document."""
    v = light(spark, sf)
    train = cut_lineage(ranks.stratified_kfold(v.where("label IS NOT NULL"), k=3).withColumn("w", F.lit(1.0) + F.col("label")))
    model = L.calibrated_cv(train, lambda t: L.fit("svm", t, weight="w"), weight="w")
    return model.score(v.where("label IS NULL").select("doc_id", "features")).select("doc_id", "p")


@query("oof_scores")
def oof_scores(spark, sf):
    """One out-of-fold margin per labelled document."""
    return L.oof(split_vectors(spark, sf), lambda t: L.fit("logreg", t)).select("doc_id", "label", "fold", "margin", "p")


LEGS = ("ridge", "logreg", "svm")


def leg_scores(train, held):
    """Margins of the linear legs, a column each, for the rows of ``held``: vocabulary, IDF and fits see ``train`` alone."""
    vocab = L.indexed(T.fit_vocab(T.word_terms(train), train))
    side = lambda rows, seen: rows.withColumn("_held", F.lit(not seen))
    both = side(train, True).unionByName(side(held, False))
    v = L.vectors(both.drop("text"), T.weigh(T.word_terms(both), vocab), vocab)
    fit_on, out = v.where("NOT _held"), v.where("_held").drop("_held")
    for kind, m in zip(LEGS, together([lambda kind=kind: L.fit(kind, fit_on) for kind in LEGS], L.fits_at_once(v))):
        out = m.score(out).withColumnRenamed("margin", kind).drop("p")
    return out.drop("features")


def fold_legs(rows, k=3):
    """Out-of-fold legs of text rows with a ``fold``: what a row is scored by was fitted on the other folds alone."""
    return T.stack_blocks(*[leg_scores(rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)) for i in range(k)])


def dealt(rows, seed=42):
    """Text rows (doc_id, label, text) with three stratified folds, written once."""
    return cut_lineage(ranks.stratified_kfold(cut_lineage(rows.select("doc_id", "label", "text")), k=3, seed=seed))


def oof_legs(spark, sf):
    """Out-of-fold margins (three folds) of three linear models, one column each."""
    return cut_lineage(fold_legs(dealt(C.labelled(spark, sf))).select("doc_id", "label", "fold", *LEGS))


def all_legs(spark, sf):
    """What a search over stacks needs of the legs, as ``part``: "oof", the labelled rows out of fold; "inner", for each
    outer fold the rows of the others out of inner folds; "test", the target documents under fits on all labelled rows.
    ``outer`` is the outer fold that an inner row's fits leave out, ``fold`` the one that a row is scored in."""
    lab = C.labelled(spark, sf)
    none = F.lit(None).cast("int")
    named = lambda rows, part, outer=none: rows.select(F.lit(part).alias("part"), outer.alias("outer"), "doc_id", "label", "fold", *LEGS)
    parts = [named(oof_legs(spark, sf), "oof")]
    outer = dealt(lab)
    for i in range(3):
        parts.append(named(fold_legs(dealt(outer.where(F.col("fold") != i), seed=1)), "inner", F.lit(i)))
    target = C.target(spark, sf).select("doc_id", none.alias("label"), "text", none.alias("fold"))
    parts.append(named(leg_scores(lab.select("doc_id", "label", "text", none.alias("fold")), target), "test"))
    return T.stack_blocks(*parts)


@query("cache_oof")
def cache_oof(spark, sf):
    """Out-of-fold, inner out-of-fold and target scores of the legs, fitted once for these rows and found again by every later search."""
    rows = C.corpus(spark, sf).select("doc_id", "text", "label")
    return cached(spark, "oof-legs", {"corpus": rows}, {"legs": list(LEGS), "folds": 3, "inner": 3, "test": True, "vocabulary": "of the training side"}, lambda: all_legs(spark, sf))


@query("greedy_diverse_models")
def greedy_diverse_models(spark, sf):
    """Best leg first, then the largest F1 minus correlation with those picked."""
    o = oof_legs(spark, sf)
    q = P.melt(o, ["ridge", "logreg", "svm"], ("doc_id", "label")).withColumn("pred", (F.col("value") > 0).cast("int"))
    f1 = M.macro_f1(q, "label", "pred", ["feature"]).select(F.col("feature").alias("model"), F.col("macro_f1").alias("f1"))
    return P.greedy_diverse(f1, P.pairwise_corr(o, ["ridge", "logreg", "svm"]))


@query("stack_meta")
def stack_meta(spark, sf):
    """Nested stacking: three linear legs under logistic, ridge (best of twelve penalties) and boosted meta
    models; legs, scaling and meta models never see the fold they are scored on."""
    legs = ["ridge", "logreg", "svm"]
    metas = {"logistic": lambda t: L.fit("logreg", t),
             "ridge_cv": lambda t: A.best_ridge(t, legs, [10 ** (-2 + 5 * i / 11) for i in range(12)]),
             "boosted": lambda t: R.Trees("boost", t, maxIter=20, maxDepth=2, stepSize=0.1)}
    v = split_vectors(spark, sf, k=3)
    s = A.nested_stack(v, legs, metas)
    cut = F.when(F.col("meta") == "ridge_cv", 0.0).otherwise(0.5)
    return s.withColumn("pred", (F.col("score") > cut).cast("int"))


def _normal_sql(seed):
    h = f"md5('{seed}:' || doc_id)"
    u = [f"((('0x' || substr({h}, {at}, 12))::BIGINT + 0.5) / 281474976710656.0)" for at in (1, 13)]
    return f"sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]})"


@query("noise_inject", f"""WITH {U.LEGS}, sd AS (SELECT stddev_pop(m_a) AS sa, stddev_pop(m_b) AS sb FROM scored)
SELECT doc_id, {r(f'm_a + 0.05 * sa * {_normal_sql(42)}', 'm_a')}, {r(f'm_b + 0.05 * sb * {_normal_sql(43)}', 'm_b')} FROM scored, sd""")
def noise_inject(spark, sf):
    """Seeded Gaussian noise on the meta features, scaled to each feature's spread; it depends on seed and id only."""
    o = U.stored(U.scored(spark, sf))
    sd = o.agg(F.stddev_pop("m_a").alias("sa"), F.stddev_pop("m_b").alias("sb"))
    n = with_stats(o, sd)
    return n.select("doc_id", (F.col("m_a") + 0.05 * F.col("sa") * X.hash_normal(42, F.col("doc_id"))).alias("m_a"),
                    (F.col("m_b") + 0.05 * F.col("sb") * X.hash_normal(43, F.col("doc_id"))).alias("m_b"))


# --- topics and lenses ---------------------------------------------------------------------------

@query("kmeans_topics")
def kmeans_topics(spark, sf):
    return A.kmeans(light(spark, sf), 10)


@query("cluster_holdout")
def cluster_holdout(spark, sf):
    """Topic clusters grouped into folds both ways (dealt out and balanced)."""
    c = cut_lineage(A.kmeans(light(spark, sf).where("label IS NOT NULL"), 10))
    sizes = Z.cluster_sizes(c)
    a = Z.assign(c, Z.round_robin(sizes)).select("doc_id", "cluster", F.col("fold").alias("fold_round_robin"))
    b = Z.assign(c, Z.greedy_balance(sizes)).select("doc_id", F.col("fold").alias("fold_balanced"))
    return a.join(b, "doc_id")


@query("testlike_lens")
def testlike_lens(spark, sf):
    """Training rows in five groups by their probability of being target-like."""
    f = A.domain_features(C.labelled(spark, sf), C.target(spark, sf))
    p = cut_lineage(A.domain_scores(f).where("domain = 0"))
    return ranks.quintiles(p, "p").select("doc_id", "p", "fold")


# --- adaptation -----------------------------------------------------------------------------------

@query("adversarial_validation")
def adversarial_validation(spark, sf):
    """AUC of a train/target classifier, out of fold, in three feature spaces."""
    tr, tg = C.labelled(spark, sf), C.target(spark, sf)
    out = M.roc_auc(cut_lineage(A.domain_scores(A.domain_features(tr, tg, folds=3), 3)), "domain", "p").select(F.lit("char").alias("space"), "auc")
    both = cut_lineage(S.style18(C.corpus(spark, sf).select("doc_id", "text", F.col("label").isNull().cast("int").alias("domain")),
                                 keep=("doc_id", "domain")))
    robust = [c for c in K.STYLE18 if c not in K.STYLE18_LENGTH_BOUND]
    for name, cols in (("style18", K.STYLE18), ("style10", robust)):
        z = P.zscore(P.melt(both, cols, ("doc_id", "domain"))).groupBy("doc_id", "domain").pivot("feature", cols).agg(F.first("z"))
        d = cut_lineage(L.dense_vectors(z, cols).select("doc_id", "domain", "features"))
        s = cut_lineage(A.domain_scores(d, 3))
        out = out.unionByName(M.roc_auc(s, "domain", "p").select(F.lit(name).alias("space"), "auc"))
    return out


@query("iw_oof")
def iw_oof(spark, sf):
    return A.importance_weights(C.labelled(spark, sf), C.target(spark, sf), folds=3, clip_p=(0.0, 1 - 1e-9), clip_w=(0.25, 4.0))


@query("iw_insample")
def iw_insample(spark, sf):
    return A.importance_weights(C.labelled(spark, sf), C.target(spark, sf))


def pools(spark, sf, weight=None):
    v = light(spark, sf, weight=weight)
    tr = v.where("label IS NOT NULL")
    tr = tr.withColumn("weight", F.lit(1.0)) if weight is None else tr.where("weight IS NOT NULL")
    return tr, v.where("label IS NULL").select("doc_id", "features")


def _adapted(model, pool, picks):
    s = model.score(pool).select("doc_id", "margin", (F.col("margin") > 0).cast("int").alias("label"))
    return s.join(picks.select("doc_id", F.lit(1).alias("p")), "doc_id", "left").select(
        "doc_id", "margin", "label", F.coalesce("p", F.lit(0)).alias("pseudo_used"))


@query("self_train")
def self_train(spark, sf):
    """Two balanced rounds; pseudo rows are replaced each round."""
    tr, pool = pools(spark, sf)
    return _adapted(*(lambda m, p: (m, pool, p))(*A.self_train(tr, pool, rounds=2, frac=0.5)))


@query("pseudo_label_margin")
def pseudo_label_margin(spark, sf):
    """Rows beyond a margin join at half weight."""
    tr, pool = pools(spark, sf)
    m, p = A.self_train(tr, pool, select="margin", margin=0.3, pseudo_weight=0.5, kind="svm")
    return _adapted(m, pool, p)


@query("iw_pseudo")
def iw_pseudo(spark, sf):
    """Importance-weighted fit, then pseudo rows, refitted with both weights."""
    w = A.importance_weights(C.labelled(spark, sf), C.target(spark, sf))
    tr, pool = pools(spark, sf, w)
    m, p = A.self_train(tr, pool, select="margin", margin=0.3, pseudo_weight=0.5, kind="svm")
    return _adapted(m, pool, p)


def two_views(spark, sf):
    d = C.corpus(spark, sf)
    tr = d.where("label IS NOT NULL")
    out = {}
    for name, terms in (("word", lambda x: T.word_terms(x)), ("char", lambda x: T.char_wb_terms(x, 3, 3))):
        vocab = L.indexed(T.fit_vocab(terms(tr), tr))
        v = L.vectors(d.select("doc_id", "label"), T.weigh(terms(d), vocab), vocab)
        out[name] = (v.where("label IS NOT NULL"), v.where("label IS NULL").drop("label"))
    return out


@query("cotrain")
def cotrain(spark, sf):
    """Word and character views teach each other; predictions of the final fused fit and the labels taught."""
    views = two_views(spark, sf)
    return A.predict_fused(views, cut_lineage(A.cotrain(views)))


@query("agree_st")
def agree_st(spark, sf):
    """Rows both views pick with one label join the training rows; predictions of the final fused fit."""
    views = two_views(spark, sf)
    return A.predict_fused(views, A.agree_train(views))


@query("tta_crops")
def tta_crops(spark, sf):
    """Mean margin over a document's crops under each of the four crop transforms, cut at 0."""
    d = C.corpus(spark, sf)
    tr = d.where("label IS NOT NULL")
    vocab = L.indexed(T.fit_vocab(T.word_terms(tr), tr))
    fitted = L.fit("ridge", L.vectors(tr.select("doc_id", "label"), T.weigh(T.word_terms(tr), vocab), vocab))
    t = d.where("label IS NULL").select("doc_id", "text", X.tok_ws(F.col("text")).alias("tok"))
    text, tok = F.col("text"), F.col("tok")
    kinds = {"head": F.array(X.crop_head(text, tok)), "cond": F.array(X.crop_head(text, tok, longer_than=K.CROP_IF_LONGER)),
             "multi": X.crop_multi(text, tok), "slide": X.sliding_windows(text, tok)}
    sets = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("texts")) for k, c in kinds.items()])
    crops = t.select(F.col("doc_id").alias("src"), F.explode(sets).alias("s")).select(
        "src", "s.kind", F.posexplode("s.texts").alias("crop", "text"))
    crops = cut_lineage(crops.select("src", "kind", F.concat_ws(":", "kind", "crop", "src").alias("doc_id"), "text"))
    v = L.vectors(crops.select("src", "kind", "doc_id"), T.weigh(T.word_terms(crops), vocab), vocab)
    return fitted.score(v).groupBy(F.col("src").alias("doc_id"), F.col("kind").alias("transform")).agg(
        F.avg("margin").alias("margin"), F.count(F.lit(1)).alias("n_crops")).withColumn("label", (F.col("margin") > 0).cast("int"))


def domain_words(spark, sf):
    """(block, term, w): each word's coefficient in a fit of the target against the labelled documents.

    Each word has a column of its own, so the fitted weights join its index.
    """
    d = C.corpus(spark, sf)
    vocab = L.indexed(T.fit_vocab(T.word_terms(d), d, 5))
    v = L.vectors(d.select("doc_id", F.col("label").isNull().cast("int").alias("domain")), T.weigh(T.word_terms(d), vocab), vocab)
    m = L.fit("svm", v, "domain", C=0.5)
    return vocab.join(L.coefficient_table(spark, m), "idx").select("block", "term", "w")


def largest(words, k):
    return words.orderBy(F.abs("w").desc(), "term").limit(k)


@query("shift_words")
def shift_words(spark, sf):
    """Words with the largest domain coefficient, as a stop list."""
    return largest(domain_words(spark, sf), 200).select("term", "w")


@query("topic_prune")
def topic_prune(spark, sf):
    """Rules that leave terms out: document-share limits, the words most tied to topics, and the words that most tell
    labelled from target documents. Terms kept of the whole corpus, and macro-F1 over two folds of the labelled
    documents (share limits counted on a fold's training side), with the change against all terms."""
    d = C.documents(spark, sf)
    t = T.word_terms(d)
    freq = cut_lineage(T.doc_freq(t))
    topics = cut_lineage(A.kmeans(light(spark, sf, "true"), 10))
    kept = cut_lineage(T.vocab_prune(freq, min_df=5))
    v = T.lookup(t, kept.select("block", "term", "df")).select("doc_id", "block", "term", T.tf().alias("value"))
    chi = cut_lineage(T.chi2_terms(v, topics).orderBy(F.col("chi2").desc(), "term").limit(200))
    domain = cut_lineage(largest(domain_words(spark, sf), 200))
    n = F.count(F.lit(1)).alias("n_terms")
    out = freq.agg(n).select(F.lit("all").alias("rule"), "n_terms")
    rules = {"all": SE.without(None)}
    for share in (0.9, 0.5, 0.3):
        rules[f"max_df {share}"] = SE.without(None, max_df=share)
        out = out.unionByName(T.vocab_prune(freq, T.n_docs(d), 1, share).agg(n).select(F.lit(f"max_df {share}").alias("rule"), "n_terms"))
    for name, gone in (("chi2 200", chi), ("domain 200", domain)):
        rules[name] = SE.without(gone)
        out = out.unionByName(freq.join(gone, ["block", "term"], "left_anti").agg(n).select(F.lit(name).alias("rule"), "n_terms"))
    lab = C.labelled(spark, sf)
    scores = SE.fold_scores(lab, {k: ("w", f) for k, f in rules.items()}, {"svm": lambda x: L.fit("svm", x, C=0.25)},
                            {"w": cut_lineage(T.word_terms(lab))}, k=2)
    f1 = scores.groupBy(F.col("vocabulary").alias("rule")).agg(F.avg("f1").alias("macro_f1"))
    base = f1.where("rule = 'all'").select(F.col("macro_f1").alias("_all"))
    return with_stats(out.join(f1, "rule"), base).select("rule", "n_terms", "macro_f1", (F.col("macro_f1") - F.col("_all")).alias("change"))


# --- experiments around fits -----------------------------------------------------------------------

@query("eval_rep")
def eval_rep(spark, sf):
    """Per-fold macro-F1 of two representations under one estimator."""
    lab = C.labelled(spark, sf)
    folds = cut_lineage(ranks.stratified_kfold(lab.select("doc_id", "label")))
    out = None
    for rep, terms in (("word12", lambda x: T.word_terms(x, 1, 2)), ("char3", lambda x: T.char_wb_terms(x, 3, 3))):
        counted = cut_lineage(terms(lab))
        sets = []
        for i in range(5):
            # the vocabulary is fitted per fold, on its training side only
            side = folds.where(F.col("fold") != i).select("doc_id")
            vocab = L.indexed(T.fit_vocab(counted.join(side, "doc_id"), lab.join(side, "doc_id")))
            sets.append(L.vectors(folds, T.weigh(counted, vocab), vocab))
        fit = lambda t: L.fit("svm", t, C=0.25)
        scores = together([lambda i=i, d=d: A.eval_folds(d, fit, folds=[i]) for i, d in enumerate(sets)], min(map(L.fits_at_once, sets)))
        for f in scores:
            f = f.select(F.lit(rep).alias("rep"), "fold", "f1")
            out = f if out is None else out.unionByName(f)
    return out


@query("grid_search")
def grid_search(spark, sf):
    """Three-fold grid over n-gram size, rarest term and logistic penalty together, ranked by mean macro-F1."""
    lab = C.labelled(spark, sf)
    tables = {f"words 1-{n}": cut_lineage(T.word_terms(lab, 1, n)) for n in (1, 2)}
    vocabularies = {f"{t}, min_df {m}": (t, SE.without(None, min_df=m)) for t in tables for m in (2, 5)}
    fits = {f"C {c}": (lambda x, c=c: L.fit("logreg", x, C=c)) for c in (0.1, 1.0, 10.0)}
    return SE.ranked(SE.fold_scores(lab, vocabularies, fits, tables))


@query("coordinate_descent")
def coordinate_descent(spark, sf):
    """One setting at a time over blend weight and cut, on cached scores.

    Every configuration is scored in one pass into a small table; the search
    itself walks that table.
    """
    ws, ts = [i / 5 for i in range(6)], [i / 20 for i in range(4, 17)]
    g = N.blend_grid(U.scored(spark, sf), "p_a", "p_b", ws, ["y"])
    rows = M.threshold_sweep(g, ts, "y", "p", by=["w"]).collect()  # 6 x 13 numbers
    table = {(round(x["w"], 6), round(x["t"], 6)): x["macro_f1"] for x in rows}
    best, f1 = E.coordinate_descent(lambda c: table[round(c["w"], 6), round(c["t"], 6)], {"w": ws, "t": ts}, {"w": 0.4, "t": 0.5})
    return spark.createDataFrame([(best["w"], best["t"], float(f1))], "w double, t double, f1 double")


@query("nested_threshold")
def nested_threshold(spark, sf):
    """Cut chosen on an inner split, model refitted, cut applied to the outer holdout."""
    lab = C.labelled(spark, sf)
    vocab = L.indexed(T.fit_vocab(T.word_terms(lab), lab))
    outer = cut_lineage(ranks.stratified_holdout(cut_lineage(lab.select("doc_id", "label")), frac=0.2, seed=1))
    inner = ranks.stratified_holdout(outer.where("split = 'train'").drop("split"), frac=0.15, seed=2)
    parts = cut_lineage(inner.unionByName(outer.where("split = 'val'").withColumn("split", F.lit("held"))))
    # both splits are dealt before the vectors are made, so these are written once
    v = L.vectors(parts, T.weigh(T.word_terms(lab), vocab), vocab)
    tr, ho = v.where("split <> 'held'").drop("split"), v.where("split = 'held'")
    inner = v.where("split <> 'held'")
    m = L.fit("logreg", inner.where("split = 'train'"))
    sweep = M.threshold_sweep(m.score(inner.where("split = 'val'")), [i / 50 for i in range(5, 46)], "label", "p")
    best = sweep.orderBy(F.round("macro_f1", 9).desc(), "t").limit(1).select(F.col("t").alias("cut"))
    s = with_stats(L.fit("logreg", tr).score(ho), best)
    return s.select("doc_id", "label", "p", "cut", (F.col("p") >= F.col("cut")).cast("int").alias("pred"))


@query("flagship")
def flagship(spark, sf):
    """Fused representation, importance weights, self-training and label override."""
    return A.flagship(C.labelled(spark, sf), C.target(spark, sf))
