"""Adaptation loops: domain weights, self-training, co-training, the full predictor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import style as S
from ..session import cut_lineage, together, with_stats
from . import centres, dedup, langmodel, linear, metrics, ranks, shift
from . import terms as T

# Settings of the full predictor.
WORD_SCALE, BANK_SCALE, STYLE_SCALE, RIDGE_ALPHA, PICK_SHARE = 1.6, 0.02, 0.04, 0.9, 0.5


def domain_features(train, target, lo=3, hi=5, min_df=5, folds=None, seed=13) -> DataFrame:
    """Character TF-IDF fitted on the training text, vectors for both sides; domain 0/1, ``fold`` where asked for.

    The folds are dealt before the vectors are made, so these are written once.
    """
    docs = train.select("doc_id", "text", F.lit(0).alias("domain")).unionByName(
        target.select("doc_id", "text", F.lit(1).alias("domain")))
    v = linear.indexed(T.fit_vocab(T.char_wb_terms(train, lo, hi), train, min_df))
    rows = docs.select("doc_id", "domain")
    if folds:
        rows = cut_lineage(ranks.stratified_kfold(cut_lineage(rows), "domain", k=folds, seed=seed))
    return linear.vectors(rows, T.weigh(T.char_wb_terms(docs, lo, hi), v), v)


def domain_scores(features, folds=None, seed=13, C=1.0) -> DataFrame:
    """P(target) per row from a domain classifier, in-sample or out-of-fold (``fold`` is dealt where absent)."""
    fit = lambda d: linear.fit("logreg", d, "domain", balanced=False, C=C)
    if not folds:
        return fit(features).score(features).select("doc_id", "domain", "p")
    if "fold" not in features.columns:
        features = cut_lineage(ranks.stratified_kfold(features, "domain", k=folds, seed=seed))
    return linear.oof(features, fit, k=folds).select("doc_id", "domain", "p")


def importance_weights(train, target, folds=None, clip_p=(0.05, 0.95), clip_w=(0.0, 10.0)) -> DataFrame:
    """Weight per training row, mean 1."""
    s = cut_lineage(domain_scores(domain_features(train, target, folds=folds), folds))
    return shift.density_ratio(s.where("domain = 0"), "p", clip_p, clip_w).select("doc_id", "w")


def self_train(train, pool, rounds=1, frac=0.5, select="balanced", margin=None, pseudo_weight=1.0, kind="ridge", **kw):
    """Fit, pick confident pool rows, refit on train + picks; picks are replaced each round.

    ``train``: doc_id, features, label, weight. ``pool``: doc_id, features.
    Returns the last model and the last picks.
    """
    model = linear.fit(kind, train, weight="weight", **kw)
    picks = None
    for _ in range(rounds):
        s = cut_lineage(model.score(pool.select("doc_id", "features")).select("doc_id", "margin"))
        if select == "balanced":
            picks = shift.balanced_select(s, frac)
        elif select == "margin":
            picks = s.where(F.abs("margin") >= margin).select("doc_id", "margin", (F.col("margin") > 0).cast("int").alias("label"))
        else:
            picks = shift.unbalanced_select(s, frac)
        picks = cut_lineage(picks)
        extra = pool.select("doc_id", "features").join(picks.select("doc_id", "label"), "doc_id")
        both = train.select("doc_id", "features", "label", "weight").unionByName(
            extra.select("doc_id", "features", "label", F.lit(float(pseudo_weight)).alias("weight")))
        model = linear.fit(kind, both, weight="weight", **kw)
    return model, picks


def _fit_on(train, pool, picks):
    """Ridge on the training rows plus the picked pool rows of one view."""
    rows = train.select("features", "label")
    if picks is not None:
        rows = rows.unionByName(pool.join(picks.select("doc_id", "label"), "doc_id").select("features", "label"))
    return linear.fit("ridge", rows)


def _view_scores(views, picks):
    """Margins of each view's pool under a fit on its training rows and picks, the views side by side."""
    def one(v):
        tr, po = views[v]
        return cut_lineage(_fit_on(tr, po, picks[v]).score(po.select("doc_id", "features")).select("doc_id", "margin"))

    at_once = min(linear.fits_at_once(tr) for tr, _ in views.values())
    return dict(zip(views, together([lambda v=v: one(v) for v in views], at_once)))


def fused_views(views):
    """Train and pool rows of all views with their vectors end to end."""
    return tuple(linear.joined_vectors({name: both[i] for name, both in views.items()}) for i in (0, 1))


def predict_fused(views, picks):
    """Final predictor of both loops: ridge on the fused vectors of the training rows and the picks."""
    tr, po = fused_views(views)
    s = _fit_on(tr, po, picks).score(po).select("doc_id", "margin", (F.col("margin") > 0).cast("int").alias("label"))
    if picks is None:
        return s.withColumn("pseudo_label", F.lit(None).cast("int"))
    return s.join(picks.select("doc_id", F.col("label").alias("pseudo_label")), "doc_id", "left")


def cotrain(views, rounds=3, frac=0.5):
    """Two views teach each other; picks accumulate, the latest label wins.

    ``views``: {"word": ..., "char": ...} of (train vectors, pool vectors).
    """
    given = {"word": None, "char": None}
    for _ in range(rounds):
        scores = _view_scores(views, given)
        new = {v: shift.balanced_select(s, frac).select("doc_id", "label") for v, s in scores.items()}
        for v, teacher in (("word", "char"), ("char", "word")):
            old, fresh = given[v], new[teacher]
            given[v] = cut_lineage(fresh if old is None else fresh.unionByName(old.join(fresh, "doc_id", "left_anti")))
    # the word view was taught by the character view and the other way round
    taught = shift.cotrain_union(given["char"], given["word"])
    return taught


def agree_train(views, rounds=3, frac=0.5):
    """Only rows both views pick with the same label are added; replaced each round."""
    picks = None
    for _ in range(rounds):
        m = {v: shift.balanced_select(s, frac) for v, s in _view_scores(views, dict.fromkeys(views, picks)).items()}
        fresh = cut_lineage(shift.agreed(m["word"], m["char"]))
        if fresh.isEmpty():
            break
        picks = fresh
    return picks


def fused_blocks(train, docs, word=(1, 3), char=(2, 6), min_df=2, bank=True, style=True):
    """Long fused table of ``docs``: scaled word and character TF-IDF plus small dense legs, with column numbers in
    place of the terms; and the index of the columns."""
    wt, wd = T.word_terms(train, *word), T.word_terms(docs, *word)
    ct, cd = T.char_wb_terms(train, *char), T.char_wb_terms(docs, *char)
    vocab = T.fit_vocab(wt, train, min_df).unionByName(T.fit_vocab(ct, train, min_df))
    dense = []
    if bank:
        b = T.dense_block(cut_lineage(langmodel.bank16(docs, train)), langmodel.BANK16, "bank")
        fit = b.join(train.select("doc_id"), "doc_id", "left_semi")
        dense.append(T.block_scale(T.standardize(b, fit), {"bank": BANK_SCALE}))
    if style:
        # written first: a filter inferred from the explode must not repeat the style expressions
        arr = cut_lineage(S.style227(docs))
        d = arr.select("doc_id", F.lit("style").alias("block"), F.posexplode("style").alias("term", "value"))
        d = d.select("doc_id", "block", F.col("term").cast("string").alias("term"), "value")
        fit = d.join(train.select("doc_id"), "doc_id", "left_semi")
        dense.append(T.block_scale(T.standardize(d, fit), {"style": STYLE_SCALE}))
    names = vocab.select("block", "term")
    if dense:
        legs = cut_lineage(T.stack_blocks(*dense))
        names = names.unionByName(legs.select("block", "term"))
    index = linear.column_index(names)
    vocab = cut_lineage(vocab.join(index, ["block", "term"]))
    w = T.weigh(wd, vocab.where("block = 'w'"))
    c = T.weigh(cd, vocab.where("block = 'c'"))
    blocks = [T.block_scale(w, {"w": WORD_SCALE}), c]
    if dense:
        # one row per dense column
        own = F.broadcast(index.where(F.col("block").isin("bank", "style")))
        blocks.append(legs.join(own, ["block", "term"]).select("doc_id", "block", "idx", "value"))
    return T.stack_blocks(*blocks), index


def flagship(train, target, **legs) -> DataFrame:
    """Fused legs, importance weights, one balanced self-training round, label override.

    ``train``: doc_id, text, label; ``target``: doc_id, text.
    """
    docs = train.select("doc_id", "text", "label").unionByName(
        target.select("doc_id", "text", F.lit(None).cast("int").alias("label")))
    w = importance_weights(train, target).withColumnRenamed("w", "weight")
    long, index = fused_blocks(train, docs, **legs)
    vec = linear.vectors(docs.select("doc_id", "label").join(w, "doc_id", "left"), long.repartition("doc_id"), index)
    tr = vec.where("label IS NOT NULL AND weight IS NOT NULL")
    pool = vec.where("label IS NULL").select("doc_id", "features")
    model, picks = self_train(tr, pool, rounds=1, frac=PICK_SHARE, kind="ridge", alpha=RIDGE_ALPHA)
    pred = model.score(pool).select("doc_id", "margin", (F.col("margin") > 0).cast("int").alias("label"))
    pred = cut_lineage(pred)
    over = dedup.label_override(pred.select("doc_id", "label"), target, train)
    used = picks.select("doc_id", F.lit(1).alias("pseudo"))
    return pred.select("doc_id", "margin").join(over, "doc_id").join(used, "doc_id", "left").select(
        "doc_id", "margin", "label", "overridden", F.coalesce("pseudo", F.lit(0)).alias("pseudo_used"))


def kmeans(vecs, k, seed=42) -> DataFrame:
    """Topic clusters of sparse vectors: MLlib picks the first centres (k-means||, no step), ``centres.lloyd`` moves them.

    MLlib's own steps would collect k dense rows of all columns on the driver each.
    """
    from pyspark.ml.clustering import KMeans

    start = KMeans(k=k, seed=seed, maxIter=0, featuresCol="features", predictionCol="cluster").fit(vecs)
    return centres.lloyd(vecs, start.clusterCenters())


def nested_stack(v, kinds, metas, fold="fold", k=3, inner=3, seed=1) -> DataFrame:
    """Scores of meta models over base margins where nothing was fitted on the row that is scored.

    For each outer fold the bases give inner out-of-fold margins on its training side; their means and spreads
    scale both sides, and each meta model is fitted on them. The bases, refitted on the whole training side,
    then score the held fold. ``metas``: name -> function from rows (label, features, fold, margins) to a model
    with ``score``. Returns (doc_id, label, fold, meta, score), one row per document and meta model.
    """
    kinds = list(kinds)

    def legs(rows, score):
        out = rows
        for kind in kinds:
            out = out.join(score(kind).select("doc_id", F.col("margin").alias(kind)), "doc_id")
        return cut_lineage(out)

    out = None
    for i in range(k):
        tr = cut_lineage(ranks.stratified_kfold(v.where(F.col(fold) != i).select("doc_id", "label", "features"), k=inner, seed=seed))
        ho = v.where(F.col(fold) == i).select("doc_id", "label", "features")
        seen = legs(tr.select("doc_id", "label", "fold"), lambda kind: linear.oof(tr, lambda t: linear.fit(kind, t), k=inner))
        whole = dict(zip(kinds, together([lambda kind=kind: linear.fit(kind, tr) for kind in kinds], linear.fits_at_once(tr))))
        held = legs(ho.select("doc_id", "label"), lambda kind: whole[kind].score(ho))
        stats = seen.agg(*[F.avg(c).alias(f"_m_{c}") for c in kinds], *[F.stddev_pop(c).alias(f"_s_{c}") for c in kinds])

        def scaled(rows, keep):
            sd = lambda c: F.when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
            z = with_stats(rows, stats).select(*keep, *[((F.col(c) - F.col(f"_m_{c}")) / sd(c)).alias(c) for c in kinds])
            return cut_lineage(linear.dense_vectors(z, kinds))

        fit_on, score_on = scaled(seen, ("doc_id", "label", "fold")), scaled(held, ("doc_id", "label"))
        for name, fit_meta in metas.items():
            s = fit_meta(fit_on).score(score_on)
            value = F.col("p") if "p" in s.columns else F.col("margin")
            s = s.select("doc_id", "label", F.lit(i).alias("fold"), F.lit(name).alias("meta"), value.alias("score"))
            out = s if out is None else out.unionByName(s)
    return out


def best_ridge(rows, columns, alphas):
    """Ridge meta model with the penalty of the best out-of-fold macro-F1 (the smallest on ties)."""
    s = linear.ridge_path(rows, columns, alphas, label="label")
    f = metrics.macro_f1(s.withColumn("pred", (F.col("margin") > 0).cast("int")), "label", "pred", ["alpha"])
    alpha = f.orderBy(F.round("macro_f1", 9).desc(), "alpha").first()["alpha"]  # one row per penalty
    return linear.fit("ridge", rows, alpha=alpha)


def eval_folds(df, fit_fn, fold="fold", label="label", folds=range(5)) -> DataFrame:
    """Macro-F1 per fold for a fit function over vectors (train on the rest)."""
    out = None
    for i in folds:
        s = fit_fn(df.where(F.col(fold) != i)).score(df.where(F.col(fold) == i))
        f = metrics.macro_f1(s.withColumn("pred", (F.col("margin") > 0).cast("int")), label, "pred").select(
            F.lit(i).alias("fold"), F.col("macro_f1").alias("f1"))
        out = f if out is None else out.unionByName(f)
    return out
