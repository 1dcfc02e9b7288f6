import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.operators import bayes as B
from driftmark.operators import dedup as D
from driftmark.operators import experiments as E
from driftmark.operators import langmodel as L
from driftmark.operators import lenses as Z
from driftmark.operators import linear as LN
from driftmark.operators import metrics as M
from driftmark.operators import neighbors as NN
from driftmark.operators import ranks
from driftmark.operators import shift as H
from driftmark.operators import terms as T
from driftmark.sources import corpus as C
from driftmark.sources import sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("y,p,want", [((0, 0, 1, 1), (0, 1, 1, 1), 0.733333), ((0, 0, 1, 1), (1, 1, 1, 1), 0.333333)])
def test_macro_f1(spark, y, p, want):
    df = frame(spark, list(zip(y, p)), "y int, pred int")
    assert round(M.macro_f1(df).first()["macro_f1"], 6) == want


def test_pooled_and_fold_mean_differ(spark):
    df = frame(spark, [(1, 0, 0), (1, 1, 1), (2, 0, 1), (2, 1, 1), (2, 1, 0)], "fold int, y int, pred int")
    assert round(M.macro_f1(df).first()["macro_f1"], 6) == 0.583333
    assert round(M.macro_f1_foldmean(df).first()["macro_f1"], 6) == 0.625


def test_auc_with_a_tie(spark):
    df = frame(spark, [(0, 0.1), (0, 0.5), (1, 0.5), (1, 0.9)], "y int, p double")
    assert M.roc_auc(df).first()["auc"] == 0.875


def test_balanced_select(spark):
    df = frame(spark, [(1, 2.0), (2, 0.5), (3, 0.1), (4, -1.5), (5, -0.2)], "doc_id long, margin double")
    assert {r["doc_id"] for r in H.balanced_select(df, 0.5).collect()} == {1, 4}


def test_quintile_boundaries(spark):
    df = frame(spark, [(i, float(i)) for i in range(7)], "doc_id long, p double")
    got = [r["fold"] for r in ranks.quintiles(df, "p").orderBy("doc_id").collect()]
    assert got == [0, 1, 2, 2, 3, 4, 4]


def test_cluster_grouping(spark):
    sizes = frame(spark, [(0, 10), (1, 40), (2, 30), (3, 5), (4, 20), (5, 15), (6, 1)], "cluster int, n long")
    rr = {r["cluster"]: r["fold"] for r in Z.round_robin(sizes).collect()}
    assert rr == {1: 0, 2: 1, 4: 2, 5: 3, 0: 4, 3: 0, 6: 1}
    gb = {r["cluster"]: r["fold"] for r in Z.greedy_balance(sizes).collect()}
    assert gb == {1: 0, 2: 1, 4: 2, 5: 3, 0: 4, 3: 4, 6: 3}


def test_density_ratio(spark):
    df = frame(spark, [(1, 0.02), (2, 0.5), (3, 0.99)], "doc_id long, p double")
    w = [round(r["w"], 6) for r in H.density_ratio(df).orderBy("doc_id").collect()]
    assert w == [0.014286, 0.271429, 2.714286]


def test_label_override(spark):
    tr = frame(spark, [(1, "X  y", 0), (2, "x y", 1), (3, "z", 1)], "doc_id long, text string, label int")
    tg = frame(spark, [(8, "x y"), (9, " Z ")], "doc_id long, text string")
    pred = frame(spark, [(8, 0), (9, 0)], "doc_id long, label int")
    got = {r["doc_id"]: r["label"] for r in D.label_override(pred, tg, tr).collect()}
    assert got == {8: 0, 9: 1}
    assert D.dup_groups(tr).first().asDict() == {"n_groups": 2, "dup_groups": 1, "dup_rows": 2, "mixed_groups": 1}


def test_multinomial_posterior(spark, micro):
    tr = micro.where("label IS NOT NULL")
    model = B.multinomial_model(T.word_terms(tr, keep=("doc_id", "label")))
    tg = micro.where("label IS NULL")
    s = B.score(tg, T.word_terms(tg), model, B.prior_gap(tr)).select(B.sigmoid(F.col("margin")).alias("p")).first()
    assert round(s["p"], 6) == 0.608931
    odds = {r["term"]: r["log_odds"] for r in B.diagnostic_terms(model, 9).collect()}
    assert odds["cat"] == -1.223775 and odds["model"] == 0.973449 and odds["ran"] == -0.125163


def test_backoff_scores_of_a_short_text(spark):
    tr = frame(spark, [(1, "aab", 0), (2, "aab", 1)], "doc_id long, text string, label int")
    tg = frame(spark, [(3, "aaz")], "doc_id long, text string")
    s = {r["window"]: r["s0"] for r in L.backoff_scores(L.windows(tg), L.backoff_tables(tr)).collect()}
    assert set(s) == {"\x02a", "\x02aa", "\x02aaz", "aaz\x03"}
    assert np.exp(s["\x02aa"]) == pytest.approx(0.4)            # trigram after its only context
    assert np.exp(s["\x02aaz"]) == pytest.approx(0.4 ** 3 / 9)  # unseen character: (0 + 1) / (5 + 4)


def test_exact_quantiles_and_hot_values(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.full(700, 0.25), rng.random(1300)])  # a third of the rows share one value
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.731, 1.0]
    got = {r["prob"]: r["value"] for r in ranks.exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(v, p), abs=1e-12)
    rk = {r["id"]: r["rk"] for r in ranks.global_rank(df, "v", "id").collect()}
    want = np.lexsort((np.arange(len(v)), v))
    assert [rk[int(i)] for i in want] == list(range(len(v)))


def test_splits_cover_every_row_once(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(143)], "doc_id long, label int").repartition(3)
    k = ranks.stratified_kfold(df).groupBy("label", "fold").count().collect()
    for c in (0, 1):
        sizes = [r["count"] for r in k if r["label"] == c]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert ranks.stratified_kfold(df).count() == 143
    val = ranks.stratified_holdout(df).where("split = 'val'").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in val} == {0: 12, 1: 2}


def test_salted_join_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(T, "HOT_ROWS", 5.0)
    monkeypatch.setattr(T, "HOT_SHARE", 4)
    left = frame(spark, [(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "doc_id long, key string")
    right = frame(spark, [("hot", 1), ("k0", 2), ("k3", 3)], "key string, v int")
    for how in ("inner", "left"):
        a = sorted(map(str, T.key_lookup(left, right, ["key"], how=how).select("doc_id", "key", "v").collect()))
        b = sorted(map(str, left.join(right, "key", how).select("doc_id", "key", "v").collect()))
        assert a == b


def test_nearest_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(NN, "BLOCK", 20)
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(150, 4)).round(2)
    pts[100:] = pts[7]  # a third of all rows are copies of one vector
    rows = [(int(i), [float(x) for x in p]) for i, p in enumerate(pts)]
    base = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    got = {}
    for r in NN.knn_join(base, base, 3, n_pivots=6).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbor"]))
    for i in range(len(pts)):
        d = np.sqrt(((pts - pts[i]) ** 2).sum(axis=1)).round(9)
        want = sorted(range(len(pts)), key=lambda j: (d[j], j))[:3]
        assert [n for _, n in sorted(got[i])] == want


def test_label_spreading_follows_the_graph(spark):
    edges = [(a, b) for g in (range(0, 4), range(4, 8)) for a in g for b in g]
    e = spark.createDataFrame(edges, "query long, neighbor long")
    seeds = spark.createDataFrame([(i, {0: 0, 7: 1}.get(i)) for i in range(8)], "id long, label int")
    got = {r["id"]: r["label"] for r in NN.label_spread(e, seeds, max_iter=10).collect()}
    assert [got[i] for i in range(8)] == [0] * 4 + [1] * 4


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(60, 3)), rng.integers(0, 2, 60), rng.random(60) + 0.5
    df = spark.createDataFrame([(*map(float, r), int(t), float(u)) for r, t, u in zip(x, y, w)],
                               "a double, b double, c double, label int, weight double")
    m = LN.fit("ridge", LN.dense_vectors(df, ["a", "b", "c"]), weight="weight", alpha=0.9, max_iter=200)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    sw = w * (len(y) / (2.0 * n))[y]
    t = 2.0 * y - 1
    xc, tc = x - np.average(x, axis=0, weights=sw), t - np.average(t, weights=sw)
    want = np.linalg.solve(xc.T @ (xc * sw[:, None]) + 0.9 * np.eye(3), xc.T @ (sw * tc))
    assert np.allclose(m.coefficients, want, atol=1e-4)


def test_lsa_matches_a_dense_svd(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 6)) * np.array([9, 5, 3, 1, 0.5, 0.1])
    rows = [(i, "b", f"t{j}", float(x[i, j])) for i in range(30) for j in range(6)]
    long = spark.createDataFrame(rows, "doc_id long, block string, term string, value double")
    scores, sigma = NN.lsa(long.withColumn("doc_id", F.concat(F.lit("u-"), "doc_id")), 3)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(sigma, s[:3], rtol=1e-4)
    got = {r["doc_id"]: r["x"] for r in scores.collect()}
    mine = np.array([got[f"u-{i}"] for i in range(30)])
    assert np.allclose(mine @ mine.T, (u[:, :3] * s[:3]) @ (u[:, :3] * s[:3]).T, atol=1e-6)


def test_weights_keep_mean_one_and_bounds(spark):
    tr = spark.createDataFrame([(i, float(np.log1p(i % 50))) for i in range(200)], "doc_id long, log_tokens double")
    tg = spark.createDataFrame([(i, float(np.log1p(i % 90))) for i in range(200)], "doc_id long, log_tokens double")
    for fn in (H.length_histogram_weights, H.length_kde_weights):
        a = fn(tr, tg).agg(F.avg("w").alias("m"), F.max("w").alias("hi"), F.min("w").alias("lo"), F.count("*").alias("n")).first()
        assert a["n"] == 200 and a["m"] == pytest.approx(1.0) and a["hi"] / a["lo"] <= 16.0 + 1e-9


def test_sink_audit_and_reproduction_gate(spark):
    pred = spark.createDataFrame([(1, 0), (2, 5), (9, 1), (9, 1)], "doc_id long, label int")
    want = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    r = sinks.verify_predictions(pred, want).first().asDict()
    assert r == {"n_rows": 4, "n_expected": 3, "missing_ids": 1, "unexpected_ids": 1, "repeated_ids": 1, "bad_labels": 1}
    E.repro_gate(0.7383, 0.738, 0.003)
    with pytest.raises(ValueError):
        E.repro_gate(0.75, 0.738, 0.003)


def test_paired_scan_filters_and_deduplicates(spark):
    long_text = " ".join(["w"] * 20)
    df = spark.createDataFrame([(long_text, "short"), (long_text + " ", None), ("x " * 25, long_text)],
                               "human_text string, machine_text string")
    got = {(r["label"], len(r["text"].split())) for r in C.scan_paired(df).collect()}
    assert got == {(0, 20), (0, 25)}


def test_threshold_sweep_counts_each_cut(spark):
    rows = [(0, 0.2), (1, 0.4), (0, 0.6), (1, 0.8)]
    df = frame(spark, rows, "y int, p double")
    got = {r["t"]: r["macro_f1"] for r in M.threshold_sweep(df, [0.0, 0.4, 0.7], "y", "p").collect()}
    for t, f in got.items():
        pred = [int(p >= t) for _, p in rows]
        want = M.macro_f1(frame(spark, [(y, q) for (y, _), q in zip(rows, pred)], "y int, pred int")).first()["macro_f1"]
        assert f == pytest.approx(want)


def test_coordinate_descent_walks_to_the_best():
    best, s = E.coordinate_descent(lambda c: -(c["a"] - 2) ** 2 - (c["b"] - 1) ** 2, {"a": [0, 1, 2], "b": [0, 1]}, {"a": 0, "b": 0})
    assert best == {"a": 2, "b": 1} and s == 0


def test_every_term_has_a_column_of_its_own(spark):
    from driftmark.operators import linear as L

    long = spark.createDataFrame([(d, "w", f"t{i}", float(i + 1)) for d in range(3) for i in range(d, 300)],
                                 "doc_id long, block string, term string, value double").repartition(5)
    index = L.column_index(long)
    rows = [(r.term, r.idx) for r in index.collect()]
    assert sorted(i for _, i in rows) == list(range(300)) and [t for t, _ in sorted(rows, key=lambda r: r[1])] == sorted(t for t, _ in rows)
    v = {r.doc_id: r.features for r in L.vectors(long.select("doc_id").distinct(), long, index).collect()}
    assert all(v[d].size == 300 and v[d][dict(rows)[f"t{i}"]] == (i + 1 if i >= d else 0) for d in range(3) for i in (0, 1, 2, 299))


def test_vectors_come_without_python_workers(spark):
    from driftmark.operators import linear as L

    long = spark.createDataFrame([(1, "w", "b", 2.0), (1, "w", "a", 1.0), (1, "w", "b", 0.5), (2, "w", "c", 3.0), (2, "x", "a", 4.0)],
                                 "doc_id long, block string, term string, value double")
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "no term")], "doc_id long, name string")
    out = L.vectors(docs, long)
    assert "Python" not in out._jdf.queryExecution().toString() and out.columns == ["doc_id", "name", "features"]
    v = {r.doc_id: r.features for r in out.collect()}
    assert v[1].indices.tolist() == [0, 1] and v[1].values.tolist() == [1.0, 2.5]  # a repeated term is summed
    assert v[2].indices.tolist() == [2, 3] and v[2].values.tolist() == [3.0, 4.0]
    assert v[3].size == 4 and v[3].numNonzeros() == 0
    known = L.column_index(long.where("term = 'b'"))
    assert {r.doc_id: r.features.toArray().tolist() for r in L.vectors(docs, long, known).collect()} == {1: [2.5], 2: [0.0], 3: [0.0]}


def test_ranks_with_text_ids(spark):
    from driftmark.operators import ranks

    rows = [(f"id-{i:04d}", float(i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id string, v double").repartition(4)
    got = {r.doc_id: r.rk for r in ranks.global_rank(df, "v", "doc_id").collect()}
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want


def test_chi_square_from_observed_cells(spark):
    from driftmark.operators import terms as T

    vec = spark.createDataFrame([(1, "w", "a", 1.0), (2, "w", "a", 2.0), (3, "w", "b", 4.0), (4, "w", "a", 1.0)], "doc_id long, block string, term string, value double")
    cl = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, cluster int")
    got = {r.term: r.chi2 for r in T.chi2_terms(vec, cl).collect()}
    assert got["a"] == pytest.approx((3 - 2) ** 2 / 2 + (1 - 2) ** 2 / 2) and got["b"] == pytest.approx(4.0)
