"""Truncated SVD with its factors in the work folder, against dense algebra; the spaces and legs built on it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.operators import lowrank, lsh, projection
from driftmark.plans import learned


def long_rows(spark, a):
    rows = [(i, "w", f"t{j:04d}", float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]]
    return spark.createDataFrame(rows, "doc_id long, block string, term string, value double")


def test_more_directions_than_are_carried(spark, monkeypatch):
    """Several parts a side and a spectrum wider than what the iteration carries."""
    monkeypatch.setattr(lowrank, "FEW", 500)
    monkeypatch.setattr(lowrank, "BESIDE", 6)
    rng = np.random.default_rng(3)
    a = rng.normal(size=(70, 50)) @ np.diag(0.8 ** np.arange(50)) @ rng.normal(size=(50, 90))
    a[rng.random(a.shape) < 0.3] = 0
    a[7] = 0  # a document without terms
    model, scores = projection.fit_lsa(long_rows(spark, a), 5)
    _, s, vt = np.linalg.svd(a)
    assert model.right.parts > 1 and model.right.width < min(a.shape)
    assert np.allclose(model.sigma, s[:5], rtol=1e-3)
    got = {r["doc_id"]: np.array(r["x"]) for r in scores.collect()}
    want = a @ vt[:5].T
    assert 7 not in got and all(np.allclose(np.abs(got[i]), np.abs(want[i]), atol=0.05 * s[0]) for i in got)
    v = np.array([r["v"] for r in model.vectors.orderBy("term").collect()])
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-9)


def test_only_sums_of_products_reach_the_driver(spark, monkeypatch):
    seen = []
    real = lowrank.K.read
    monkeypatch.setattr(lowrank.K, "read", lambda folder, columns: seen.append(tuple(columns)) or real(folder, columns))
    a = np.random.default_rng(4).random((20, 300))
    projection.fit_lsa(long_rows(spark, a), 3)
    assert set(seen) == {("gram",)}


@pytest.mark.parametrize("a", [np.zeros((0, 3)), np.ones((4, 3))])
def test_no_rows_and_equal_rows(spark, a):
    model, _ = projection.fit_lsa(long_rows(spark, a), 2)
    assert len(model.sigma) == min(len(a), 1)
    other = spark.createDataFrame([(9, "w", "t0000", 2.0)], "doc_id long, block string, term string, value double")
    assert len(model.project(other, other.select("doc_id")).first()["x"]) == len(model.sigma)


def tables(spark, folder, n=60):
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(f"{'ab'[i % 2]}word{j}" for j in rng.integers(0, 40, 25)), "en", "s") for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(n - 10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_lsa_keeps_all_components_of_few_documents(spark, tmp_path):
    got = learned.svd_lsa(spark, tables(spark, tmp_path)).collect()
    assert len(got) == 60 and {len(r["x"]) for r in got} == {50}  # as many as labelled documents; 20 before


def test_a_crowded_bucket_is_searched_whole(spark):
    """Many vectors closer than the narrowest bucket: no query may miss the part of them that salt put elsewhere."""
    rng = np.random.default_rng(7)
    near, far = rng.normal(size=(90, 3)) * 1e-3 + [3.3, 1.7, -2.9], rng.normal(size=(30, 3)) * 10
    x = np.vstack([near, far])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = lsh.knn_lsh(df, df, 3, tables=2, levels=2, leaf=10).where("query < 90").toPandas()
    d = np.linalg.norm(near[:, None] - near[None], axis=2)
    want = np.sort(d, axis=1)[:, :3]
    assert np.allclose(got.sort_values(["query", "rank"])["dist"].to_numpy().reshape(-1, 3), want, atol=1e-9)


def test_legs_never_see_the_held_texts(spark, tmp_path, monkeypatch):
    lab = learned.C.labelled(spark, tables(spark, tmp_path)).select("doc_id", "label", "text")
    sizes = []
    real = learned.T.fit_vocab
    monkeypatch.setattr(learned.T, "fit_vocab", lambda terms, docs, *a, **k: sizes.append(docs.count()) or real(terms, docs, *a, **k))
    got = learned.leg_scores(lab.where("doc_id >= 20"), lab.where("doc_id < 20")).toPandas()
    assert sizes == [30] and sorted(got["doc_id"]) == list(range(20))
    assert all(((got[kind] > 0) == got["label"]).mean() > 0.9 for kind in learned.LEGS)


def test_cached_legs_hold_the_inner_and_the_target_scores(spark, tmp_path, monkeypatch):
    sf = tables(spark, tmp_path)

    def scored(train, held):
        assert train.select("doc_id").intersect(held.select("doc_id")).isEmpty()
        return held.drop("text").select("*", *[F.lit(0.5).alias(kind) for kind in learned.LEGS])

    monkeypatch.setattr(learned, "leg_scores", scored)
    got = learned.all_legs(spark, sf).toPandas()
    out = got[got["part"] == "oof"]
    assert len(out) == 50 and (got["part"] == "test").sum() == 10
    for i in range(3):
        inner = got[(got["part"] == "inner") & (got["outer"] == i)]
        assert sorted(inner["doc_id"]) == sorted(out.loc[out["fold"] != i, "doc_id"]) and set(inner["fold"]) == {0, 1, 2}
