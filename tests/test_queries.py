"""Registry checks on the smallest test folder: result equality with the SQL twin."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "embeddings", "benchmark", "conversations"]
SOME = ["scan_corpus", "term_counts", "tfidf", "style18", "nb_multinomial", "perplexity_feats", "label_override",
        "balanced_select", "gate", "knn_join", "split_gain"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(df.astype(object).where(df.notna(), None).map(str).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows(got) == rows(want)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_self_training_invariants(spark):
    r = entry.queries()["self_train"](spark, SF).toPandas()
    assert r["doc_id"].is_unique and set(r["label"]) <= {0, 1}
    assert 0 < r["pseudo_used"].sum() < len(r)


def test_nested_stack_scores_every_row_once_per_meta(spark):
    import numpy as np

    from driftmark.operators import adapt as A
    from driftmark.operators import linear as L
    from driftmark.operators import ranks

    rng = np.random.default_rng(0)
    rows = [(f"id-{i}", i % 2, float(a + i % 2), float(b)) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    d = L.dense_vectors(spark.createDataFrame(rows, "doc_id string, label int, a double, b double"), ["a", "b"])
    v = ranks.stratified_kfold(d.select("doc_id", "label", "features"), k=2)
    metas = {"logistic": lambda t: L.fit("logreg", t), "ridge_cv": lambda t: A.best_ridge(t, ["ridge", "logreg"], [0.1, 1.0])}
    s = A.nested_stack(v, ["ridge", "logreg"], metas, k=2, inner=2).toPandas()
    assert len(s) == 120 and not s.duplicated(["doc_id", "meta"]).any()
    assert s["score"].notna().all() and set(s["meta"]) == set(metas)


def test_importance_weights_have_mean_one(spark):
    w = entry.queries()["iw_insample"](spark, SF).toPandas()["w"]
    assert abs(w.mean() - 1) < 1e-5 and w.min() > 0


def small_tables(spark, folder, n=60):
    docs = [(i, f"{'red green' if i % 2 else 'blue white'} word{i % 7} text{i % 5}", "en", "s") for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(n - 10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_nested_threshold_writes_its_vectors_once(spark, tmp_path, monkeypatch):
    from driftmark import session

    kept = []
    sf = small_tables(spark, tmp_path)
    write = session.new_folder
    monkeypatch.setattr(session, "new_folder", lambda s, name="t": kept.append(write(s, name)) or kept[-1])
    out = entry.queries()["nested_threshold"](spark, sf).toPandas()
    assert len(out) == 10 and out["pred"].eq(out["label"]).all()
    with_vectors = [f for f in kept if "features" in spark.read.parquet(f).columns]
    assert len(with_vectors) == 1
    assert spark.read.parquet(with_vectors[0]).count() == 50  # no vector of a document without a label


def test_eval_rep_counts_each_text_once(spark, tmp_path, monkeypatch):
    from driftmark.operators import terms as T

    calls = []
    for name in ("word_terms", "char_wb_terms"):
        real = getattr(T, name)
        monkeypatch.setattr(T, name, lambda *a, real=real, name=name, **k: calls.append(name) or real(*a, **k))
    out = entry.queries()["eval_rep"](spark, small_tables(spark, tmp_path)).toPandas()
    assert sorted(zip(out["rep"], out["fold"])) == [(r, i) for r in ("char3", "word12") for i in range(5)]
    assert (out["f1"] > 0.99).all() and sorted(calls) == ["char_wb_terms", "word_terms"]
