"""Search over representations and saved models."""

from pyspark.sql import functions as F

from driftmark.operators import linear as L
from driftmark.operators import search as SE
from driftmark.operators import terms as T


def corpus(spark):
    rows = [(i, f"common {'good fine' if i % 2 else 'bad poor'} word{i % 7} rare{i}", i % 2) for i in range(36)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_dropped_words_cost_their_score(spark):
    d = corpus(spark)
    told = spark.createDataFrame([("w", t) for t in ("good", "fine", "bad", "poor")], "block string, term string")
    rules = {"all": ("w", SE.without(None)), "told": ("w", SE.without(told)), "share": ("w", SE.without(None, max_df=0.9))}
    s = SE.fold_scores(d, rules, {"svm": lambda x: L.fit("svm", x)}, {"w": T.word_terms(d)}, k=2)
    got = {(r.vocabulary, r.fold): r for r in s.collect()}
    assert len(got) == 6
    for i in range(2):
        assert got["all", i].f1 == 1 and got["told", i].f1 < 1
        assert got["told", i].n_terms == got["all", i].n_terms - 4  # fitted on the training side: no rare word is in two rows
        assert got["share", i].n_terms == got["all", i].n_terms - 1  # "common"
    place = SE.ranked(s).orderBy("rank").collect()
    assert [r.rank for r in place] == [1, 2, 3] and place[-1].vocabulary == "told"


def test_saved_models_score_equally(spark, tmp_path):
    d = corpus(spark)
    v = L.vectors(d.select("doc_id", "label"), T.weigh(T.word_terms(d), T.fit_vocab(T.word_terms(d), d)))
    for kind in ("ridge", "logreg", "svm"):
        m = L.fit(kind, v)
        m.save(str(tmp_path / kind))
        again = L.Linear.load(kind, str(tmp_path / kind))
        score = lambda x: {r.doc_id: r.margin for r in x.score(v).select("doc_id", F.col("margin")).collect()}
        assert score(m) == score(again)
