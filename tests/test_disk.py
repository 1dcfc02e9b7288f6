"""What steps write to the work folder and how fits are laid out: tables several times the text must not come back."""

import os

import pandas as pd
from pyspark.sql import functions as F

from driftmark.operators import adapt as A
from driftmark.operators import linear as L
from driftmark.operators import ranks
from driftmark.operators import terms as T
from driftmark.plans import text as PT
from driftmark.session import together, work_folder


def folders(spark):
    at = work_folder(spark)
    return {f"{at}/{n}" for n in os.listdir(at)} if os.path.isdir(at) else set()


def corpus(n=40):
    word = ["apple", "pear", "plum", "fig", "kiwi", "lime", "cherry"]
    return [(i, " ".join(word[(i * k) % 7] for k in range(1, 9)), i % 2) for i in range(1, n + 1)]


def test_stacked_weights_write_no_counted_terms(spark, tmp_path):
    pd.DataFrame([(i, t, "en", "a") for i, t, _ in corpus()], columns=["doc_id", "text", "lang", "source"]).to_parquet(tmp_path / "documents.parquet")
    was = folders(spark)
    for query in (PT.tfidf_joint, PT.block_scale):
        assert query(spark, str(tmp_path)).count() > 0
    made = folders(spark) - was
    assert made and not any({"doc_id", "cnt"} <= set(spark.read.parquet(f).columns) for f in made)


def test_column_numbers_replace_terms_and_give_equal_vectors(spark):
    d = spark.createDataFrame(corpus(), "doc_id long, text string, label int")
    vocab = T.fit_vocab(T.word_terms(d), d)
    plain = {r.doc_id: r.features for r in L.vectors(d.select("doc_id"), T.weigh(T.word_terms(d), vocab)).collect()}
    was = folders(spark)
    at = L.indexed(vocab)
    long = T.weigh(T.word_terms(d), at)
    assert long.columns == ["doc_id", "block", "idx", "value"]
    got = {r.doc_id: r.features for r in L.vectors(d.select("doc_id"), long, at).collect()}
    assert got == plain
    assert not any(os.path.basename(f).startswith("long-") for f in folders(spark) - was)


def test_folds_dealt_before_the_vectors_are_those_dealt_after(spark):
    d = spark.createDataFrame(corpus(), "doc_id long, text string, label int")
    tr, tg = d.where("doc_id <= 24"), d.where("doc_id > 24")
    was = folders(spark)
    f = A.domain_features(tr, tg, min_df=2, folds=3)
    A.domain_scores(f, 3).count()
    made = [spark.read.parquet(x).columns for x in folders(spark) - was]
    assert sum("features" in c for c in made) == 1  # the vectors are written once
    late = ranks.stratified_kfold(f.drop("fold"), "domain", k=3, seed=13)
    same = f.select("doc_id", "fold").join(late.select("doc_id", F.col("fold").alias("g")), "doc_id").where("fold = g")
    assert same.count() == 40


def test_a_large_training_set_fits_in_at_most_one_partition_a_core(spark):
    cores = spark.sparkContext.defaultParallelism
    d = spark.range(100, numPartitions=5 * cores)
    assert L.packed(d, 10**9).rdd.getNumPartitions() == cores
    assert L.packed(d, 10).rdd.getNumPartitions() == 1


def test_calls_side_by_side_keep_their_order():
    assert together([lambda i=i: i * i for i in range(7)]) == [i * i for i in range(7)]
    assert together([lambda i=i: i for i in range(3)], 1) == [0, 1, 2]
