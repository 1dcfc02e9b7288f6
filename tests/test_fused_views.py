"""Vectors of several views end to end."""

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from driftmark.operators import adapt


def test_fused_views_join_vectors_without_naming_their_columns(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("features", VectorUDT())])
    rows = lambda d: spark.createDataFrame([(k, y, v) for k, (y, v) in d.items()], schema)
    word = rows({1: (0, Vectors.sparse(4, {1: 2.0, 3: 5.0})), 2: (1, Vectors.sparse(4, [], [])), 3: (1, Vectors.sparse(4, {0: 1.0}))})
    char = rows({1: (0, Vectors.dense([7.0, 0.0, 8.0])), 2: (1, Vectors.sparse(3, {2: 9.0}))})
    train, pool = adapt.fused_views({"word": (word, word.drop("label")), "char": (char, char.drop("label"))})
    assert train.columns == ["doc_id", "label", "features"] and pool.columns == ["doc_id", "features"]
    for t in (train, pool):
        got = {r["doc_id"]: r["features"].toArray().tolist() for r in t.collect()}
        assert got == {1: [0, 2, 0, 5, 7, 0, 8], 2: [0, 0, 0, 0, 0, 0, 9]}
        assert not t.schema["features"].metadata
