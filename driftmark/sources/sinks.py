"""Writers and the audit of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_predictions(pred: DataFrame, path: str):
    pred.select("doc_id", "label").write.mode("overwrite").csv(path, header=True)


def write_scores(scores: DataFrame, path: str):
    scores.select("doc_id", "leg", "p").write.mode("overwrite").partitionBy("leg").parquet(path)


def write_metrics(metrics: DataFrame, path: str):
    metrics.write.mode("overwrite").json(path)


def write_folds(folds: DataFrame, path: str):
    folds.write.mode("overwrite").partitionBy("lens").parquet(path)


def verify_predictions(pred: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: counts, ids missing or unexpected, repeated ids, labels out of range."""
    both = (
        pred.select("doc_id", "label", F.lit(1).alias("got"), F.lit(0).alias("want"))
        .unionByName(expected.select(
            "doc_id", F.lit(None).cast("int").alias("label"), F.lit(0).alias("got"), F.lit(1).alias("want")))
        .groupBy("doc_id").agg(
            F.sum("got").alias("got"), F.sum("want").alias("want"),
            F.sum(F.when((F.col("got") == 1) & ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), 1).otherwise(0)).alias("bad"),
        )
    )
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(
        F.coalesce(F.sum("got"), F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce(F.sum("want"), F.lit(0)).cast("long").alias("n_expected"),
        one((F.col("want") > 0) & (F.col("got") == 0)).alias("missing_ids"),
        one((F.col("want") == 0) & (F.col("got") > 0)).alias("unexpected_ids"),
        one(F.col("got") > 1).alias("repeated_ids"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad_labels"),
    )
