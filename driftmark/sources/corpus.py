"""Readers: labelled and target corpora, dense features, paired corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import spread

CORPUS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_csv(spark, path, labelled=True) -> DataFrame:
    """``id,text[,label]`` with quoted, multi-line text and a declared schema."""
    schema = CORPUS_SCHEMA if labelled else T.StructType(CORPUS_SCHEMA.fields[:2])
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def clean_text(col="text"):
    """Missing text becomes the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def clean_number(col):
    """NULL, NaN and infinities become 0."""
    c = F.col(col).cast("double") if isinstance(col, str) else col.cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def documents(spark, folder) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", clean_text().alias("text"), "lang", "source")
    return spread(d, "doc_id")


def corpus(spark, folder) -> DataFrame:
    """Every document with its label, NULL for the target (unlabelled) ones."""
    y = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, folder).join(y, "doc_id", "left")


def labelled(spark, folder) -> DataFrame:
    return corpus(spark, folder).where(F.col("label").isNotNull())


def target(spark, folder) -> DataFrame:
    return corpus(spark, folder).where(F.col("label").isNull()).drop("label")


def features(spark, folder) -> DataFrame:
    """Dense feature rows: id, binary label and one array column."""
    e = table(spark, folder, "embeddings")
    kept = [c for c in e.columns if c not in ("vec_id", "label")]
    return e.select(
        F.col("vec_id"), (F.col("label") >= 5).cast("int").alias("label"),
        *[F.col(c).cast("array<double>").alias("x") for c in kept],
    )


def min_words(df, col="text", n=20):
    """Keep rows whose text has at least ``n`` whitespace tokens."""
    return df.where(F.size(X.tok_ws(F.col(col))) >= n)


def scan_paired(df, human="human_text", machine="machine_text", min_tokens=20) -> DataFrame:
    """Two text columns per row become two labelled rows; short texts and repeats go."""
    trim = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), rf"^{X.K.SPACE}+|{X.K.SPACE}+\z", "")
    long = df.select(
        F.explode(F.array(
            F.struct(F.lit(0).alias("label"), trim(human).alias("text")),
            F.struct(F.lit(1).alias("label"), trim(machine).alias("text")),
        )).alias("r")
    ).select("r.label", "r.text")
    kept = min_words(long, "text", min_tokens)
    return kept.groupBy("text").agg(F.min("label").alias("label"))


def seeded_sample(df, n, key="text", seed=42):
    """``n`` rows in md5 order: the sampling operator (a distributed top-k)."""
    return (
        df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
        .orderBy("_h", key).limit(n).drop("_h")
    )
