"""Session set-up and the two physical helpers every family shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app="driftmark", master=None, **conf):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with too few splits one partition per core, hashed on ``key``.

    A large table already arrives in many splits and is returned as it is, so
    nothing is shuffled; a one-file table would otherwise run on one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def shared_base(spark: SparkSession) -> str:
    """Storage that all executors share: ``spark.checkpoint.dir``; where it is unset (tests, a plain local
    session) the checkpoint folder set on the context, else the SQL warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables."""
    return f"{shared_base(spark)}/driftmark-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name="t") -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name="t", schema=None) -> DataFrame:
    """Write ``df`` to the work folder and read it back: cuts the lineage, keeps pruning and size estimates.

    ``schema`` reads the same columns as other types with equal storage (a struct as a vector).
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(schema or df.schema).parquet(folder)


def clear_work(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it once their results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def together(calls, at_once=3) -> list:
    """Results of independent calls, a few at a time: a small solver step leaves most cores idle."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    if at_once < 2 or len(calls) < 2:
        return [call() for call in calls]
    spark = SparkSession.getActiveSession()
    target = inheritable_thread_target(spark) if spark else lambda call: call
    with ThreadPool(min(at_once, len(calls))) as pool:
        waiting = [pool.apply_async(target(call)) for call in calls]
        return [w.get() for w in waiting]


def cut_lineage(df: DataFrame) -> DataFrame:
    """A written copy; later reads prune columns and push filters."""
    return written(df, "cut")


def with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate as a scalar subquery (no join)."""
    from pyspark.sql import functions as F

    one = stats.select(F.struct(*stats.columns).alias("_s")).scalar()
    return df.select("*", one.alias("_s")).select(
        *df.columns, *[F.col(f"_s.{c}").alias(c) for c in stats.columns]
    )
