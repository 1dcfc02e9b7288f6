"""Tables that a second call finds again: keyed by a fingerprint of rows and settings, committed by one rename."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_base

#: Part of every key: raise it when a cached computation changes.
VERSION = 1


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows, whatever their order, partitions or files: their number and two sums of row hashes.

    One narrow aggregate; nothing but three numbers leaves the tasks. Columns count by name and type.
    """
    names = sorted(df.columns)
    row = [F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`").isNull() for c in names]).cast("decimal(38,0)") for seed in (1, 2)]
    got = df.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")) for h in row]).first()
    types = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return hashlib.sha1(json.dumps([types, [str(x) for x in got]]).encode()).hexdigest()


def _key(inputs: dict[str, DataFrame], settings: dict) -> str:
    what = {"version": VERSION, "settings": settings, "inputs": {k: fingerprint(v) for k, v in inputs.items()}}
    return hashlib.sha1(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, name: str, inputs: dict[str, DataFrame], settings: dict, build: Callable[[], DataFrame], root: str | None = None) -> DataFrame:
    """The table that ``build`` gives for these rows and settings: computed once, read by every later call.

    The folder's name holds the digests of all inputs and of the settings, so a changed row, type or setting is another
    table. It is written under a name of its own and appears by one rename: readers see all of it or nothing, two
    writers at once leave one of two equal tables, and a lost job leaves nothing that is ever read. ``root`` is storage
    that all executors share (default: beside the work folder, where later applications find it too). Inputs are read
    once for their digest; pass narrow ones. What ``build`` does must follow from inputs and settings alone.
    """
    folder = f"{root or shared_base(spark) + '/driftmark-cache'}/{name}-{_key(inputs, settings)}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        temp = f"{folder}.{uuid.uuid4().hex}.tmp"
        build().write.parquet(temp)
        if fs.exists(path(folder)) or not fs.rename(path(temp), path(folder)):
            fs.delete(path(temp), True)  # another call was first
    return spark.read.parquet(folder)
