"""Helpers of the corpus operators: Arrow-batched text functions and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import written

#: A word: a run without space and the ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts and bytes of text handled at once inside a task (one text at least); bounds its Python worker.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1024, 4 << 20


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def slices(batch: pa.RecordBatch, column: int, rows=ROWS_AT_ONCE, size=BYTES_AT_ONCE):
    """Parts of a batch of at most so many rows and bytes of ``column`` (one row at least)."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def map_texts(docs: DataFrame, make: Callable, ddl: str, keep=("doc_id",), text="text") -> DataFrame:
    """Columns ``keep`` plus those of ``ddl``, which ``make()(texts)`` computes a slice of texts at a time.

    ``make`` runs once in each task (it builds automata, patterns and tables there); what it returns takes
    an Arrow string array and gives one Arrow array or list per column. Nothing is shuffled.
    """
    spark = docs.sparkSession
    new = _parse_datatype_string(ddl)
    own = docs.select(*[F.col(k) for k in keep], F.col(text).cast("string").alias("__dm_text"))
    schema = StructType([StructField(f.name, f.dataType, True) for f in own.schema[:-1]] + new.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches):
        fn = make()
        for whole in batches:
            for b in slices(whole, n):
                got = fn(b.column(n))
                cols = [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(n + i).type) for i, x in enumerate(got)]
                yield pa.RecordBatch.from_arrays([b.column(i).cast(arrow.field(i).type) for i in range(n)] + cols, schema=arrow)

    return own.mapInArrow(run, schema)


def gathered(batches, column: int, size: int, rows=1 << 20):
    """Tables of about ``size`` bytes (at most so many rows) of ``column``: small batches joined, large ones cut."""
    held, total, n = [], 0, 0
    for whole in batches:
        for b in slices(whole, column, rows, size):
            held.append(b)
            total += pc.sum(pc.binary_length(b.column(column))).as_py() or 0
            n += b.num_rows
            if total >= size or n >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total, n = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def byte_classes(**members) -> np.ndarray:
    """Class of each byte: 0 part of a word, 1 between words (``between``), 2 a border (``border``)."""
    out = np.zeros(256, np.uint8)
    out[list(members.get("between", ()))] = 1
    out[list(members.get("border", ()))] = 2
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def byte_words(texts: pa.Array, classes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts in order (A-Z lower-cased), each word's text index, and whether a text or a border
    begins between it and the word before. Null texts are empty; only ASCII bytes may have a class over 0."""
    s = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(s.buffers()[1], np.int64)[s.offset:s.offset + len(s) + 1] if len(s) else np.zeros(1, np.int64)
    data = np.frombuffer(s.buffers()[2], np.uint8)[at[0]:at[-1]] if s.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    kind = classes[data]
    inside = kind == 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]]))])
    doc = np.searchsorted(at[1:], start, side="right")
    border = np.searchsorted(np.flatnonzero(kind == 2), start)
    apart = np.ones(len(start), bool)
    apart[1:] = (doc[1:] != doc[:-1]) | (border[1:] != border[:-1])
    return words, doc, apart


def drop(spark, folder: str) -> None:
    """Delete a folder of the work folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words_of(texts: pa.Array, lower=True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and each word's text index (null texts have none)."""
    s = texts.cast(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(s) if lower else s)
    words, at = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), at.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of each word and the distinct words."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def null_safe(left: DataFrame, right: DataFrame, keys, how="left") -> DataFrame:
    """Join on equal keys, null equal to null; the right side's keys are dropped."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = e if on is None else on & e
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def prefix_sums(df: DataFrame, group, order, sums: dict[str, str]) -> DataFrame:
    """For each ``name: column`` of ``sums``, ``name`` is the column's sum over the earlier rows of the group.

    Rows are range-sorted by (group, order), so a group of a third of all rows spans many partitions. Each
    partition's subtotals (at most groups + partitions rows) give its offsets; rows are ordered only inside
    a partition. ``order`` must tell the rows of a group apart, or tied rows get either place.
    """
    group = list(group)
    at = written(df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    parts = at.groupBy(*group, "_p").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    by = [F.col(g) for g in group] or [F.lit(0)]
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*group, "_p", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = null_safe(at, offsets, [*group, "_p"])
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_p", *[f"_o_{n}" for n in sums])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row per node with ``label``, the least node it reaches.

    Large-star and small-star steps by turns (minimum by partial aggregation, then a join that adaptive skew
    handling may split), each written, until the edge set no longer changes. Every table has at most one row
    per edge; nothing is collected but two numbers a round.
    """
    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(pairs, low):
        """Hang every ``b`` of a node on the node's minimum."""
        m = pairs.groupBy(F.col("a").alias("_n")).agg(F.min("b").alias("_m"))
        j = pairs.join(m, F.col("a") == F.col("_n")).withColumn("_m", F.least("a", "_m"))
        if low:
            return j.select(F.explode(F.array(F.struct("b", "_m"), F.struct(F.col("a").alias("b"), "_m"))).alias("x")).select("x.*")
        return j.where("b > a").select("b", "_m")

    tidy = lambda e: e.toDF("a", "b").where("a <> b").distinct()
    e = written(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    now = state(e)
    while now[0]:
        large = tidy(star(e.union(e.select("b", "a")), low=False))
        e = written(tidy(star(large, low=True)), "edges")
        before, now = now, state(e)
        if before == now:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
