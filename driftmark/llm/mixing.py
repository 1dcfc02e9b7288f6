"""Mixing sources to target weights: hash-random order, prefix sums of word counts, exact budget cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_stats, written
from . import common as C


def targets(sizes: DataFrame, weights=(5, 2, 1), share=1.5, most=2) -> DataFrame:
    """One row per source (``source``, ``source_size``) with its ``target`` in words.

    Sources in code-point order, null last, take the weights in turn. With caps ``most * source_size`` the
    water level L solves sum(min(w * L, cap)) = share * total. As that sum is at most (caps of any set +
    L * weights of the rest), L is the largest (budget - caps before k) / (weights from k on) over the
    sources ordered by cap / weight: two prefix sums and a maximum instead of rounds of resharing.
    """
    at = C.prefix_sums(sizes.withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1)),
                       [], ["_null", "source"], {"_rank": "_one"})
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    capped = written(at.select("source", "source_size", "_rank", w.cast("long").alias("_w"),
                               (F.col("source_size") * most).alias("_cap")), "capped")
    capped = capped.withColumn("_at", F.col("_cap").cast("double") / F.col("_w"))
    total = capped.agg(F.sum("source_size").alias("_total"), F.sum("_w").alias("_all"))
    level = with_stats(C.prefix_sums(capped, [], ["_at", "_rank"], {"_caps": "_cap", "_ws": "_w"}), total).agg(
        F.max((F.col("_total") * F.lit(float(share)) - F.col("_caps")) / (F.col("_all") - F.col("_ws"))).alias("_level"))
    return with_stats(capped, level).select(
        "source", "source_size",
        F.least(F.col("_cap").cast("double"), F.col("_w") * F.coalesce("_level", F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), share=1.5, most=2, seed="mix", key="doc_id", source="source", text="text") -> DataFrame:
    """One row per document: its ``size`` in words, ``source_size``, ``target`` and the words ``taken``.

    A source gives as many whole epochs as its target holds, and one more cut at the exact budget: documents
    stand in the order of md5(seed:id), their sizes are summed along it, and the document at the budget
    gives its first words only. So the taken words of a source are its target, rounded down.

    Null texts have size 0; null sources are one source; null ids stand in one place of the order. Rows that
    agree in id, source and size share a cut evenly (less than one word of each is lost). An empty table
    gives no rows. Other columns are not read. Reruns agree: nothing depends on the layout of the files.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"))
    units = written(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_m")).select(
        "*", (F.col("size") * F.col("_m")).alias("_words"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_h")), "sizes")
    goal = written(targets(units.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most), "targets")
    at = C.prefix_sums(units, ["source"], ["_h", "doc_id", "size"], {"_before": "_words"})
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    cut = F.greatest(F.lit(0), F.least(budget - F.col("_epochs") * F.col("source_size") - F.col("_before"), F.col("_words")))
    out = C.null_safe(at, goal, ["source"]).withColumn("_epochs", epochs).withColumn("_part", F.floor(cut / F.col("_m")).cast("long"))
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_m")))).select(
        "doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + F.col("_part")).alias("taken"), "source")


def mixed(docs: DataFrame, key="doc_id", source="source", text="text", **options) -> DataFrame:
    """The mix itself: the columns of ``docs`` once per epoch, with ``mix_epoch`` and ``mix_words``.

    Documents without words are in no epoch. The one document cut at a source's budget keeps its first
    ``mix_words`` words (and its n_chars, where there is one, follows). Columns of these two names that ``docs`` has
    already (the mix of a mix) give way to the new ones.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD)), F.lit(0)).cast("long")
    plan = mix(docs, key=key, source=source, text=text, **options).where("taken > 0").select(
        F.col("doc_id").alias("__dm_id"), F.col("source").alias("__dm_source"), F.col("size").alias("__dm_size"),
        F.col("taken").alias("__dm_taken")).distinct()
    rows = docs.withColumn("__dm_n", size)
    on = F.col(key).eqNullSafe(F.col("__dm_id")) & F.col(source).eqNullSafe(F.col("__dm_source")) & (F.col("__dm_n") == F.col("__dm_size"))
    rows = rows.join(plan, on).withColumn("__dm_epoch", F.explode(F.sequence(F.lit(0), F.expr("cast((__dm_taken - 1) div __dm_size as int)"))))
    rows = rows.withColumn("__dm_words", F.least(F.col("__dm_size"), F.col("__dm_taken") - F.col("__dm_epoch") * F.col("__dm_size")))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + C.WORD), F.lit(0)), F.lit(1), F.col("__dm_words").cast("int")), "")
    rows = rows.withColumn(text, F.when(F.col("__dm_words") < F.col("__dm_size"), head).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__dm_words") < F.col("__dm_size"), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    own = [c for c in docs.columns if c not in ("mix_epoch", "mix_words")]
    return rows.select(*own, F.col("__dm_epoch").alias("mix_epoch"), F.col("__dm_words").alias("mix_words"))


#: What the operator returns under its default parameters.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s0),
s2 AS (SELECT *, [5, 2, 1][rk % 3 + 1]::BIGINT AS w, source_size * 2 AS cap FROM s1),
s3 AS (SELECT *, cap::DOUBLE / w AS r, sum(source_size) OVER () AS total, sum(w) OVER () AS ws FROM s2),
s4 AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS caps, coalesce(sum(w) OVER b, 0) AS wb FROM s3
  WINDOW b AS (ORDER BY r, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT max((total * 1.5::DOUBLE - caps) / (ws - wb)) AS level FROM s4),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * coalesce(level, 0)) AS target FROM s3, lv),
o AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
  ((CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
   + greatest(0, least(budget - (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * source_size - before, size)))::BIGINT AS taken
FROM o"""
