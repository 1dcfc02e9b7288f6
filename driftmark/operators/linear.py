"""Bridge from long term tables to vectors, and the linear fits."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, together, with_stats, written

def column_index(long: DataFrame) -> DataFrame:
    """(block, term, idx): one column for each distinct term, counted from 0 in (block, term) order.

    The terms are range-sorted; the sizes of the ranges (as many rows as partitions) give their offsets, and
    rows are numbered only inside a range. No vocabulary reaches the driver.
    """
    terms = long.select("block", "term").distinct().repartitionByRange("block", "term")
    at = written(terms.withColumn("_p", F.spark_partition_id()), "terms")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = at.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select(
        F.col("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_p").orderBy("block", "term")
    return written(at.join(offsets, "_p").select(
        "block", "term", (F.col("_o") + F.row_number().over(inside) - 1).cast("long").alias("idx")), "index")


def indexed(vocab: DataFrame) -> DataFrame:
    """A fitted vocabulary with the column number of each term (``idx``), written once. ``terms.weigh`` carries the
    number into its rows, so ``vectors`` needs neither the terms nor another join."""
    return written(vocab.join(column_index(vocab), ["block", "term"]), "columns")


def vectors(docs: DataFrame, long: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """docs plus ``features``: one sparse vector per document with a column for each term of ``index``
    (by default of ``long``); terms without a column are left out, values of a repeated term are summed.
    Rows that carry ``idx`` (weighed under an ``indexed`` vocabulary, the ``index``) are neither written nor joined.

    A written table: the vector's fields are assembled by SQL functions and read back as MLlib's vector type, so no
    value passes a Python worker. One shuffle by document serves the sums and the arrays; a group is bounded by one
    document's terms. Terms that many documents hold are spread over several join keys. MLlib counts columns in 32 bits.
    """
    from .terms import salted_join

    if "idx" in long.columns:
        cells = long  # placed by document already (``terms.normalize``)
    else:
        long = written(long, "long")
        index = column_index(long) if index is None else index
        sizes = long.groupBy("block", "term").agg(F.count(F.lit(1)).alias("_n"))
        cells = salted_join(long, index, ("block", "term"), sizes, "doc_id").repartition("doc_id")
    dim = max(1, index.count())
    cells = cells.select("doc_id", F.col("idx").cast("int").alias("idx"), F.col("value").cast("double").alias("value"))
    summed = cells.groupBy("doc_id", "idx").agg(F.sum("value").alias("value"))
    rows = summed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("_c"))
    keep = [c for c in docs.columns if c != "features"]
    none = F.array().cast("array<struct<idx:int,value:double>>")
    at = docs.select(*keep).join(rows, "doc_id", "left").withColumn("_c", F.coalesce("_c", none))
    sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(dim).alias("size"),
                      F.col("_c.idx").alias("indices"), F.col("_c.value").alias("values"))
    out = at.select(*docs.select(*keep).columns, sparse.alias("features"))
    schema = T.StructType([*out.schema.fields[:-1], T.StructField("features", VectorUDT())])
    return written(out, "vectors", schema)


def dense_vectors(df: DataFrame, columns) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


#: The fields of a vector as SQL sees them.
VECTOR_FIELDS = T.StructType([T.StructField("type", T.ByteType()), T.StructField("size", T.IntegerType()),
                              T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])


def _moved(indices, by):
    return F.transform(indices, lambda i: i + by)


def joined_vectors(tables: dict) -> DataFrame:
    """Rows of the first table whose doc_id all tables hold, with the ``features`` of all end to end (a written table).

    SQL functions put the fields together. MLlib's VectorAssembler would name every column in the table's schema, and
    each step of a fit would carry these names to its tasks.
    """
    names = list(tables)
    out = None
    for name, df in tables.items():
        keep = ["doc_id"] if out is not None else [c for c in df.columns if c != "features"]
        v = df.select(*keep, F.col("features").alias(name))
        v = written(v, "view", T.StructType([*v.schema.fields[:-1], T.StructField(name, VECTOR_FIELDS)]))
        out = v if out is None else out.join(v, "doc_id")
    before, indices = F.lit(0), []
    for n in names:
        dense = F.col(f"{n}.type") == 1
        size = F.when(dense, F.size(f"{n}.values")).otherwise(F.col(f"{n}.size"))
        own = F.when(dense, F.sequence(F.lit(0), size - 1)).otherwise(F.col(f"{n}.indices"))
        indices.append(_moved(own, before))
        before = before + size
    whole = F.struct(F.lit(0).cast("byte").alias("type"), before.alias("size"), F.concat(*indices).alias("indices"),
                     F.concat(*[F.col(f"{n}.values") for n in names]).alias("values"))
    out = out.select(*[c for c in out.columns if c not in names], whole.alias("features"))
    return written(out, "joined", T.StructType([*out.schema.fields[:-1], T.StructField("features", VectorUDT())]))


@dataclass
class Linear:
    """A fitted linear model: ``score`` adds ``margin`` and, for logistic, ``p``."""

    kind: str
    model: Any

    def score(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in ("margin", "p")]
        out = self.model.transform(df.select(*keep))
        if self.kind == "ridge":
            return out.select(*keep, F.col("prediction").alias("margin"))
        raw = vector_to_array("rawPrediction")[1].alias("margin")
        if self.kind == "svm":
            return out.select(*keep, raw)
        return out.select(*keep, raw, vector_to_array("probability")[1].alias("p"))

    @property
    def coefficients(self):
        return self.model.coefficients.toArray()

    def save(self, folder: str) -> None:
        """Write the fitted model to a new folder."""
        self.model.write().save(folder)

    @classmethod
    def load(cls, kind: str, folder: str) -> Linear:
        return cls(kind, MODELS[kind].load(folder))


MODELS = {"ridge": MR.LinearRegressionModel, "logreg": MC.LogisticRegressionModel, "svm": MC.LinearSVCModel}


def weighted(df, label, weight, balanced):
    """Add ``_w`` (row weight times n / (2 n_c)) and return the per-class sums.

    One pass over the rows gives everything the penalties need: two rows of
    count, sum of weights and sum of squared weights.
    """
    out = df.withColumn("_w", (F.col(weight) if weight else F.lit(1.0)).cast("double"))
    rows = out.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("s"), F.sum(F.col("_w") * F.col("_w")).alias("q")).collect()
    n = sum(r["n"] for r in rows)
    factor = {r[label]: (n / (2.0 * r["n"]) if balanced else 1.0) for r in rows}
    sums = {r[label]: (factor[r[label]] * r["s"], factor[r[label]] ** 2 * r["q"]) for r in rows}
    f = F.lit(1.0)
    for value, c in factor.items():
        f = F.when(F.col(label) == value, F.lit(float(c))).otherwise(f)
    return out.withColumn("_w", F.col("_w") * f), n, sums


#: Solver steps allowed before a fit ends short of its tolerance; the hinge loss uses all it gets.
MAX_ITER = 50
FIT_ROWS = 2_000


def packed(d, n):
    """At most one partition a core, fewer for a small training set.

    Each solver step is one job in which every partition sends a dense vector of all columns, so more partitions than
    cores only add to what is shuffled and sent to the driver.
    """
    parts = max(1, -(-int(n) // FIT_ROWS))
    return d.coalesce(min(parts, d.sparkSession.sparkContext.defaultParallelism))


#: Columns up to which fits run side by side: a solver keeps some 25 dense vectors on the driver.
SIDE_BY_SIDE = 400_000


def fits_at_once(df) -> int:
    """How many fits on ``features`` may run side by side: three (some 240 MB of the driver), one for wider vectors."""
    row = df.select("features").first()
    return 3 if row is not None and row["features"].size <= SIDE_BY_SIDE else 1


def fit(kind, df, label="label", weight=None, balanced=True, C=1.0, alpha=0.9, max_iter=MAX_ITER) -> Linear:
    """``ridge`` (alpha), ``logreg`` or ``svm`` (C); penalties follow the summed-loss convention."""
    d, n, sums = weighted(df, label, weight, balanced)
    d = d.withColumn("_y", F.col(label).cast("double"))
    sw = sum(s for s, _ in sums.values())
    if kind == "ridge":
        d = d.withColumn("_y", 2.0 * F.col("_y") - 1.0)
        swy = sum((1 if y == 1 else -1) * s for y, (s, _) in sums.items())
        sw2 = sum(q for _, q in sums.values())
        s = np.sqrt(max(sw - swy * swy / sw, 0.0) / max(sw - sw2 / sw, 1e-12))
        est = MR.LinearRegression(
            featuresCol="features", labelCol="_y", weightCol="_w", standardization=False,
            elasticNetParam=0.0, solver="l-bfgs", regParam=alpha * s / sw, maxIter=max_iter, tol=1e-6)
    else:
        cls = MC.LogisticRegression if kind == "logreg" else MC.LinearSVC
        est = cls(featuresCol="features", labelCol="_y", weightCol="_w", standardization=False,
                  regParam=1.0 / (C * sw), maxIter=max_iter, tol=1e-6)
    return Linear(kind, est.fit(packed(d.select("features", "_y", "_w"), n)))


def linear_score(long, coefficients, intercept=0.0, on=("block", "term")) -> DataFrame:
    """X.w + b as a join with the coefficient table and one sum per document."""
    from .terms import salted_join

    if "df" in coefficients.columns:
        j = salted_join(long, coefficients.drop("df"), on, coefficients.select(*on, F.col("df").alias("_n")), "doc_id")
    else:
        j = long.join(coefficients, list(on))
    return j.groupBy("doc_id").agg((F.sum(F.col("value") * F.col("w")) + F.lit(float(intercept))).alias("margin"))


def logreg_gradient(long, labels, coefficients, l2=0.0) -> DataFrame:
    """One full-batch gradient of the mean logistic loss, per term."""
    m = linear_score(long, coefficients)
    docs = labels.join(m, "doc_id", "left").withColumn(
        "_e", 1.0 / (1.0 + F.exp(-F.coalesce("margin", F.lit(0.0)))) - F.col("label"))
    n = labels.agg(F.count(F.lit(1)).alias("_n"))
    g = long.join(docs.select("doc_id", "_e"), "doc_id").groupBy("block", "term").agg(
        F.sum(F.col("value") * F.col("_e")).alias("_g"))
    j = with_stats(g, n).join(coefficients.select("block", "term", "w"), ["block", "term"])
    return j.select("block", "term", (F.col("_g") / F.col("_n") + F.lit(float(l2)) * F.col("w")).alias("grad"))


def coefficient_table(spark, fitted: Linear, share=None) -> DataFrame:
    """(idx, w) rows, one per column; ``share`` interpolates each weight with the mean |w|."""
    w = fitted.coefficients
    if share is not None:
        w = (1.0 - share) * np.abs(w).mean() + share * w
    return spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(w), dtype="int32"), "w": w}))


def nbsvm(train_long, ratio, train_docs, C=1.0, share=None, estimator="svm"):
    """Fit on vectors scaled by the NB log-ratio; returns (scaler, scorer)."""
    from .terms import lookup

    def scaled(long):
        j = lookup(long, ratio)
        return j.select("doc_id", "block", "term", (F.col("value") * F.col("r")).alias("value"))

    index = column_index(ratio)
    fitted = fit(estimator, vectors(train_docs, scaled(train_long), index), C=C)
    b = float(fitted.model.intercept)
    coef = index.join(coefficient_table(train_docs.sparkSession, fitted, share), "idx").drop("idx")

    def score(long):
        return linear_score(scaled(long), coef, b)

    return scaled, score


def calibrate(scores, label="label", weight=None):
    """Platt scaling: a one-column logistic fit on out-of-fold margins."""
    vec = dense_vectors(scores, ["margin"])
    return fit("logreg", vec, label, weight, balanced=False, C=1e6)


class CalibratedEnsemble:
    """Pairs of a base fit and its calibrator; ``score`` averages the pairs' probabilities of rows none of them saw."""

    def __init__(self, pairs):
        self.pairs = pairs

    def score(self, df: DataFrame) -> DataFrame:
        p = []
        for i, (base, slope, intercept) in enumerate(self.pairs):
            df = base.score(df).drop("p").withColumnRenamed("margin", f"_m{i}")
            p.append(1.0 / (1.0 + F.exp(-(F.col(f"_m{i}") * slope + F.lit(intercept)))))
        mean = sum(p[1:], p[0]) / F.lit(float(len(p)))
        return df.withColumn("p", mean).drop(*[f"_m{i}" for i in range(len(p))])


def calibrated_cv(df, fit_fn, k=3, label="label", weight=None, fold="fold") -> CalibratedEnsemble:
    """Sigmoid calibration with cross-validation: for each of the ``k`` folds, ``fit_fn(other folds)`` and a sigmoid of
    its margins on that fold, weighted by ``weight`` (a column) where given. ``df`` has ``features`` and ``fold``."""
    pairs = []
    for i in range(k):
        base = fit_fn(df.where(F.col(fold) != i))
        model = calibrate(cut_lineage(base.score(df.where(F.col(fold) == i)).drop("features")), label, weight).model
        pairs.append((base, float(model.coefficients[0]), float(model.intercept)))
    return CalibratedEnsemble(pairs)


def ridge_path(df, columns, alphas, label="y", fold="fold") -> DataFrame:
    """Out-of-fold class-balanced ridge margins for every penalty, from one pass over the rows.

    A few dense columns: their sums and products per (fold, class) are all that the closed form needs, so one
    small aggregate serves every fold and penalty. Returns (alpha, label, margin), one row per row and penalty.
    """
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    d = len(cols)
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    rows = df.groupBy(fold, label).agg(*[F.sum(cols[i] * cols[j]).alias(f"s_{i}_{j}") for i, j in cells]).collect()
    gram = {}
    for r in rows:
        g = np.zeros((d, d))
        for i, j in cells:
            g[i, j] = g[j, i] = r[f"s_{i}_{j}"]
        gram[r[fold], r[label]] = g
    classes = sorted({y for _, y in gram})
    fits = []
    for held in sorted({f for f, _ in gram}):
        by_class = {y: sum((g for (f, c), g in gram.items() if f != held and c == y), np.zeros((d, d))) for y in classes}
        n = sum(g[0, 0] for g in by_class.values())
        a, b = np.zeros((d, d)), np.zeros(d)
        for y, g in by_class.items():
            if g[0, 0]:
                w = n / (2.0 * g[0, 0])
                a += w * g
                b += w * (2.0 * y - 1.0) * g[0]
        for alpha in alphas:
            coef = np.linalg.lstsq(a + np.diag([0.0] + [alpha] * (d - 1)), b, rcond=None)[0]
            fits.append((held, float(alpha), *map(float, coef)))
    names = [f"_c{i}" for i in range(d)]
    spark = df.sparkSession
    # folds x penalties rows
    table = spark.createDataFrame(fits, "_held int, alpha double, " + ", ".join(f"{n} double" for n in names))
    margin = sum((cols[i] * F.col(names[i]) for i in range(1, d)), F.col(names[0]))
    return df.join(F.broadcast(table), F.col(fold) == F.col("_held")).select("alpha", label, margin.alias("margin"))


def oof(df, fit_fn, fold="fold", k=5) -> DataFrame:
    """Out-of-fold scores: each row scored once, by a model that never saw it.

    ``fit_fn(train)`` returns an object with ``score``; there are k fits, a few at a time.
    """
    models = together([lambda i=i: fit_fn(df.where(F.col(fold) != i)) for i in range(k)], fits_at_once(df))
    out = None
    for i, model in enumerate(models):
        part = model.score(df.where(F.col(fold) == i)).drop("features")
        out = part if out is None else out.unionByName(part)
    return out
