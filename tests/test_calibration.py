"""Cross-validated sigmoid calibration against a weighted closed form."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from driftmark.operators import linear as L


def frame(spark, rows):
    return spark.createDataFrame([(i, y, f, w, Vectors.dense([x])) for i, (x, y, f, w) in enumerate(rows)], ["doc_id", "label", "fold", "w", "features"])


class Identity:
    """A base fit whose margin is the one feature."""

    def score(self, df):
        from pyspark.ml.functions import vector_to_array

        return df.withColumn("margin", vector_to_array("features")[0])


def test_weights_change_the_result_as_the_closed_form_says(spark):
    # margins of 0 and 1 only: the sigmoid is saturated, so its value is the weighted share of ones at each margin
    cells = {(0.0, 1): 2, (0.0, 0): 6, (1.0, 1): 5, (1.0, 0): 3}
    rows = [(x, y, f, 3.0 if y else 1.0) for f in range(3) for (x, y), n in cells.items() for _ in range(n + f)]
    df, new = frame(spark, rows), frame(spark, [(0.0, 0, 0, 1.0), (1.0, 0, 0, 1.0)])
    for weight in (None, "w"):
        got = {r["doc_id"]: r["p"] for r in L.calibrated_cv(df, lambda t: Identity(), weight=weight).score(new).collect()}
        w = 3.0 if weight else 1.0
        for i, x in enumerate((0.0, 1.0)):
            share = [w * (cells[x, 1] + f) / (w * (cells[x, 1] + f) + cells[x, 0] + f) for f in range(3)]
            assert got[i] == pytest.approx(np.mean(share), abs=2e-3)


def test_real_base_fits_see_no_row_of_their_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(float(y + rng.normal() * 0.7), y, i % 3, 1.0) for i, y in enumerate(rng.integers(0, 2, 90).tolist())]
    seen = []

    def fit(train):
        seen.append({r[0] for r in train.select("fold").distinct().collect()})
        return L.fit("svm", train)

    got = L.calibrated_cv(frame(spark, rows), fit).score(frame(spark, [(-1.0, 0, 0, 1.0), (2.0, 0, 0, 1.0)])).orderBy("doc_id").collect()
    assert seen == [{1, 2}, {0, 2}, {0, 1}] and 0 < got[0]["p"] < 0.4 < 0.6 < got[1]["p"] < 1
    assert got[0].asDict().keys() == {"doc_id", "label", "fold", "w", "features", "p"}
