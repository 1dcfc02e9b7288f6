"""Tables found again, histograms, cross-fitted counts, the back-off walk and wide correlations."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.operators import cache, langmodel, profile, ranks, trees
from driftmark.operators import terms as terms_module


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, f"text {i % 7}", i % 2) for i in range(50)] + [(99, None, None)], "doc_id long, text string, label int")


def test_second_call_finds_the_table_and_a_changed_row_does_not(spark, rows, tmp_path):
    fits = []

    def build(df):
        def run():
            fits.append(1)
            return df.groupBy("label").count()
        return run

    def call(df, **settings):
        return cache.cached(spark, "t", {"rows": df}, {"k": 3, **settings}, build(df), str(tmp_path))

    first = sorted(map(str, call(rows).collect()))
    assert len(fits) == 1
    for same in (rows, rows.repartition(7), rows.select("label", "text", "doc_id"), rows.orderBy(F.col("doc_id").desc())):
        assert sorted(map(str, call(same).collect())) == first
    assert len(fits) == 1  # zero fits on later calls, whatever the order and layout of the rows
    changed = rows.withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))
    for other in (changed, rows.union(rows.limit(1)), rows.where("doc_id <> 99"), rows.withColumn("label", F.col("label").cast("long")),
                  rows.withColumn("text", F.coalesce("text", F.lit("")))):
        before = len(fits)
        call(other)
        assert len(fits) == before + 1
    call(rows, k=4)
    assert len(fits) == 7
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]


def test_a_failed_build_leaves_nothing_to_find(spark, rows, tmp_path):
    def broken():
        return rows.select(F.raise_error(F.lit("lost")).alias("x"))

    with pytest.raises(Exception, match="lost"):
        cache.cached(spark, "t", {"rows": rows}, {}, broken, str(tmp_path))
    got = cache.cached(spark, "t", {"rows": rows}, {}, lambda: rows, str(tmp_path))
    assert got.count() == 51


def test_cached_query_refits_nothing(spark, monkeypatch):
    import __spark_entry__ as entry
    from driftmark.plans import learned

    sf = "/root/testdata/sf0.001"
    fits = []
    real = learned.oof_legs
    monkeypatch.setattr(learned, "oof_legs", lambda *a: fits.append(1) or real(*a))
    a, b = (sorted(map(str, entry.queries()["cache_oof"](spark, sf).collect())) for _ in range(2))
    assert a == b and len(fits) <= 1


def long_rows(spark, values):
    rng = np.random.default_rng(3)
    rows = [(f"f{j}", float(v), float(g), float(abs(g)) + 0.1) for j, vs in enumerate(values) for v, g in zip(vs, rng.normal(size=len(vs)) + np.sign(vs))]
    return spark.createDataFrame(rows, "feature string, value double, g double, h double")


def test_histogram_gain_equals_the_exact_one_when_bins_hold_one_value(spark):
    rng = np.random.default_rng(1)
    long = long_rows(spark, [rng.integers(-8, 9, 400), rng.integers(0, 2, 300), np.zeros(100)]).cache()
    values = long.select("feature", "value").distinct().groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("cuts"))
    exact = sorted(map(tuple, trees.split_gain(long, min_leaf=5).collect()))
    for cuts in (values, trees.quantile_cuts(long, 128)):
        assert sorted(map(tuple, trees.split_gain_hist(long, cuts, min_leaf=5).collect())) == exact
    assert len(exact) == 2


def test_histogram_sends_features_times_bins(spark):
    rng = np.random.default_rng(2)
    long = long_rows(spark, [rng.normal(size=5000), rng.exponential(size=5000)])
    hist = trees.histograms(long, trees.quantile_cuts(long, 16), 16)
    assert hist.count() == 32 and hist.agg(F.sum("n")).first()[0] == 10_000
    by_hand = hist.groupBy("feature").agg(F.min("n"), F.max("n")).collect()
    assert all(lo > 200 and hi < 450 for _, lo, hi in by_hand)


def test_cross_fitted_counts_equal_a_refit_per_fold(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 9)), int(i % 2), int(i % 3)) for i in range(60)], "doc_id long, text string, label int, fold int")
    terms = langmodel.bank_terms(docs, ("doc_id", "label")).join(docs.select("doc_id", "fold"), "doc_id").cache()
    got = {(r["fold"], r["block"], r["term"]): (r["df"], r["lp0"], r["lp1"]) for r in langmodel.bank_model_cross(terms).collect()}
    want = {}
    for fold in range(3):
        for r in langmodel.bank_model(terms.where(F.col("fold") != fold)).collect():
            want[fold, r["block"], r["term"]] = (r["df"], r["lp0"], r["lp1"])
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1:], want[k][1:]) for k in want)


def test_bank_sums_shuffle_no_terms_of_a_small_model(spark):
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(15)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 8)), int(i % 2)) for i in range(40)] + [(41, "", 0)], "doc_id long, text string, label int")
    terms = langmodel.counted_bank(docs)
    model = langmodel.bank_model(terms)
    want = {}
    lp = {(r["block"], r["term"]): (r["lp0"], r["lp1"]) for r in model.collect()}
    for r in terms.collect():
        if (r["block"], r["term"]) in lp:
            n, s = want.setdefault((r["doc_id"], r["block"]), [0, 0.0]), lp[r["block"], r["term"]]
            n[0], n[1] = n[0] + r["cnt"], n[1] + r["cnt"] * s[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    limit = terms_module.SMALL_ROWS
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = langmodel.bank_features(docs, terms, model)
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 4 and plan.count("SortMergeJoin") == 1  # one join with the documents
        terms_module.SMALL_ROWS = 0  # the same without a table sent to the tasks
        for rows in (small.collect(), langmodel.bank_features(docs, terms, model).collect()):
            assert sorted(r["doc_id"] for r in rows) == [*range(40), 41]
            for r in rows:
                for b in langmodel.BANK:
                    n, s0 = want.get((r["doc_id"], b), (0, 0.0))
                    assert math.isclose(r[f"{b}_lp0"], s0 / (n + 1e-9), abs_tol=1e-9)
    finally:
        terms_module.SMALL_ROWS = limit
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def backoff_by_hand(texts, windows):
    out = {}
    for label in (0, 1):
        grams = Counter()
        for t, y in texts:
            s = langmodel.START + t + langmodel.END
            if y == label:
                grams.update(s[i:i + n] for n in range(1, 5) for i in range(len(s) - n + 1))
        context = defaultdict(int)
        for g, c in grams.items():
            if len(g) > 1:
                context[g[:-1]] += c
        total = sum(c for g, c in grams.items() if len(g) == 1) + sum(len(g) == 1 for g in grams)
        for w in windows:
            p = next((0.4 ** (4 - n) * grams[w[-n:]] / context[w[-n:-1]] for n in (4, 3, 2) if len(w) >= n and grams[w[-n:]]), None)
            out.setdefault(w, []).append(math.log(0.4 ** 3 * (grams[w[-1]] + 1) / total if p is None else p))
    return out


def test_backoff_walk_equals_brute_force_with_hot_endings(spark):
    """Nearly all windows end alike, so one suffix would be the key of most rows; the walk crosses many ranges."""
    rng = np.random.default_rng(6)
    texts = [("".join(rng.choice(list("abe e e"), 40)), int(i % 2)) for i in range(20)] + [("é\U0001f600z" * 5, 0), ("q", 1), ("", 1)]
    train = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, label int")
    target = spark.createDataFrame([(i, "".join(rng.choice(list("abex e\U0001f600"), 30))) for i in range(20)] + [(50, "")], "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["window"]: (r["s0"], r["s1"]) for r in langmodel.backoff_scores(langmodel.windows(target), langmodel.backoff_tables(train)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = backoff_by_hand(texts, got)
    assert len(got) > 300
    assert all(np.allclose(got[w], want[w]) for w in got)


def test_correlation_of_many_columns_is_one_aggregate(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 60)) + 1e7
    x[:, 3] = 5.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i:02d} double" for i in range(60)))
    got = {(r["a"], r["b"]): r["corr"] for r in profile.pairwise_corr(df, df.columns).collect()}
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.nan_to_num(np.corrcoef(x.T))
    assert len(got) == 60 * 59 // 2
    assert max(abs(got[f"c{i:02d}", f"c{j:02d}"] - want[i, j]) for i in range(60) for j in range(i + 1, 60)) < 1e-7
    empty = profile.pairwise_corr(df.where("false"), ["c01", "c02"]).collect()
    assert [tuple(r) for r in empty] == [("c01", "c02", 0.0)]


def test_window_scores_meet_the_windows_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, f"some text {i % 5} of {i}", i % 2 if i < 20 else None) for i in range(30)], "doc_id long, text string, label int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    limit = terms_module.SMALL_ROWS
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = langmodel.perplexity_features(docs.where("label IS NULL"), docs.where("label IS NOT NULL"))
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
        terms_module.SMALL_ROWS = 0
        large = langmodel.perplexity_features(docs.where("label IS NULL"), docs.where("label IS NOT NULL"))
        a, b = ({r["doc_id"]: r for r in x.collect()} for x in (small, large))
        assert a.keys() == b.keys() and all(np.allclose(list(a[k]), list(b[k])) for k in a)
    finally:
        terms_module.SMALL_ROWS = limit
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
