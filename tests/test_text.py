import gzip
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftmark.functions import constants as K
from driftmark.functions import style as S
from driftmark.functions import text as X
from driftmark.operators import terms as T


def one(spark, text, col):
    return spark.createDataFrame([(1, text)], "doc_id long, text string").select(col.alias("v")).first()["v"]


def test_counts_and_document_frequency(micro):
    f = {r["term"]: r["df"] for r in T.doc_freq(T.word_terms(micro.where("label IS NOT NULL"))).collect()}
    assert len(f) == 9
    assert {t for t, d in f.items() if d == 2} == {"the", "ran", "model"}


def test_tfidf_of_the_first_document(micro):
    tr = micro.where("label IS NOT NULL")
    t = T.word_terms(tr)
    v = T.weigh(t, T.fit_vocab(t, tr, min_df=1)).where("doc_id = 1")
    got = {r["term"]: round(r["value"], 6) for r in v.collect()}
    assert got == {"the": 0.521227, "cat": 0.685351, "sat": 0.40478, "ran": 0.307845}


def test_vocabulary_is_fitted_on_training_text_only(micro):
    tr = micro.where("doc_id IN (1, 2)")
    t = T.weigh(T.word_terms(micro), T.fit_vocab(T.word_terms(tr), tr, min_df=1))
    assert "model" in {r["term"] for r in t.where("doc_id = 3").collect()}
    assert {r["term"] for r in T.weigh(T.word_terms(micro), T.fit_vocab(T.word_terms(tr), tr, min_df=2)).collect()} == set()


def python_char_wb(text, lo, hi):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in range(lo, hi + 1):
            k = max(len(w) - n + 1, 1)
            out += [w[i:i + n] for i in range(k)]
            if len(w) <= n:
                break
    return Counter(out)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\nz.é\U0001F600", max_size=30), min_size=1, max_size=20))
def test_char_ngrams_match_a_plain_loop(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for lo, hi in ((2, 4), (4, 5)):
        got = {}
        for r in T.char_wb_terms(df, lo, hi).collect():
            got.setdefault(r["doc_id"], Counter())[r["term"]] = r["cnt"]
        for i, t in enumerate(texts):
            assert got.get(i, Counter()) == python_char_wb(t, lo, hi), (t, lo, hi)


def test_short_chunks_can_be_dropped(spark):
    df = spark.createDataFrame([(1, "a be")], "doc_id long, text string")
    drop = {r["term"] for r in T.char_wb_terms(df, 3, 4, short="drop").collect()}
    assert drop == {" a ", " be", "be ", " be "}


def test_word_ngrams_and_filter(spark):
    df = spark.createDataFrame([(1, "the big cat")], "doc_id long, text string")
    t = T.word_terms(df, 1, 2, unigram_filter=lambda w: w != "the")
    assert {r["term"] for r in t.collect()} == {"big", "cat", "the big", "big cat"}


def test_sliding_starts(spark):
    s = lambda stride: spark.range(1).select(X.window_starts(F.lit(10), 4, stride).alias("v")).first()["v"]
    assert s(2) == [0, 2, 4, 6] and s(4) == [0, 4, 6]


def test_views(spark):
    text = "The NASA team's Results are 42. Moving quickly, it works."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    mixed = df.select(X.tok_mixed(F.col("text"), "digit").alias("k"), X.tok_mixed(F.col("text"), "view").alias("v"))
    r = mixed.select(
        X.view_shape(F.col("k")).alias("shape"), X.view_pos(F.col("k")).alias("pos"), X.view_func(F.col("v")).alias("func"),
        X.view_skeleton(F.col("k"), mask="initial").alias("skel")).first()
    assert r["shape"] == "C U team's C w 0 . C w , w w ."
    assert r["pos"] == "FW NNP NNS FW FW CD . VBG RB , FW NNS ."
    assert r["func"] == "the X X results are X . X X , it X ."
    assert r["skel"] == "the # # results are 42 . # # , it # ."
    assert one(spark, "Ab 1é\t-", X.view_charclass(F.col("text"))) == "aa_9a_-"


def test_style_of_the_first_document(micro):
    r = S.style14(micro.where("doc_id = 1")).first()
    assert r["avg_word_len"] == 3.0 and r["word_len_std"] == 0.0
    assert round(r["type_token_ratio"], 6) == 0.666667 and r["avg_sentence_len"] == 3.0
    assert round(S.style18(micro.where("doc_id = 1")).first()["hapax_ratio"], 6) == 0.333333


def test_texts_without_words_keep_their_row(spark):
    df = spark.createDataFrame([(1, ""), (2, "!!!")], "doc_id long, text string")
    for fn in (S.style14, S.style_extra4, S.style18, S.style30):
        rows = fn(df).collect()
        assert len(rows) == 2 and all(v == 0 for r in rows for v in list(r)[1:])
    assert all(sum(r["style"]) == 0 and len(r["style"]) == 227 for r in S.style227(df).collect())
    assert T.word_terms(df).count() == 0


def test_function_word_list_is_complete():
    assert len(K.FUNCTION_WORDS) == len(set(K.FUNCTION_WORDS)) == 197


def test_compression_ratio(spark):
    text = "abc " * 200
    got = one(spark, text, S.compress_ratio("text"))
    assert got == pytest.approx(len(gzip.compress(text.encode(), 4)) / len(text.encode()))


def test_normalised_duplicate_key(spark):
    assert one(spark, "  X \n y ", X.normalize_text(F.col("text"))) == re.sub(r"\s+", " ", "  X \n y ".strip().lower())
