"""Stylometric column blocks. Each needs no shuffle: a document is one row.

``annotate`` projects the shared arrays once; the blocks are arithmetic on them.
Documents without words get zero in every column.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K
from .text import find_all, safe_div, tok_alnum, tok_alpha, word_ngrams


def _sum(arr):
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def mean_of(arr):
    return safe_div(_sum(arr), F.size(arr))


def std_of(arr, mean):
    """Population standard deviation given the mean column."""
    dev = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.sqrt(safe_div(dev, F.size(arr)))


def share(words, predicate):
    return safe_div(F.size(F.filter(words, predicate)), F.size(words))


def in_list(words):
    listed = F.array(*[F.lit(w) for w in words])
    return lambda t: F.array_contains(listed, t)


def count_of(text, pattern):
    return F.regexp_count(text, F.lit(pattern))


def syllables(word):
    """Vowel groups, at least one."""
    return F.greatest(F.lit(1), count_of(word, K.VOWELS))


def sentences(text):
    """Non-blank pieces between sentence ends."""
    return F.filter(F.split(text, K.SENTENCE_END), lambda s: s.rlike(K.NOT_SPACE))


def bigrams(low):
    return word_ngrams(low, 2, "_")


def runs_of_one_and_two(s):
    """How many values occur exactly once, and exactly twice, in a sorted array.

    The array is zipped with itself shifted, so no lambda refers to a column and
    a pushed-down filter costs one more evaluation at most.
    """
    n = F.size(s)
    before = F.concat(F.array(F.lit(None).cast("string")), s)
    starts = F.zip_with(s, before, lambda x, p: F.when(~x.eqNullSafe(p), x))
    differs = lambda arr, shift: F.zip_with(arr, F.slice(s, shift, n), lambda x, q: F.when(~x.eqNullSafe(q), x))
    pair = F.zip_with(starts, F.slice(s, 2, n), lambda x, q: F.when(x == q, x))
    found = lambda arr: F.size(F.filter(arr, lambda x: x.isNotNull()))
    return found(differs(starts, 2)), found(differs(pair, 3))


def annotate(df: DataFrame, words="alnum") -> DataFrame:
    """Add token, sentence and run-length arrays for the style blocks."""
    tok = tok_alnum if words == "alnum" else tok_alpha
    pattern = K.ALNUM_WORD if words == "alnum" else K.ALPHA_WORD
    out = df.withColumn("_w", tok(F.col("text"))).withColumn(
        "_sent", sentences(F.col("text"))
    )
    out = out.select(
        "*",
        F.transform("_w", lambda w: F.lower(w)).alias("_low"),
        F.transform("_w", lambda w: F.length(w).cast("double")).alias("_wl"),
        F.transform("_sent", lambda s: count_of(s, pattern).cast("double")).alias("_sl"),
    )
    out = out.select(
        "*",
        F.sort_array("_low").alias("_sorted"),
        bigrams(F.col("_low")).alias("_bi"),
        F.when(F.size("_sl") > 0, F.col("_sl"))
        .otherwise(F.array(F.size("_w").cast("double"))).alias("_sl1"),
        mean_of(F.col("_wl")).alias("_wmean"),
    )
    once, twice = runs_of_one_and_two(F.col("_sorted"))
    return out.select(
        "*",
        F.size("_w").alias("_n"),
        F.length("text").alias("_chars"),
        once.alias("_hapax"),
        twice.alias("_dis"),
        mean_of(F.col("_sl1")).alias("_smean"),
    )


ANNOTATIONS = ["_w", "_sent", "_low", "_wl", "_sl", "_sorted", "_bi", "_sl1", "_wmean",
               "_n", "_chars", "_hapax", "_dis", "_smean"]


def _finish(df, keep, cols, block):
    """Zero every column of a document without words."""
    return df.select(
        *keep,
        *[F.when(F.col("_n") > 0, cols[c].cast("double")).otherwise(F.lit(0.0)).alias(c) for c in block],
    )


def style14_columns():
    t, w, low, n = F.col("text"), F.col("_w"), F.col("_low"), F.col("_n")
    stop = in_list(K.STOPWORDS_STYLE14)
    content = F.transform(F.filter(low, lambda x: ~stop(x)), lambda x: F.length(x).cast("double"))
    per_sentence = safe_div(n, F.greatest(F.lit(1), F.size("_sent")))
    chars = F.greatest(F.lit(1), F.col("_chars"))
    return {
        "avg_word_len": F.col("_wmean"),
        "word_len_std": std_of(F.col("_wl"), F.col("_wmean")),
        "big_word_ratio": share(F.col("_wl"), lambda x: x > 7),
        "very_big_word_ratio": share(F.col("_wl"), lambda x: x > 10),
        "avg_content_word_len": mean_of(content),
        "avg_sentence_len": per_sentence,
        "type_token_ratio": safe_div(F.size(F.array_distinct(low)), n),
        "avg_syllables_per_word": mean_of(F.transform(w, lambda x: syllables(x).cast("double"))),
        "stopword_ratio": share(low, stop),
        "punct_density": safe_div(count_of(t, r"""[.,;:!?\-—()"']"""), chars),
        "commas_per_word": safe_div(count_of(t, ","), n),
        "digit_density": safe_div(count_of(t, r"\p{Nd}"), chars),
        "upper_density": safe_div(count_of(t, r"\p{Lu}"), chars),
        "long_sentence_flag": (per_sentence > 25).cast("double"),
    }


def style_extra4_columns():
    t, n = F.col("text"), F.col("_n")
    paragraphs = F.filter(F.split(t, "\n"), lambda p: p.rlike(K.NOT_SPACE))
    return {
        "sentence_len_std": std_of(F.col("_sl1"), F.col("_smean")),
        "unique_bigram_ratio": safe_div(F.size(F.array_distinct("_bi")), F.size("_bi")),
        "avg_paragraph_len": safe_div(n, F.greatest(F.lit(1), F.size(paragraphs))),
        "exclaim_question_ratio": safe_div(count_of(t, "[!?]"), n),
    }


def style18_columns():
    t, n, chars = F.col("text"), F.col("_n"), F.col("_chars")
    alpha = F.greatest(F.lit(1), count_of(t, r"\p{L}"))
    return {
        "n_chars": chars,
        "n_words": n,
        "avg_word_len": F.col("_wmean"),
        "word_len_std": std_of(F.col("_wl"), F.col("_wmean")),
        "type_token_ratio": safe_div(F.size(F.array_distinct("_low")), n),
        "n_sentences": F.size("_sent"),
        "avg_sent_len": F.col("_smean"),
        "sent_len_std": std_of(F.col("_sl1"), F.col("_smean")),
        "comma_density": safe_div(count_of(t, ","), n),
        "period_density": safe_div(count_of(t, r"\."), n),
        "semicolon_density": safe_div(count_of(t, ";"), n),
        "paren_density": safe_div(count_of(t, "[()]"), n),
        "digit_ratio": safe_div(count_of(t, r"\p{Nd}"), chars),
        "upper_ratio": safe_div(count_of(t, r"\p{Lu}"), alpha),
        "stopword_ratio": share(F.col("_low"), in_list(K.STOPWORDS_STYLE18)),
        "unique_bigram_ratio": safe_div(F.size(F.array_distinct("_bi")), F.size("_bi")),
        "hapax_ratio": safe_div(F.col("_hapax"), n),
        "exclaim_question_ratio": safe_div(count_of(t, "[!?]"), n),
    }


def style30_columns():
    t, n, chars, low = F.col("text"), F.col("_n"), F.col("_chars"), F.col("_low")
    alpha = count_of(t, r"\p{L}")
    sd = std_of(F.col("_sl1"), F.col("_smean"))
    base = style18_columns()
    extra = {
        "dis_legomena_ratio": safe_div(F.col("_dis"), n),
        "sent_len_cv": safe_div(sd, F.col("_smean")),
        "n_sentences_per_100w": safe_div(F.size("_sent") * 100.0, n),
        "colon_density": safe_div(count_of(t, ":"), n),
        "quote_density": safe_div(count_of(t, "[\"']"), n),
        "dash_density": safe_div(count_of(t, "[-—]"), n),
        "question_density": safe_div(count_of(t, r"\?"), n),
        "exclaim_density": safe_div(count_of(t, "!"), n),
        "alpha_ratio": safe_div(alpha, chars),
        "space_ratio": safe_div(count_of(t, K.SPACE), chars),
        "punct_ratio": safe_div(
            count_of(t, r"[^\p{L}\p{N}\t-\r\x1c-\x1f\x{85}\p{Z}]"), chars),
        "short_word_ratio": share(F.col("_wl"), lambda x: x <= 3),
        "long_word_ratio": share(F.col("_wl"), lambda x: x >= 8),
        "hedge_ratio": share(low, in_list(K.HEDGES)),
        "be_ratio": share(low, in_list(K.BE_FORMS)),
        "by_ratio": share(low, lambda x: x == "by"),
        "stopword_mass": share(low, in_list(K.FUNCTION_WORDS)),
    }
    return {**base, **extra}


def sentence6_columns():
    lens = F.transform("_sent", lambda s: F.size(find_all(s, K.NOT_SPACE + "+")).cast("double"))
    clauses = F.transform("_sent", lambda s: (count_of(s, "[,;:]") + 1).cast("double"))
    return lens, clauses


def style14(df, keep=("doc_id",)):
    return _finish(annotate(df, "alpha"), keep, style14_columns(), K.STYLE14)


def style_extra4(df, keep=("doc_id",)):
    return _finish(annotate(df, "alpha"), keep, style_extra4_columns(), K.STYLE_EXTRA4)


def style18(df, keep=("doc_id",)):
    return _finish(annotate(df), keep, style18_columns(), K.STYLE18)


def style10_robust(df, keep=("doc_id",)):
    kept = [c for c in K.STYLE18 if c not in K.STYLE18_LENGTH_BOUND]
    return _finish(annotate(df), keep, style18_columns(), kept)


def style30(df, keep=("doc_id",)):
    return _finish(annotate(df), keep, style30_columns(), K.STYLE30)


def function_words(df, words=K.FUNCTION_WORDS, keep=("doc_id",)):
    """Long (keep, word, freq): relative frequency of each listed word present."""
    from .text import count_terms

    listed = F.array(*[F.lit(w) for w in words])
    toks = df.select(*keep, tok_alnum(F.col("text")).alias("_w")).select(
        *keep, F.size("_w").alias("_n"),
        F.filter(F.transform("_w", lambda w: F.lower(w)), lambda w: F.array_contains(listed, w)).alias("terms"),
    )
    return count_terms(toks, keep=[*keep, "_n"]).select(
        *keep, F.col("term").alias("word"), safe_div(F.col("cnt"), F.col("_n")).alias("freq")
    )


def style227(df, words=K.FUNCTION_WORDS, keep=("doc_id",)):
    """Dense array: the listed words' frequencies followed by the 30 structural columns."""
    out = annotate(df)
    listed = F.array(*[F.lit(w) for w in words])
    out = out.withColumn("_hits", F.filter("_low", lambda w: F.array_contains(listed, w)))
    fw = F.transform(
        listed,
        lambda w: safe_div(F.size(F.filter(F.col("_hits"), lambda x: x == w)), F.col("_n")),
    )
    st = style30_columns()
    dense = F.concat(fw, F.array(*[st[c].cast("double") for c in K.STYLE30]))
    zero = F.array_repeat(F.lit(0.0), len(words) + len(K.STYLE30))
    return out.select(*keep, F.when(F.col("_n") > 0, dense).otherwise(zero).alias("style"))


def sentence6(df, keep=("doc_id",)):
    out = df.select(*keep, sentences(F.col("text")).alias("_sent"))
    lens, clauses = sentence6_columns()
    out = out.select("*", lens.alias("_len"), clauses.alias("_cl"))
    out = out.select("*", mean_of(F.col("_len")).alias("_lm"), mean_of(F.col("_cl")).alias("_cm"))
    return out.select(
        *keep,
        F.size("_sent").cast("double").alias("n_sentences"),
        F.col("_lm").alias("sent_words_mean"),
        std_of(F.col("_len"), F.col("_lm")).alias("sent_words_std"),
        F.col("_cm").alias("clauses_mean"),
        std_of(F.col("_cl"), F.col("_cm")).alias("clauses_std"),
        share(F.col("_len"), lambda x: x > 30).alias("long_sentence_share"),
    )


def surface15(df, keep=("doc_id",)):
    t = F.col("text")
    out = df.select(*keep, "text", tok_alnum(t).alias("_w"))
    nw, chars = F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.length(t), F.lit(1))
    cols = {
        "len_chars": F.length(t),
        "len_words": F.size("_w"),
        "avg_wlen": mean_of(F.transform("_w", lambda x: F.length(x).cast("double"))),
        "n_commas": count_of(t, ","),
        "n_semicolon": count_of(t, ";"),
        "n_emdash": count_of(t, "[—–]"),
        "n_hyphen": count_of(t, "-"),
        "n_paren": count_of(t, r"\("),
        "uniq_ratio": safe_div(F.size(F.array_distinct(F.transform("_w", lambda x: F.lower(x)))), nw),
        "digit_frac": safe_div(count_of(t, r"\p{Nd}"), chars),
        "upper_frac": safe_div(count_of(t, r"\p{Lu}"), chars),
        "newline": count_of(t, "\n"),
        "double_space": count_of(t, "  "),
        "trailing_space": t.rlike(K.SPACE + r"\z").cast("int"),
        "nonascii": count_of(t, r"[^\x00-\x7f]"),
    }
    return out.select(*keep, *[cols[c].cast("double").alias(c) for c in K.SURFACE15])


@F.pandas_udf(T.DoubleType())
def compress_ratio(text: pd.Series) -> pd.Series:
    """Compressed size (gzip framing, level 4) over raw UTF-8 size."""
    def one(t):
        raw = t.encode("utf-8", "ignore")
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        return len(packer.compress(raw) + packer.flush()) / (len(raw) + 1e-9)

    return text.map(one).astype("float64")


def cheap_stats(df, keep=("doc_id",)):
    """Type ratio, repeated-bigram rate and hapax ratio of lower-cased words."""
    out = annotate(df.withColumn("text", F.lower("text")), "alpha")
    cols = {
        "type_ratio": safe_div(F.size(F.array_distinct("_low")), F.col("_n")),
        "repeated_bigram_rate": F.when(
            F.size("_bi") > 0, 1.0 - safe_div(F.size(F.array_distinct("_bi")), F.size("_bi"))
        ).otherwise(F.lit(0.0)),
        "hapax_share": safe_div(F.col("_hapax"), F.col("_n")),
    }
    return out.select(*keep, *[c.alias(k) for k, c in cols.items()])


def token_len(df, keep=("doc_id",)):
    return df.select(
        *keep,
        F.size(find_all(F.col("text"), K.NOT_SPACE + "+")).cast("long").alias("n_tokens"),
        F.length("text").cast("long").alias("n_chars"),
    ).select(
        "*",
        F.log1p(F.col("n_tokens").cast("double")).alias("log_tokens"),
        F.log1p(F.col("n_chars").cast("double")).alias("log_chars"),
    )
