"""Stylometric blocks and the statistics computed on them."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import style as S
from ..functions import text as X
from ..operators import profile as P
from ..operators import ranks
from ..sources import corpus as C
from . import common as U
from .registry import query, r

q = U.q
SENT = f"list_filter(regexp_split_to_array(text, {q(K.SENTENCE_END)}), lambda s: regexp_matches(s, {q(K.NOT_SPACE)}))"


def ann(pattern, text="text"):
    """Shared arrays and counts of the style blocks, one row per document."""
    tok = f"regexp_extract_all({text}, {q(pattern)})"
    return f"""{U.CORPUS},
a0 AS (SELECT doc_id, label, {text} AS text, {tok} AS w, length({text}) AS chars, {SENT} AS sent FROM corpus),
a1 AS (SELECT *, list_transform(w, lambda x: lower(x)) AS low, list_transform(w, lambda x: length(x)) AS wl,
  len(w) AS n, list_transform(sent, lambda s: len(regexp_extract_all(s, {q(pattern)}))) AS sl0 FROM a0),
a2 AS (SELECT *, CASE WHEN len(sl0) > 0 THEN sl0 ELSE [n] END AS sl, list_aggregate(low, 'histogram') AS hist,
  list_transform(list_zip(low[1:n-1], low[2:n]), lambda p: p[1] || '_' || p[2]) AS bi FROM a1),
ann AS (SELECT * FROM a2)"""


def cnt(pattern):
    return f"len(regexp_extract_all(text, {q(pattern)}))"


def div(a, b):
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


def inn(words):
    return f"len(list_filter(low, lambda x: x IN {U.in_sql(words)}))"


def hist(k):
    return f"len(list_filter(map_values(hist), lambda c: c = {k}))"


SQL14 = {
    "avg_word_len": "list_avg(wl)", "word_len_std": "list_stddev_pop(wl)",
    "big_word_ratio": div("len(list_filter(wl, lambda x: x > 7))", "n"),
    "very_big_word_ratio": div("len(list_filter(wl, lambda x: x > 10))", "n"),
    "avg_content_word_len": f"coalesce(list_avg(list_transform(list_filter(low, lambda x: x NOT IN {U.in_sql(K.STOPWORDS_STYLE14)}), lambda x: length(x))), 0)",
    "avg_sentence_len": "n::DOUBLE / greatest(1, len(sent))",
    "type_token_ratio": div("len(list_distinct(low))", "n"),
    "avg_syllables_per_word": f"list_avg(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, {q(K.VOWELS)})))))",
    "stopword_ratio": div(inn(K.STOPWORDS_STYLE14), "n"),
    "punct_density": div(cnt(r"""[.,;:!?\-—()"']"""), "greatest(1, chars)"),
    "commas_per_word": div(cnt(","), "n"),
    "digit_density": div(cnt(r"\p{Nd}"), "greatest(1, chars)"),
    "upper_density": div(cnt(r"\p{Lu}"), "greatest(1, chars)"),
    "long_sentence_flag": "(n::DOUBLE / greatest(1, len(sent)) > 25)::INT",
}
SQL4 = {
    "sentence_len_std": "list_stddev_pop(sl)",
    "unique_bigram_ratio": div("len(list_distinct(bi))", "len(bi)"),
    "avg_paragraph_len": f"n::DOUBLE / greatest(1, len(list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, {q(K.NOT_SPACE)}))))",
    "exclaim_question_ratio": div(cnt("[!?]"), "n"),
}
SQL18 = {
    "n_chars": "chars", "n_words": "n", "avg_word_len": "list_avg(wl)", "word_len_std": "list_stddev_pop(wl)",
    "type_token_ratio": div("len(list_distinct(low))", "n"), "n_sentences": "len(sent)",
    "avg_sent_len": "list_avg(sl)", "sent_len_std": "list_stddev_pop(sl)",
    "comma_density": div(cnt(","), "n"), "period_density": div(cnt(r"\."), "n"),
    "semicolon_density": div(cnt(";"), "n"), "paren_density": div(cnt("[()]"), "n"),
    "digit_ratio": div(cnt(r"\p{Nd}"), "chars"),
    "upper_ratio": div(cnt(r"\p{Lu}"), f"greatest(1, {cnt(chr(92) + 'p{L}')})"),
    "stopword_ratio": div(inn(K.STOPWORDS_STYLE18), "n"),
    "unique_bigram_ratio": div("len(list_distinct(bi))", "len(bi)"),
    "hapax_ratio": div(hist(1), "n"), "exclaim_question_ratio": div(cnt("[!?]"), "n"),
}
SQL30 = {
    **SQL18,
    "dis_legomena_ratio": div(hist(2), "n"),
    "sent_len_cv": div("list_stddev_pop(sl)", "list_avg(sl)"),
    "n_sentences_per_100w": div("100.0 * len(sent)", "n"),
    "colon_density": div(cnt(":"), "n"), "quote_density": div(cnt("[\"']"), "n"),
    "dash_density": div(cnt("[-—]"), "n"), "question_density": div(cnt(r"\?"), "n"),
    "exclaim_density": div(cnt("!"), "n"), "alpha_ratio": div(cnt(r"\p{L}"), "chars"),
    "space_ratio": div(cnt(K.SPACE), "chars"),
    "punct_ratio": div(cnt(r"[^\p{L}\p{N}\t-\r\x1c-\x1f\x{85}\p{Z}]"), "chars"),
    "short_word_ratio": div("len(list_filter(wl, lambda x: x <= 3))", "n"),
    "long_word_ratio": div("len(list_filter(wl, lambda x: x >= 8))", "n"),
    "hedge_ratio": div(inn(K.HEDGES), "n"), "be_ratio": div(inn(K.BE_FORMS), "n"),
    "by_ratio": div("len(list_filter(low, lambda x: x = 'by'))", "n"),
    "stopword_mass": div(inn(K.FUNCTION_WORDS), "n"),
}


def block_sql(exprs, names):
    return ", ".join(r(f"CASE WHEN n > 0 THEN {exprs[c]} ELSE 0 END", c) for c in names)


def _block(name, fn, pattern, exprs, names):
    @query(name, f"WITH {ann(pattern)} SELECT doc_id, {block_sql(exprs, names)} FROM ann")
    def run(spark, sf):
        return fn(C.documents(spark, sf))


ROBUST10 = [c for c in K.STYLE18 if c not in K.STYLE18_LENGTH_BOUND]
_block("style14", S.style14, K.ALPHA_WORD, SQL14, K.STYLE14)
_block("style_extra4", S.style_extra4, K.ALPHA_WORD, SQL4, K.STYLE_EXTRA4)
_block("style18", S.style18, K.ALNUM_WORD, SQL18, K.STYLE18)
_block("style10_robust", S.style10_robust, K.ALNUM_WORD, SQL18, ROBUST10)
_block("select_features", S.style10_robust, K.ALNUM_WORD, SQL18, ROBUST10)
_block("style30_struct", S.style30, K.ALNUM_WORD, SQL30, K.STYLE30)

FW = f"""{ann(K.ALNUM_WORD)}, fw AS (SELECT doc_id, n, word, count(*) AS c FROM (SELECT doc_id, n, unnest(low) AS word FROM ann)
  WHERE word IN {U.in_sql(K.FUNCTION_WORDS)} GROUP BY ALL)"""


@query("function_words197", f"WITH {FW} SELECT doc_id, word, {r('c::DOUBLE / n', 'freq')} FROM fw")
def function_words197(spark, sf):
    return S.function_words(C.documents(spark, sf))


@query("style227", f"""WITH {ann(K.ALNUM_WORD)}, k AS (SELECT doc_id, label, {block_sql(SQL30, K.STYLE30)},
  {inn(K.FUNCTION_WORDS)} AS hits, n FROM ann)
SELECT doc_id, 227 AS width, {r('coalesce(hits::DOUBLE / nullif(n, 0), 0)', 'word_mass')},
{r('+'.join(K.STYLE30), 'struct_sum')} FROM k""")
def style227(spark, sf):
    """The dense 197 + 30 block, summarised by its two halves."""
    v = S.style227(C.documents(spark, sf))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    struct = F.transform(F.slice("style", 198, 30), lambda x: F.round(x, 6))
    return v.select("doc_id", F.size("style").alias("width"), total(F.slice("style", 1, 197)).alias("word_mass"),
                    total(struct).alias("struct_sum"))


@query("sentence6", f"""WITH {U.CORPUS}, s AS (SELECT doc_id, {SENT} AS sent FROM corpus),
l AS (SELECT doc_id, sent, list_transform(sent, lambda x: len(regexp_extract_all(x, {q(K.NOT_SPACE + '+')}))) AS lens,
  list_transform(sent, lambda x: len(regexp_split_to_array(x, '[,;:]'))) AS cl FROM s)
SELECT doc_id, {r('len(sent)', 'n_sentences')}, {r('coalesce(list_avg(lens), 0)', 'sent_words_mean')},
{r('coalesce(list_stddev_pop(lens), 0)', 'sent_words_std')}, {r('coalesce(list_avg(cl), 0)', 'clauses_mean')},
{r('coalesce(list_stddev_pop(cl), 0)', 'clauses_std')},
{r('coalesce(len(list_filter(lens, lambda x: x > 30))::DOUBLE / nullif(len(lens), 0), 0)', 'long_sentence_share')} FROM l""")
def sentence6(spark, sf):
    return S.sentence6(C.documents(spark, sf))


SURFACE = f"""{U.CORPUS}, s0 AS (SELECT doc_id, label, text, {f"regexp_extract_all(text, {q(K.ALNUM_WORD)})"} AS w FROM corpus),
surface AS (SELECT doc_id, label, length(text)::DOUBLE AS len_chars, len(w)::DOUBLE AS len_words,
 coalesce(list_avg(list_transform(w, lambda x: length(x))), 0) AS avg_wlen,
 {cnt(',')}::DOUBLE AS n_commas, {cnt(';')}::DOUBLE AS n_semicolon, {cnt('[—–]')}::DOUBLE AS n_emdash,
 {cnt('-')}::DOUBLE AS n_hyphen, {cnt('[(]')}::DOUBLE AS n_paren,
 len(list_distinct(list_transform(w, lambda x: lower(x))))::DOUBLE / greatest(1, len(w)) AS uniq_ratio,
 {cnt(chr(92) + 'p{Nd}')}::DOUBLE / greatest(1, length(text)) AS digit_frac,
 {cnt(chr(92) + 'p{Lu}')}::DOUBLE / greatest(1, length(text)) AS upper_frac,
 {cnt(chr(92) + 'n')}::DOUBLE AS newline, {cnt('  ')}::DOUBLE AS double_space,
 regexp_matches(text, {q(K.SPACE + chr(92) + 'z')})::INT::DOUBLE AS trailing_space,
 {cnt('[^' + chr(92) + 'x00-' + chr(92) + 'x7f]')}::DOUBLE AS nonascii FROM s0)"""


@query("surface15", f"WITH {SURFACE} SELECT doc_id, {', '.join(r(c, c) for c in K.SURFACE15)} FROM surface")
def surface15(spark, sf):
    return S.surface15(C.documents(spark, sf))


@query("syllables", f"""WITH {ann(K.ALPHA_WORD)} SELECT doc_id,
coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, {q(K.VOWELS)}))))), 0)::BIGINT AS n_syllables FROM ann""")
def syllables(spark, sf):
    w = C.documents(spark, sf).select("doc_id", X.tok_alpha(F.col("text")).alias("w"))
    return w.select("doc_id", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + S.syllables(x)).alias("n_syllables"))


@query("token_len", f"""WITH {U.CORPUS} SELECT doc_id, len({U.WS_TOK})::BIGINT AS n_tokens, length(text)::BIGINT AS n_chars,
{r(f'ln(1.0 + len({U.WS_TOK}))', 'log_tokens')}, {r('ln(1.0 + length(text))', 'log_chars')} FROM corpus""")
def token_len(spark, sf):
    return S.token_len(C.documents(spark, sf))


CHEAP = f"""{ann(K.ALPHA_WORD, 'lower(text)')},
cheap AS (SELECT doc_id, label, {div('len(list_distinct(low))', 'n')} AS type_ratio,
 CASE WHEN len(bi) > 0 THEN 1 - len(list_distinct(bi))::DOUBLE / len(bi) ELSE 0 END AS repeated_bigram_rate,
 {div(hist(1), 'n')} AS hapax_share FROM ann)"""


@query("cheap_stats", f"""WITH {CHEAP} SELECT doc_id, {r('type_ratio', 'type_ratio')},
{r('repeated_bigram_rate', 'repeated_bigram_rate')}, {r('hapax_share', 'hapax_share')} FROM cheap""")
def cheap_stats(spark, sf):
    return S.cheap_stats(C.documents(spark, sf))


@query("compress_ratio")
def compress_ratio(spark, sf):
    """Arrow-batched; no SQL engine has the codec."""
    return C.documents(spark, sf).select("doc_id", S.compress_ratio("text").alias("ratio"))


# --- class statistics of the style columns ---------------------------------------------

S14 = f"{ann(K.ALPHA_WORD)}, s14 AS (SELECT doc_id, label, {', '.join(f'CASE WHEN n > 0 THEN {SQL14[c]} ELSE 0 END AS {c}' for c in K.STYLE14)} FROM ann)"


def long_sql(table, cols):
    return " UNION ALL ".join(f"SELECT doc_id, label, '{c}' AS feature, {c}::DOUBLE AS value FROM {table} WHERE label IS NOT NULL" for c in cols)


LONG14 = f"{S14}, lf AS ({long_sql('s14', K.STYLE14)})"
LONG15 = f"{SURFACE}, lf AS ({long_sql('surface', K.SURFACE15)})"


def style_long(spark, sf, fn=S.style14, names=K.STYLE14):
    """(doc_id, label, feature, value) of the labelled documents."""
    return P.melt(fn(C.labelled(spark, sf), keep=("doc_id", "label")), names, ("doc_id", "label"))


@query("gaussian_stats", f"""WITH {LONG14}, g AS (SELECT 0.01 * avg(v) AS eps FROM (SELECT var_pop(value) AS v FROM lf GROUP BY feature))
SELECT label, feature, {r('avg(value)', 'mean')}, {r('var_pop(value) + max(eps)', 'var')},
{r("ln(count(*)::DOUBLE / (SELECT count(*) FROM lf WHERE feature = 'avg_word_len'))", 'log_prior')} FROM lf, g GROUP BY ALL""")
def gaussian_stats(spark, sf):
    return P.gaussian_stats(style_long(spark, sf))


SEP = "abs(avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0)) / (sqrt((var_pop(value) FILTER (label = 1) + var_pop(value) FILTER (label = 0)) / 2) + 1e-9)"


@query("separation_score", f"WITH {LONG14} SELECT feature, {r(SEP, 'score')} FROM lf GROUP BY feature")
def separation_score(spark, sf):
    return P.separation_score(style_long(spark, sf))


@query("feature_rank", f"""WITH {LONG14}, s AS (SELECT feature, {r(SEP, 'score')} FROM lf GROUP BY feature)
SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature)::INT AS rank FROM s""")
def feature_rank(spark, sf):
    return P.feature_rank(P.separation_score(style_long(spark, sf)))


@query("cohens_d", f"""WITH {LONG15} SELECT feature, {r('avg(value) FILTER (label = 0)', 'mean0', 5)}, {r('avg(value) FILTER (label = 1)', 'mean1', 5)},
{r('(avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0)) / (stddev_samp(value) + 1e-9)', 'd', 5)},
(abs((avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0)) / (stddev_samp(value) + 1e-9)) > 0.5)::INT AS strong FROM lf GROUP BY feature""", digits=5)
def cohens_d(spark, sf):
    return P.cohens_d(style_long(spark, sf, S.surface15, K.SURFACE15))


@query("feature_corr", f"""WITH {LONG14} SELECT a.feature AS a, b.feature AS b,
{r('coalesce(CASE WHEN isnan(corr(a.value, b.value)) THEN 0 ELSE corr(a.value, b.value) END, 0)', 'corr', 5)}
FROM lf a JOIN lf b USING (doc_id) WHERE a.feature < b.feature GROUP BY ALL""", digits=5)
def feature_corr(spark, sf):
    """Pearson correlation of every pair of the 14 columns, in one aggregate."""
    return P.pairwise_corr(S.style14(C.labelled(spark, sf)), K.STYLE14)


@query("label_corr", f"""WITH {LONG14}, c AS (SELECT feature, CASE WHEN var_pop(value) > 0 THEN corr(value, label) ELSE 0 END AS c FROM lf GROUP BY feature)
SELECT feature, {r('c', 'corr')} FROM c ORDER BY abs(round(c, 6)) DESC, feature LIMIT 10""")
def label_corr(spark, sf):
    return P.label_corr(style_long(spark, sf)).orderBy(F.abs("corr").desc(), "feature").limit(10)


@query("greedy_decorrelate", f"""WITH RECURSIVE {LONG14}, s AS (SELECT feature, {r(SEP, 'score')} FROM lf GROUP BY feature),
o AS (SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) AS i FROM s),
cr AS (SELECT a.feature AS a, b.feature AS b, coalesce(CASE WHEN isnan(corr(a.value, b.value)) THEN 0 ELSE corr(a.value, b.value) END, 0) AS c
 FROM lf a JOIN lf b USING (doc_id) WHERE a.feature <> b.feature GROUP BY ALL),
cf AS (SELECT x.i, x.feature, x.score, coalesce(list(y.i) FILTER (abs(c) > 0.6), []::BIGINT[]) AS against
 FROM o x LEFT JOIN cr ON cr.a = x.feature LEFT JOIN o y ON y.feature = cr.b AND y.i < x.i GROUP BY ALL),
st AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
 SELECT cf.i, CASE WHEN list_has_any(kept, against) THEN kept ELSE list_append(kept, cf.i) END FROM st JOIN cf ON cf.i = st.i + 1),
fin AS (SELECT kept FROM st ORDER BY i DESC LIMIT 1)
SELECT list_position(kept, i)::INT AS pick, feature, score FROM o, fin WHERE list_contains(kept, i)""")
def greedy_decorrelate(spark, sf):
    """Features in rank order, skipping those too correlated with one already kept."""
    lab = S.style14(C.labelled(spark, sf), keep=("doc_id", "label"))
    order = P.separation_score(P.melt(lab, K.STYLE14, ("doc_id", "label")))
    return P.greedy_decorrelate(order, P.pairwise_corr(lab, K.STYLE14))


@query("feature_profile", f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings),
rw AS (SELECT sum(v * v) AS ss, sum(v) AS s FROM e GROUP BY vec_id)
SELECT {r('min(v)', 'lo')}, {r('max(v)', 'hi')}, {r('avg(v)', 'mean')}, {r('avg((v = 0)::INT)', 'zero_share')},
{r('avg((v = round_even(v, 0))::INT)', 'integer_share')}, {r('(SELECT avg(ss) FROM rw)', 'row_sumsq')}, {r('(SELECT avg(s) FROM rw)', 'row_sum')} FROM e""")
def feature_profile(spark, sf):
    return P.array_profile(C.features(spark, sf))


@query("length_describe", f"""WITH {U.CORPUS} SELECT coalesce(label, -1)::INT AS label, {r('avg(length(text))', 'mean_chars')},
min(length(text))::INT AS min_chars, max(length(text))::INT AS max_chars, count(*) AS n FROM corpus GROUP BY label""")
def length_describe(spark, sf):
    c = C.corpus(spark, sf).select(F.coalesce("label", F.lit(-1)).alias("label"), F.length("text").alias("k"))
    return c.groupBy("label").agg(F.avg("k").alias("mean_chars"), F.min("k").alias("min_chars"),
                                  F.max("k").alias("max_chars"), F.count(F.lit(1)).alias("n"))


@query("standardize", f"""WITH {LONG14}, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM lf GROUP BY feature)
SELECT doc_id, feature, {r('(value - m) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END', 'z')} FROM lf JOIN s USING (feature)""")
def standardize(spark, sf):
    """(x - mean) / population sd, fitted on the labelled rows."""
    return P.zscore(style_long(spark, sf)).select("doc_id", "feature", "z")


@query("log1p_l2", f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: ln(1 + greatest(v::DOUBLE, 0))) AS l FROM embeddings),
m AS (SELECT vec_id, l, sqrt(list_sum(list_transform(l, lambda v: v * v))) AS nm FROM e)
SELECT vec_id, {r('list_sum(l) / nm', 'total')}, {r('list_max(l) / nm', 'largest')} FROM m""")
def log1p_l2(spark, sf):
    from ..operators.terms import log1p_l2 as op

    v = op(C.features(spark, sf))
    return v.select("vec_id", F.aggregate("x", F.lit(0.0), lambda a, y: a + y).alias("total"), F.array_max("x").alias("largest"))


@query("quantiles", f"""WITH {U.CORPUS}, t AS (SELECT len({U.WS_TOK}) AS n_tokens FROM corpus)
SELECT p AS prob, {r('quantile_cont(n_tokens, p)', 'value')} FROM t, (SELECT unnest([0.25, 0.5, 0.6, 0.75, 0.95])::DOUBLE AS p) GROUP BY p"""
       .replace("quantile_cont(n_tokens, p)", "CASE p WHEN 0.25 THEN quantile_cont(n_tokens, 0.25) WHEN 0.5 THEN quantile_cont(n_tokens, 0.5) "
                "WHEN 0.6 THEN quantile_cont(n_tokens, 0.6) WHEN 0.75 THEN quantile_cont(n_tokens, 0.75) ELSE quantile_cont(n_tokens, 0.95) END"))
def quantiles(spark, sf):
    t = C.documents(spark, sf).select(F.size(X.tok_ws(F.col("text"))).alias("n_tokens"))
    return ranks.exact_quantiles(t, "n_tokens", [0.25, 0.5, 0.6, 0.75, 0.95])


@query("tells_join", f"""WITH {U.CORPUS}, wd AS (SELECT unnest({U.list_sql(K.TELL_WORDS + ['the', 'and', 'with', 'that'])}) AS word),
h AS (SELECT word, label, avg(regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || word || '($|[^\\p{{L}}\\p{{N}}_])')::INT) AS rate
  FROM corpus, wd WHERE label IS NOT NULL GROUP BY ALL)
SELECT word, {r('max(rate) FILTER (label = 0)', 'rate0')}, {r('max(rate) FILTER (label = 1)', 'rate1')},
{r('max(rate) FILTER (label = 1) - max(rate) FILTER (label = 0)', 'delta')} FROM h GROUP BY word""")
def tells_join(spark, sf):
    """Document rate per class of each tell word (plus four common words as a control)."""
    return P.word_rates(C.labelled(spark, sf), K.TELL_WORDS + ["the", "and", "with", "that"])
