"""Tokenisers, n-grams, views, crops, and the long term table."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import terms as T
from ..session import cut_lineage
from ..sources import corpus as C
from . import common as U
from .registry import query, r

q = U.q


def tok_sql(pattern, lower=False):
    return f"regexp_extract_all({'lower(text)' if lower else 'text'}, {q(pattern)})"


def _digest(name, tok):
    return [F.size(tok).alias(f"n_{name}"), F.md5(F.array_join(tok, "|")).alias(f"md5_{name}")]


def _digest_sql(name, expr):
    return f"len({expr})::INT AS n_{name}, md5(array_to_string({expr}, '|')) AS md5_{name}"


def _tokenizer(name, parts):
    """One row per document: token count and digest of the token list, per variant."""
    sql = ", ".join(_digest_sql(k, tok_sql(p, low)) for k, _, p, low in parts)

    @query(name, f"WITH {U.CORPUS} SELECT doc_id, {sql} FROM corpus")
    def run(spark, sf):
        d = C.documents(spark, sf).select("doc_id", *[f(F.col("text")).alias(k) for k, f, _, _ in parts])
        return d.select("doc_id", *[c for k, *_ in parts for c in _digest(k, F.col(k))])


_tokenizer("tok_alpha", [("alpha", X.tok_alpha, K.ALPHA_WORD, False)])
_tokenizer("tok_alnum", [("alnum", X.tok_alnum, K.ALNUM_WORD, False),
                         ("lower", X.tok_lower_alnum, K.LOWER_ALNUM_WORD, True)])
_tokenizer("tok_mixed", [("view", lambda t: X.tok_mixed(t, "view"), K.MIXED_VIEW, False),
                         ("punct", lambda t: X.tok_mixed(t, "punct"), K.MIXED_PUNCT, False),
                         ("digit", lambda t: X.tok_mixed(t, "digit"), K.MIXED_DIGIT, False)])
_tokenizer("tok_ws", [("ws", X.tok_ws, K.NOT_SPACE + "+", False)])
_tokenizer("tok_sklearn", [("word", X.tok_vectorizer, K.VECTORIZER_WORD, True)])


@query("normalize_text", f"WITH {U.CORPUS} SELECT doc_id, md5({U.NORM}) AS norm_md5, length({U.NORM})::INT AS n FROM corpus")
def normalize_text(spark, sf):
    n = C.documents(spark, sf).select("doc_id", X.normalize_text(F.col("text")).alias("t"))
    return n.select("doc_id", F.md5("t").alias("norm_md5"), F.length("t").alias("n"))


@query("prefix_md5", f"WITH {U.CORPUS} SELECT doc_id, md5(left({U.NORM}, 120)) AS prefix_md5 FROM corpus")
def prefix_md5(spark, sf):
    return C.documents(spark, sf).select("doc_id", X.prefix_md5(F.col("text")).alias("prefix_md5"))


# --- n-grams -----------------------------------------------------------------------

def _pair_sql():
    return "list_transform(list_zip(tok[1:len(tok)-1], tok[2:]), lambda p: p[1] || ' ' || p[2])"


@query("word_ngrams", f"""WITH {U.CORPUS}, t AS (SELECT doc_id, {U.TOK} AS tok FROM corpus),
z AS (SELECT doc_id, tok AS g1, len(tok) AS n, list_zip(tok[1:len(tok)-1], tok[2:]) AS z2 FROM t),
p AS (SELECT doc_id, n, g1, list_transform(z2, lambda p: p[1] || ' ' || p[2]) AS g2 FROM z),
p3 AS (SELECT *, list_transform(list_zip(g2[1:n-2], g1[3:]), lambda p: p[1] || ' ' || p[2]) AS g3 FROM p),
p4 AS (SELECT *, list_transform(list_zip(g3[1:n-3], g1[4:]), lambda p: p[1] || ' ' || p[2]) AS g4 FROM p3)
SELECT doc_id, {', '.join(_digest_sql(f'g{n}', f'g{n}') for n in (1, 2, 3, 4))} FROM p4""")
def word_ngrams(spark, sf):
    t = C.documents(spark, sf).select("doc_id", X.tok_vectorizer(F.col("text")).alias("tok"))
    g = t.select("doc_id", *[X.word_ngrams(F.col("tok"), n).alias(f"g{n}") for n in (1, 2, 3, 4)])
    return g.select("doc_id", *[c for n in (1, 2, 3, 4) for c in _digest(f"g{n}", F.col(f"g{n}"))])


def char_sql(lo, hi, source="corpus"):
    """Padded-chunk character n-grams, one row per occurrence."""
    return f"""chunks AS (SELECT doc_id, ' ' || c || ' ' AS p FROM (SELECT doc_id,
    unnest(regexp_extract_all(lower(text), {q(K.NOT_SPACE + '+')})) AS c FROM {source})),
grams AS (SELECT doc_id, n, substring(p, i, n) AS term FROM (SELECT doc_id, p, n,
    unnest(range(1, greatest(length(p) - n + 2, 1))) AS i FROM chunks, (SELECT unnest(range({lo}, {hi + 1})) AS n)))"""


@query("char_wb_ngrams", f"""WITH {U.CORPUS}, {char_sql(2, 6)}
SELECT doc_id, n::INT AS n, count(*) AS total, count(DISTINCT term) AS n_distinct FROM grams GROUP BY ALL""")
def char_wb_ngrams(spark, sf):
    """Sizes 2 to 6 inside padded chunks, counted per document and size."""
    t = T.char_wb_terms(C.documents(spark, sf), 2, 6)
    return t.groupBy("doc_id", F.length("term").alias("n")).agg(
        F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n_distinct"))


@query("char_ngrams", f"""WITH {U.CORPUS}, v AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
  '\\p{{L}}', 'a', 'g'), '\\p{{Nd}}', '9', 'g'), {q(K.SPACE)}, '_', 'g') AS s FROM corpus),
ch AS (SELECT doc_id, unnest(string_split(s, '')) AS c, unnest(range(0, length(s))) AS i FROM v),
ld AS (SELECT c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3, lead(c, 4) OVER w AS c4
  FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT c || c1 AS term FROM ld WHERE c1 IS NOT NULL UNION ALL SELECT c || c1 || c2 FROM ld WHERE c2 IS NOT NULL
  UNION ALL SELECT c || c1 || c2 || c3 FROM ld WHERE c3 IS NOT NULL
  UNION ALL SELECT c || c1 || c2 || c3 || c4 FROM ld WHERE c4 IS NOT NULL)
SELECT term, count(*) AS cf FROM g GROUP BY ALL""")
def char_ngrams(spark, sf):
    """Unpadded sizes 2 to 5 on the character-class view, corpus counts."""
    v = C.documents(spark, sf).select("doc_id", X.view_charclass(F.col("text")).alias("text"))
    return T.doc_freq(T.char_terms(v, 2, 5)).select("term", "cf")


# --- counts, vocabularies, weights -----------------------------------------------------

@query("term_counts", f"WITH {U.WORDS} SELECT doc_id, term, cnt FROM terms")
def term_counts(spark, sf):
    return T.word_terms(C.documents(spark, sf)).select("doc_id", "term", "cnt")


def _blocks(d):
    return T.stack_blocks(T.word_terms(d, 1, 2), T.char_wb_terms(d, 3, 5))


BLOCKS = f"""{U.CORPUS}, {char_sql(3, 5)},
wt AS (SELECT doc_id, {U.TOK} AS tok FROM corpus),
wc AS (SELECT doc_id, 'w' AS block, term, count(*) AS cnt FROM (
  SELECT doc_id, unnest(tok) AS term FROM wt UNION ALL SELECT doc_id, unnest({_pair_sql()}) FROM wt) GROUP BY ALL),
bt AS (SELECT * FROM wc UNION ALL SELECT doc_id, 'c', term, count(*) FROM grams GROUP BY ALL)"""


@query("doc_freq", f"WITH {BLOCKS} SELECT block, term, count(*) AS df, sum(cnt)::BIGINT AS cf FROM bt GROUP BY ALL")
def doc_freq(spark, sf):
    """Document and total frequency of word (1,2) and character (3,5) blocks."""
    return T.doc_freq(_blocks(C.documents(spark, sf)))


ALPHA_TERMS = f"""{U.CORPUS}, terms AS (SELECT doc_id, label, term, count(*) AS cnt FROM (SELECT doc_id, label,
  lower(unnest({tok_sql(K.ALPHA_WORD)})) AS term FROM corpus) GROUP BY ALL)"""


def alpha_terms(d, **kw):
    low = lambda t: F.transform(X.tok_alpha(t), lambda w: F.lower(w))
    return T.word_terms(d, tok=low, **kw)


@query("corpus_freq", f"WITH {ALPHA_TERMS} SELECT term, sum(cnt)::BIGINT AS cf FROM terms GROUP BY term")
def corpus_freq(spark, sf):
    return T.doc_freq(alpha_terms(C.documents(spark, sf))).select("term", "cf")


@query("vocab_prune", f"""WITH {U.WORDS}, n AS (SELECT count(*) AS n FROM corpus),
f AS (SELECT term, count(*) AS df FROM terms GROUP BY term)
SELECT term, df FROM f, n WHERE df >= 2 AND df <= 0.5 * n AND term NOT IN {U.in_sql(K.STOPWORDS_STYLE18)}""")
def vocab_prune(spark, sf):
    d = C.documents(spark, sf)
    f = T.doc_freq(T.word_terms(d))
    return T.vocab_prune(f, T.n_docs(d), 2, 0.5, K.STOPWORDS_STYLE18).select("term", "df")


@query("vocab_topk", f"WITH {ALPHA_TERMS} SELECT term, sum(cnt)::BIGINT AS cf FROM terms GROUP BY term ORDER BY cf DESC, term LIMIT 2000")
def vocab_topk(spark, sf):
    return T.vocab_top(T.doc_freq(alpha_terms(C.documents(spark, sf))), 2000, "cf").select("term", "cf")


@query("vocab_cap", f"WITH {U.WORDS} SELECT term, count(*) AS df FROM terms GROUP BY term HAVING count(*) >= 2 ORDER BY df DESC, term LIMIT 2000")
def vocab_cap(spark, sf):
    f = T.vocab_prune(T.doc_freq(T.word_terms(C.documents(spark, sf))), min_df=2)
    return T.vocab_top(f, 2000, "df").select("term", "df")


@query("vocab_lookup", f"""WITH {U.WORDS}, v AS (SELECT term FROM terms WHERE label IS NOT NULL GROUP BY term HAVING count(*) >= 2)
SELECT doc_id, count(*) AS n_known, sum(cnt)::BIGINT AS known_tokens FROM terms JOIN v USING (term)
WHERE label IS NULL GROUP BY doc_id""")
def vocab_lookup(spark, sf):
    """Target terms found in the labelled vocabulary; unknown terms drop out."""
    v = cut_lineage(T.vocab_prune(T.doc_freq(T.word_terms(C.labelled(spark, sf))), min_df=2))
    hit = T.lookup(T.word_terms(C.target(spark, sf)), v.select("block", "term", "df"))
    return hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_known"), F.sum("cnt").alias("known_tokens"))


TF = {"tf_sublinear": "1 + ln(cnt)", "tf_binary": "1.0", "tf_raw": "cnt"}
for _name, _sql in TF.items():
    def _tf(spark, sf, kind=_name[3:]):
        t = T.word_terms(C.documents(spark, sf))
        return t.select("doc_id", T.tf(kind).alias("v")).groupBy("doc_id").agg(
            F.sum("v").alias("total"), F.max("v").alias("largest"))

    query(_name, f"WITH {U.WORDS} SELECT doc_id, {r(f'sum({_sql})', 'total')}, {r(f'max({_sql})', 'largest')} FROM terms GROUP BY doc_id")(_tf)


@query("idf_smooth", f"""WITH {U.WORDS}, n AS (SELECT count(*) AS n FROM corpus)
SELECT term, count(*) AS df, {r('ln((1.0 + max(n)) / (1.0 + count(*))) + 1', 'idf')} FROM terms, n GROUP BY term""")
def idf_smooth(spark, sf):
    d = C.documents(spark, sf)
    return T.idf(T.doc_freq(T.word_terms(d)), d).select("term", "df", "idf")


WORD_TFIDF = f"""{U.WORDS}, n AS (SELECT count(*) AS n FROM corpus WHERE label IS NOT NULL),
v AS (SELECT term, ln((1.0 + max(n)) / (1.0 + count(*))) + 1 AS idf FROM terms, n WHERE label IS NOT NULL
  GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT doc_id, label, term, (1 + ln(cnt)) * idf AS value FROM terms JOIN v USING (term)),
tfidf AS (SELECT doc_id, label, term, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM raw)"""


@query("tfidf", f"WITH {WORD_TFIDF} SELECT doc_id, term, {r('value', 'value')} FROM tfidf")
def tfidf(spark, sf):
    """Word block: fitted on labelled text, applied to every document."""
    d, tr = C.documents(spark, sf), C.labelled(spark, sf)
    v = T.fit_vocab(T.word_terms(tr), tr)
    return T.weigh(T.word_terms(d), v).select("doc_id", "term", "value")


def _norm_query(name, norm, size):
    @query(name, f"""WITH {U.WORDS}, raw AS (SELECT doc_id, (1 + ln(cnt)) AS value FROM terms),
n AS (SELECT doc_id, {size} AS s FROM raw GROUP BY doc_id)
SELECT doc_id, {r('max(value / s)', 'largest')}, {r('sum(value / s)', 'total')} FROM raw JOIN n USING (doc_id) GROUP BY doc_id""")
    def run(spark, sf):
        t = T.word_terms(C.documents(spark, sf)).select("doc_id", "block", "term", T.tf().alias("value"))
        return T.normalize(t, norm).groupBy("doc_id").agg(
            F.max("value").alias("largest"), F.sum("value").alias("total"))


_norm_query("norm_l2", "l2", "sqrt(sum(value * value))")
_norm_query("norm_l1", "l1", "sum(value)")

STACK = f"""{BLOCKS}, n AS (SELECT count(*) AS n FROM corpus),
v AS (SELECT block, term, ln((1.0 + max(n)) / (1.0 + count(*))) + 1 AS idf FROM bt, n GROUP BY ALL HAVING count(*) >= 2),
raw AS (SELECT doc_id, block, (1 + ln(cnt)) * idf AS value FROM bt JOIN v USING (block, term))"""


@query("tfidf_joint", f"""WITH {STACK}, nm AS (SELECT doc_id, sqrt(sum(value * value)) AS s FROM raw GROUP BY doc_id)
SELECT doc_id, block, count(*) AS n_terms, {r('sum(value / s)', 'total')}, {r('max(value / s)', 'largest')}
FROM raw JOIN nm USING (doc_id) GROUP BY ALL""")
def tfidf_joint(spark, sf):
    """Word (1,2) and character (3,5) blocks under one norm per document."""
    d = C.documents(spark, sf)
    t = _blocks(d)  # counted in the row twice, for the fit and the weights: the table is several times the text
    return T.weigh(t, T.fit_vocab(t, d), scope=("doc_id",)).groupBy("doc_id", "block").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("value").alias("total"), F.max("value").alias("largest"))


@query("block_scale", f"""WITH {STACK}, nm AS (SELECT doc_id, block, sqrt(sum(value * value)) AS s FROM raw GROUP BY ALL)
SELECT doc_id, block, count(*) AS n_terms, {r("sum(value / s * CASE block WHEN 'w' THEN 1.6 ELSE 1 END)", 'total')}
FROM raw JOIN nm USING (doc_id, block) GROUP BY ALL""")
def block_scale(spark, sf):
    """Each block has its own norm, then the word block is scaled by 1.6."""
    d = C.documents(spark, sf)
    t = _blocks(d)  # counted in the row twice, for the fit and the weights: the table is several times the text
    v = T.block_scale(T.weigh(t, T.fit_vocab(t, d)), {"w": 1.6})
    return v.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("value").alias("total"))


@query("tfidf_transductive", f"""WITH {U.WORDS}, n AS (SELECT count(*) AS n FROM corpus),
v AS (SELECT term, ln((1.0 + max(n)) / (1.0 + count(*))) + 1 AS idf FROM terms, n GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT doc_id, term, (1 + ln(cnt)) * idf AS value FROM terms JOIN v USING (term) WHERE label IS NULL)
SELECT doc_id, count(*) AS n_terms, {r('sum(value) / sqrt(sum(value * value))', 'total')} FROM raw GROUP BY doc_id""")
def tfidf_transductive(spark, sf):
    """Vocabulary and IDF from labelled and target text together."""
    both = T.word_terms(C.documents(spark, sf))
    v = T.fit_vocab(both, C.documents(spark, sf))
    return T.weigh(T.word_terms(C.target(spark, sf)), v).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("value").alias("total"))


def content_word(w):
    return ~w.isin(K.STOPWORDS_STYLE14)


@query("word_filter", f"""WITH {U.CORPUS}, t AS (SELECT doc_id, list_transform({tok_sql(K.ALPHA_WORD)}, lambda w: lower(w)) AS tok FROM corpus),
g AS (SELECT doc_id, unnest(list_filter(tok, lambda w: w NOT IN {U.in_sql(K.STOPWORDS_STYLE14)})) AS term FROM t
 UNION ALL SELECT doc_id, unnest({_pair_sql().replace("' '", "'_'")}) FROM t)
SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM g GROUP BY term""")
def word_filter(spark, sf):
    """Content unigrams only; bigrams pass unfiltered."""
    t = alpha_terms(C.documents(spark, sf), hi=2, sep="_", unigram_filter=content_word)
    return T.doc_freq(t).select("term", "cf", "df")


@query("hstack_blocks", f"""WITH {U.WORDS} SELECT doc_id, 'len' AS block, 2::BIGINT AS n_terms,
 {r(f'1.0 * length(text) + len({U.WS_TOK})', 'total')} FROM corpus
UNION ALL SELECT doc_id, 'w', count(*), {r('sum(1 + ln(cnt))', 'total')} FROM terms GROUP BY doc_id""")
def hstack_blocks(spark, sf):
    """Sparse and dense blocks stacked as rows of one table."""
    d = C.documents(spark, sf)
    w = T.word_terms(d).select("doc_id", "block", "term", T.tf().alias("value"))
    dense = d.select("doc_id", F.length("text").alias("n_chars"), F.size(X.tok_ws(F.col("text"))).alias("n_tokens"))
    both = T.stack_blocks(w, T.dense_block(dense, ["n_chars", "n_tokens"], "len"))
    return both.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("value").alias("total"))


@query("chi2_topic", f"""WITH {U.WORDS}, lt AS (SELECT t.doc_id, t.term, (1 + ln(t.cnt)) AS value, c.lang FROM terms t
  JOIN corpus c USING (doc_id) JOIN (SELECT term FROM terms GROUP BY term HAVING count(*) >= 5) k USING (term)),
f AS (SELECT term, sum(value) AS feat FROM lt GROUP BY term),
p AS (SELECT lang, count(*)::DOUBLE / (SELECT count(*) FROM corpus) AS prob FROM corpus GROUP BY lang),
o AS (SELECT term, lang, sum(value) AS obs FROM lt GROUP BY ALL)
SELECT term, {r('sum((coalesce(obs, 0) - feat * prob) ** 2 / (feat * prob))', 'chi2', 4)}
FROM f CROSS JOIN p LEFT JOIN o USING (term, lang) GROUP BY term ORDER BY 2 DESC, term LIMIT 200""", digits=4)
def chi2_topic(spark, sf):
    """The 200 terms most tied to the topic (here the language) by chi-square."""
    d = C.documents(spark, sf)
    t = T.word_terms(d)
    kept = cut_lineage(T.vocab_prune(T.doc_freq(t), min_df=5))
    v = T.lookup(t, kept.select("block", "term", "df")).select("doc_id", "block", "term", T.tf().alias("value"))
    chi = T.chi2_terms(v, d.select("doc_id", F.col("lang").alias("cluster")))
    return chi.select("term", F.round("chi2", 4).alias("chi2")).orderBy(F.col("chi2").desc(), "term").limit(200)


# --- views -----------------------------------------------------------------------------

STOP = U.list_sql(K.FUNCTION_WORDS)


def _view(name, kind, build, body, pattern):
    @query(name, f"""WITH {U.CORPUS}, t AS (SELECT doc_id, {tok_sql(pattern)} AS tok FROM corpus),
v AS (SELECT doc_id, array_to_string(list_transform(tok, lambda t, i: {body}), ' ') AS s FROM t)
SELECT doc_id, length(s)::INT AS n_chars, md5(s) AS view_md5 FROM v""")
    def run(spark, sf):
        t = C.documents(spark, sf).select("doc_id", X.tok_mixed(F.col("text"), kind).alias("tok"))
        v = t.select("doc_id", build(F.col("tok")).alias("s"))
        return v.select("doc_id", F.length("s").alias("n_chars"), F.md5("s").alias("view_md5"))


_view("view_func", "view", X.view_func,
      f"CASE WHEN list_contains({STOP}, lower(t)) THEN lower(t) WHEN regexp_matches(t, '^[[:punct:]]$') THEN t ELSE 'X' END",
      K.MIXED_VIEW)
_view("view_skeleton", "punct", X.view_skeleton,
      f"CASE WHEN NOT regexp_matches(t, '^\\p{{L}}+$') THEN t WHEN list_contains({STOP}, lower(t)) THEN lower(t) ELSE '#' END",
      K.MIXED_PUNCT)
_view("view_skeleton_initial", "digit", lambda t: X.view_skeleton(t, mask="initial"),
      f"CASE WHEN NOT regexp_matches(t, '^\\p{{L}}') THEN t WHEN list_contains({STOP}, lower(t)) THEN lower(t) ELSE '#' END",
      K.MIXED_DIGIT)
_view("view_shape", "digit", X.view_shape,
      "CASE WHEN regexp_matches(t, '^\\p{Nd}+$') THEN '0' WHEN regexp_matches(t, '^[A-Z][A-Z]+$') THEN 'U' "
      "WHEN regexp_matches(t, '^[A-Z][A-Za-z]*$') THEN 'C' WHEN regexp_matches(t, '^[A-Za-z]+$') THEN 'w' ELSE t END",
      K.MIXED_DIGIT)

_SUFFIX = " ".join(f"WHEN regexp_matches(lower(t), '({'|'.join(e)})$') THEN '{c}'" for e, c in K.POS_SUFFIXES)
_view("view_pos", "digit", X.view_pos,
      f"CASE WHEN regexp_matches(t, '^\\p{{Nd}}+$') THEN 'CD' WHEN NOT regexp_matches(t, '^\\p{{L}}') THEN t "
      f"WHEN list_contains({STOP}, lower(t)) THEN 'FW' {_SUFFIX} "
      "WHEN regexp_matches(t, '^[A-Z]') AND NOT (i = 1 OR tok[i-1] IN ('.', '!', '?')) THEN 'NNP' "
      "WHEN suffix(lower(t), 's') THEN 'NNS' ELSE 'NN' END",
      K.MIXED_DIGIT)


@query("view_charclass", f"""WITH {U.CORPUS}, v AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
  '\\p{{L}}', 'a', 'g'), '\\p{{Nd}}', '9', 'g'), {q(K.SPACE)}, '_', 'g') AS s FROM corpus)
SELECT doc_id, length(s)::INT AS n_chars, md5(s) AS view_md5 FROM v""")
def view_charclass(spark, sf):
    v = C.documents(spark, sf).select("doc_id", X.view_charclass(F.col("text")).alias("s"))
    return v.select("doc_id", F.length("s").alias("n_chars"), F.md5("s").alias("view_md5"))


# --- crops -----------------------------------------------------------------------------

def _crops(name, build, body):
    """``build(text, tokens)`` gives one text; digest per document."""
    @query(name, f"""WITH {U.CORPUS}, t AS (SELECT doc_id, text, {U.WS_TOK} AS tok FROM corpus),
v AS (SELECT doc_id, text, {body} AS s FROM t)
SELECT doc_id, length(s)::INT AS n_chars, md5(s) AS crop_md5, (s <> text)::INT AS changed FROM v""")
    def run(spark, sf):
        t = C.documents(spark, sf).select("doc_id", "text", X.tok_ws(F.col("text")).alias("tok"))
        v = t.select("doc_id", "text", build(F.col("text"), F.col("tok")).alias("s"))
        return v.select("doc_id", F.length("s").alias("n_chars"), F.md5("s").alias("crop_md5"),
                        (F.col("s") != F.col("text")).cast("int").alias("changed"))


JOIN = "array_to_string(%s, ' ')"
_crops("crop_head", X.crop_head, f"CASE WHEN len(tok) > 187 THEN {JOIN % 'tok[1:187]'} ELSE text END")
_crops("crop_cond", lambda t, k: X.crop_head(t, k, longer_than=K.CROP_IF_LONGER),
       f"CASE WHEN len(tok) > 321 THEN {JOIN % 'tok[1:187]'} ELSE text END")
for _n in (75, 150, 300, 600):
    _crops(f"trunc_tokens_{_n}", lambda t, k, n=_n: X.trunc_tokens(k, n), JOIN % f"tok[1:{_n}]")
for _n in (500, 1000, 2000):
    _crops(f"trunc_chars_{_n}", lambda t, k, n=_n: F.substring(t, 1, n), f"left(text, {_n})")


def _truncations(name, sizes, build, body):
    """All lengths of one truncation in a single scan."""
    cases = ", ".join(f"md5({body(n)}) AS md5_{n}, length({body(n)})::INT AS n_{n}" for n in sizes)

    @query(name, f"WITH {U.CORPUS}, t AS (SELECT doc_id, text, {U.WS_TOK} AS tok FROM corpus) SELECT doc_id, {cases} FROM t")
    def run(spark, sf):
        t = C.documents(spark, sf).select("doc_id", "text", X.tok_ws(F.col("text")).alias("tok"))
        v = t.select("doc_id", *[build(n).alias(f"s{n}") for n in sizes])
        return v.select("doc_id", *[c for n in sizes for c in (F.md5(f"s{n}").alias(f"md5_{n}"), F.length(f"s{n}").alias(f"n_{n}"))])


_truncations("trunc_tokens", (75, 150, 300, 600), lambda n: X.trunc_tokens(F.col("tok"), n), lambda n: JOIN % f"tok[1:{n}]")
_truncations("trunc_chars", (500, 1000, 2000), lambda n: F.substring("text", 1, n), lambda n: f"left(text, {n})")
_crops("head_tail", lambda t, k: X.head_tail(k),
       f"CASE WHEN len(tok) > 400 THEN {JOIN % 'list_concat(tok[1:300], tok[len(tok)-99:len(tok)])'} ELSE {JOIN % 'tok'} END")
HASH = "('0x' || substr(md5('42:' || doc_id), 1, 12))::BIGINT"
_crops("crop_random", lambda t, k: X.crop_random(t, k, F.col("doc_id"), K.CROP),
       f"CASE WHEN len(tok) > 187 THEN array_to_string(tok[{HASH} % (len(tok) - 186) + 1 : {HASH} % (len(tok) - 186) + 187], ' ') ELSE text END")


def _explode_crops(spark, sf, build):
    t = C.documents(spark, sf).select("doc_id", "text", X.tok_ws(F.col("text")).alias("tok"))
    v = t.select("doc_id", F.posexplode(build(F.col("text"), F.col("tok"))).alias("crop", "s"))
    return v.select("doc_id", "crop", F.length("s").alias("n_chars"), F.md5("s").alias("crop_md5"))


@query("crop_multi", f"""WITH {U.CORPUS}, t AS (SELECT doc_id, text, {U.WS_TOK} AS tok FROM corpus),
v AS (SELECT doc_id, CASE WHEN len(tok) > 187 THEN [text, {JOIN % 'tok[1:187]'}, {JOIN % 'tok[len(tok)-186:len(tok)]'},
  {JOIN % 'tok[(len(tok)-187)//2 + 1:(len(tok)-187)//2 + 187]'}] ELSE [text] END AS l FROM t),
u AS (SELECT doc_id, unnest(l) AS s, unnest(range(0, len(l))) AS crop FROM v)
SELECT doc_id, crop::INT AS crop, length(s)::INT AS n_chars, md5(s) AS crop_md5 FROM u""")
def crop_multi(spark, sf):
    return _explode_crops(spark, sf, X.crop_multi)


SLIDE = f"""{U.CORPUS}, t AS (SELECT doc_id, text, {U.WS_TOK} AS tok FROM corpus),
st AS (SELECT *, CASE WHEN len(tok) <= 187 THEN [0] ELSE list_sort(list_distinct(list_concat(
  range(0, len(tok) - 186, 93), [len(tok) - 187]))) END AS starts FROM t),
u AS (SELECT doc_id, text, tok, unnest(starts) AS s0, unnest(range(0, len(starts))) AS crop FROM st),
windows AS (SELECT doc_id, text, crop, CASE WHEN len(tok) <= 187 THEN text ELSE {JOIN % 'tok[s0+1:s0+187]'} END AS s FROM u)"""


@query("sliding_windows", f"WITH {SLIDE} SELECT doc_id, crop::INT AS crop, length(s)::INT AS n_chars, md5(s) AS crop_md5 FROM windows")
def sliding_windows(spark, sf):
    return _explode_crops(spark, sf, X.sliding_windows)


@query("crop_modified", f"""WITH {SLIDE}, c AS (SELECT doc_id, count(*) AS k, max((s <> text)::INT) AS d FROM windows GROUP BY doc_id)
SELECT count(*) AS n_docs, sum((k > 1 OR d = 1)::INT)::BIGINT AS n_modified, sum(k)::BIGINT AS n_crops FROM c""")
def crop_modified(spark, sf):
    """How many documents the sliding crop changes, decided inside each row."""
    t = C.documents(spark, sf).select("text", X.tok_ws(F.col("text")).alias("tok"))
    v = t.select("text", X.sliding_windows(F.col("text"), F.col("tok")).alias("l"))
    changed = (F.size("l") > 1) | (F.get("l", F.lit(0)) != F.col("text"))
    return v.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(changed.cast("long")).alias("n_modified"),
                 F.sum(F.size("l")).alias("n_crops"))


@query("crop_mean_score", f"""WITH {SLIDE}, sc AS (SELECT doc_id, ln(1.0 + length(s)) - 6.5 AS score FROM windows)
SELECT doc_id, {r('avg(score)', 'score')}, (round(avg(score), 6) > 0)::INT AS label FROM sc GROUP BY doc_id""")
def crop_mean_score(spark, sf):
    """Mean linear score over a document's crops, label where it is positive."""
    c = _explode_crops(spark, sf, X.sliding_windows)
    m = c.groupBy("doc_id").agg(F.round(F.avg(F.log(1.0 + F.col("n_chars")) - 6.5), 6).alias("score"))
    return m.withColumn("label", (F.col("score") > 0).cast("int"))
