"""Shared inputs of the registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import ranks
from ..session import new_folder, written
from ..sources import corpus as C


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def in_sql(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def list_sql(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def scratch(spark) -> str:
    """A fresh folder in the session's work folder (shared on a cluster)."""
    return new_folder(spark, "round-trip")


TOK = f"regexp_extract_all(lower(text), {q(K.VECTORIZER_WORD)})"
WS_TOK = f"regexp_extract_all(text, {q(K.NOT_SPACE + '+')})"
NORM = f"trim(regexp_replace(lower(text), {q(K.SPACE + '+')}, ' ', 'g'), ' ')"

CORPUS = """corpus AS (
  SELECT d.doc_id, coalesce(d.text, '') AS text, d.lang, d.source, l.quality AS label
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

WORDS = f"""{CORPUS},
toks AS (SELECT doc_id, label, {TOK} AS tok FROM corpus),
terms AS (SELECT doc_id, label, term, count(*) AS cnt
  FROM (SELECT doc_id, label, unnest(tok) AS term FROM toks) GROUP BY ALL)"""

# Two scores per document: a vocabulary-diversity leg and a length leg.
LEGS = f"""{CORPUS},
leg0 AS (SELECT doc_id, text, label, {TOK} AS tok FROM corpus),
leg1 AS (SELECT doc_id, label AS y,
    round(coalesce(4.0 * len(list_distinct(tok)) / nullif(len(tok), 0), 0) - 2.0, 6) AS m_a,
    round(ln(1.0 + length(text)) - 7.0, 6) AS m_b FROM leg0),
legs AS (SELECT *, round(1.0 / (1.0 + exp(-m_a)), 6) AS p_a, round(1.0 / (1.0 + exp(-m_b)), 6) AS p_b FROM leg1),
scored AS (SELECT * FROM legs WHERE y IS NOT NULL)"""


def legs(spark, sf):
    """doc_id, y, and margins and probabilities of the two legs."""
    d = C.corpus(spark, sf).select("doc_id", F.col("label").alias("y"), "text", X.tok_vectorizer(F.col("text")).alias("_t"))
    ratio = F.coalesce(F.try_divide(F.size(F.array_distinct("_t")) * F.lit(4.0), F.size("_t").cast("double")), F.lit(0.0))
    m = d.select(
        "doc_id", "y", F.round(ratio - 2.0, 6).alias("m_a"),
        F.round(F.log(1.0 + F.length("text")) - 7.0, 6).alias("m_b"))
    sig = lambda c: F.round(1.0 / (1.0 + F.exp(-F.col(c))), 6)
    return m.select("*", sig("m_a").alias("p_a"), sig("m_b").alias("p_b"))


def scored(spark, sf):
    return legs(spark, sf).where(F.col("y").isNotNull())


# Stratified 5-fold assignment of the labelled legs.
FOLDS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rk,
    count(*) OVER (PARTITION BY y) AS n FROM scored),
folded AS (SELECT * EXCLUDE (rk, n), (CASE WHEN rk < (n // 5 + 1) * (n % 5) THEN rk // (n // 5 + 1)
    ELSE n % 5 + (rk - (n // 5 + 1) * (n % 5)) // greatest(n // 5, 1) END)::INT AS fold FROM ranked)"""


def stored(scores):
    """Scores written once, so that ranks and splits, which read their input several times, never go back to the texts."""
    return written(scores, "scores")


def folded(spark, sf):
    return ranks.stratified_kfold(stored(scored(spark, sf)), "y")


def f1_sql(y="y", pred="pred") -> str:
    def one(a):
        tp = f"sum(CASE WHEN {y} = {a} AND {pred} = {a} THEN 1 ELSE 0 END)"
        off = f"sum(CASE WHEN ({y} = {a}) <> ({pred} = {a}) THEN 1 ELSE 0 END)"
        return f"coalesce(2.0 * {tp} / nullif(2 * {tp} + {off}, 0), 0)"
    return f"(({one(0)} + {one(1)}) / 2)"
