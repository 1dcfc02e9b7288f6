"""Tokenisers, n-grams, masked views and crops as JVM-side column expressions.

Functions that use their argument inside a lambda expect a plain attribute
(project the token array first), so the array is computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tok_alpha(text):
    return find_all(text, K.ALPHA_WORD)


def tok_alnum(text):
    return find_all(text, K.ALNUM_WORD)


def tok_lower_alnum(text):
    return find_all(F.lower(text), K.LOWER_ALNUM_WORD)


def tok_ws(text):
    return find_all(text, K.NOT_SPACE + "+")


def tok_vectorizer(text):
    """Runs of two or more letters, digits or underscores, lower-cased."""
    return find_all(F.lower(text), K.VECTORIZER_WORD)


def tok_mixed(text, kind="view"):
    return find_all(text, {"view": K.MIXED_VIEW, "punct": K.MIXED_PUNCT, "digit": K.MIXED_DIGIT}[kind])


def normalize_text(text):
    """Trim, lower-case and collapse whitespace (the duplicate key)."""
    squeezed = F.regexp_replace(F.lower(text), K.SPACE + "+", " ")
    return F.btrim(squeezed, F.lit(" "))


def prefix_md5(text, n=120):
    return F.md5(F.substring(normalize_text(text), 1, n))


def safe_div(a, b):
    """a / b, or 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# --- n-grams -----------------------------------------------------------------

def word_ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """All runs of ``n`` adjacent tokens, joined by ``sep``."""
    if n == 1:
        return tokens
    runs = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), runs)
    for k in range(2, n + 1):
        # lambdas see only their own arguments, so an inlined token array costs no more
        out = F.zip_with(out, F.slice(tokens, F.lit(k), runs), lambda a, b: F.concat(a, F.lit(sep), b))
    return out


def char_windows(text: Column, n: int) -> Column:
    """All overlapping windows of ``n`` characters, in one linear regex pass."""
    return find_all(text, rf"(?s)(?=(.{{{n}}})).", 1)


def padded_chunks(text: Column) -> Column:
    """Lower-cased whitespace chunks, each with one space on either side."""
    return F.concat(F.lit(" "), F.array_join(tok_ws(F.lower(text)), "  "), F.lit(" "))


def char_wb_ngrams(padded: Column, n: int, short: str = "drop", first: bool = True) -> Column:
    """``n``-grams inside padded chunks; a window may touch a space only at its ends.

    ``short='once'``: a padded chunk shorter than the smallest size of the range
    (``first``) is emitted whole, once.
    """
    shapes = [rf" [^ ]{{{n - 2}}} "] if n > 2 else []
    shapes += [rf" [^ ]{{{n - 1}}}", rf"[^ ]{{{n - 1}}} ", rf"[^ ]{{{n}}}"]
    grams = find_all(padded, rf"(?s)(?=({'|'.join(shapes)})).", 1)
    if short == "once" and first and n > 3:
        grams = F.concat(grams, find_all(padded, rf" [^ ]{{1,{n - 3}}} "))
    return grams


# --- per-document counting without a shuffle -----------------------------------

def count_terms(df: DataFrame, terms: str = "terms", keep=("doc_id", "block")) -> DataFrame:
    """(keep..., term, cnt) from an array column, counted inside the row.

    A document's terms sit in one row, so sorting that array and measuring its
    runs replaces the shuffle of a groupBy(document, term).
    """
    keep = list(keep)
    s, starts = F.col("_s"), F.col("_starts")
    runs = (
        df.select(*keep, F.sort_array(F.col(terms)).alias("_s"))
        .select(
            *keep, "_s",
            F.when(F.size(s) > 0, F.filter(
                F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))),
                lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
            )).alias("_starts"),
        )
    )
    pairs = F.transform(
        starts,
        lambda p, k: F.struct(
            F.get(s, p).alias("term"),
            (F.coalesce(F.get(starts, k + 1), F.size(s)) - p).cast("long").alias("cnt"),
        ),
    )
    return runs.select(*keep, F.explode(pairs).alias("_t")).select(*keep, "_t.term", "_t.cnt")


# --- masked ("topic-free") views -------------------------------------------------

def _is_punct(t):
    return t.rlike(r"^[!-/:-@\[-`{-~]$")


def view_func(tokens: Column, stop_words=K.FUNCTION_WORDS) -> Column:
    """Listed words and single ASCII punctuation stay; everything else is X."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(F.array_contains(stop, F.lower(t)), F.lower(t))
            .when(_is_punct(t), t)
            .otherwise(F.lit("X")),
        ),
        " ",
    )


def view_charclass(text: Column) -> Column:
    """Letter to a, digit to 9, whitespace to _; other characters stay."""
    out = F.regexp_replace(text, r"\p{L}", "a")
    out = F.regexp_replace(out, r"\p{Nd}", "9")
    return F.regexp_replace(out, K.SPACE, "_")


def view_skeleton(tokens: Column, stop_words=K.FUNCTION_WORDS, mask="pure") -> Column:
    """Listed words stay, other words become #.

    ``mask='pure'`` masks purely alphabetic tokens only (a token with an
    apostrophe stays raw); ``mask='initial'`` masks any token starting with a letter.
    """
    stop = F.array(*[F.lit(w) for w in stop_words])
    word = r"^\p{L}+$" if mask == "pure" else r"^\p{L}"
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(
                t.rlike(word),
                F.when(F.array_contains(stop, F.lower(t)), F.lower(t)).otherwise(F.lit("#")),
            ).otherwise(t),
        ),
        " ",
    )


def view_shape(tokens: Column) -> Column:
    """Casing codes: 0 number, U all capitals, C capitalised, w other word."""
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t.rlike(r"^\p{Nd}+$"), F.lit("0"))
            .when(t.rlike(r"^[A-Z]{2,}$"), F.lit("U"))
            .when(t.rlike(r"^[A-Z][A-Za-z]*$"), F.lit("C"))
            .when(t.rlike(r"^[A-Za-z]+$"), F.lit("w"))
            .otherwise(t),
        ),
        " ",
    )


def view_pos(tokens: Column, stop_words=K.FUNCTION_WORDS) -> Column:
    """Pseudo part of speech from suffix, casing and the token before."""
    stop = F.array(*[F.lit(w) for w in stop_words])

    def tag(t, before):
        low = F.lower(t)
        starts = before.isNull() | before.isin(".", "!", "?")
        out = F.when(t.rlike(r"^\p{Nd}+$"), F.lit("CD")).when(~t.rlike(r"^\p{L}"), t)
        out = out.when(F.array_contains(stop, low), F.lit("FW"))
        for endings, code in K.POS_SUFFIXES:
            out = out.when(low.rlike(f"({'|'.join(endings)})$"), F.lit(code))
        out = out.when(t.rlike(r"^\p{Lu}") & ~starts, F.lit("NNP"))
        return out.when(low.endswith("s"), F.lit("NNS")).otherwise(F.lit("NN"))

    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), tokens), 1, F.size(tokens))
    return F.array_join(F.zip_with(tokens, before, tag), " ")


# --- crops ------------------------------------------------------------------------

def crop_head(text, tokens, n=K.CROP, longer_than=None):
    """First ``n`` tokens when the text is longer than the limit, else the raw text."""
    limit = n if longer_than is None else longer_than
    return F.when(F.size(tokens) > limit, F.array_join(F.slice(tokens, 1, n), " ")).otherwise(text)


def window_at(tokens, start, n):
    """``n`` tokens from 0-based ``start``."""
    return F.array_join(F.slice(tokens, (start + 1).cast("int"), n), " ")


def crop_multi(text, tokens, n=K.CROP):
    """Full text plus its head, tail and middle crops."""
    size = F.size(tokens)
    mid = F.floor((size - n) / 2)
    return F.when(
        size > n,
        F.array(text, window_at(tokens, F.lit(0), n), window_at(tokens, size - n, n), window_at(tokens, mid, n)),
    ).otherwise(F.array(text))


def window_starts(size, n=K.CROP, stride=K.STRIDE):
    """Window starts every ``stride`` tokens plus the one aligned to the end."""
    last = F.greatest(size - n, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def sliding_windows(text, tokens, n=K.CROP, stride=K.STRIDE):
    size = F.size(tokens)
    return F.when(
        size > n, F.transform(window_starts(size, n, stride), lambda s: window_at(tokens, s, n))
    ).otherwise(F.array(text))


def hash_int(seed, key, digits=12):
    """Non-negative integer from the md5 of ``seed:key`` (same in any engine)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def hash_normal(seed, key):
    """Standard normal number from the md5 of ``seed:key`` (Box-Muller on its first 24 hex digits)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    unit = lambda at: (F.conv(F.substring(h, at, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.sqrt(-2.0 * F.log(unit(1))) * F.cos(2.0 * F.pi() * unit(13))


def crop_random(text, tokens, key, n, seed=42):
    """Seeded contiguous window of ``n`` tokens; short texts stay raw."""
    n = F.lit(n) if isinstance(n, int) else n
    start = F.pmod(hash_int(seed, key), (F.size(tokens) - n + 1).cast("long"))
    return F.when(
        F.size(tokens) > n,
        F.array_join(F.slice(tokens, (start + 1).cast("int"), n.cast("int")), " "),
    ).otherwise(text)


def trunc_tokens(tokens, n):
    return F.array_join(F.slice(tokens, 1, n), " ")


def head_tail(tokens, head=300, tail=100):
    size = F.size(tokens)
    return F.when(
        size > head + tail,
        F.concat_ws(" ", trunc_tokens(tokens, head), window_at(tokens, size - tail, tail)),
    ).otherwise(F.array_join(tokens, " "))
