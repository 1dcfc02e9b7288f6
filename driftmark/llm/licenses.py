"""License scans: exact seeds of a pigeonhole split find candidates, bounded-error matching verifies them."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The phrases whose places are counted exactly.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Further short notices, as (label, words).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("proprietary", "all rights reserved"),
)
#: Bytes that are no part of a word become spaces, A-Z becomes a-z.
_TABLE = bytes(x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` consecutive pieces with their offsets: a match with so few errors holds one unchanged."""
    n = errors + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def scanner(base=None, notices=NOTICES, chars_per_error=10):
    """A function from a text to (number of words, base places, matches); a notice may hold one error per
    ``chars_per_error`` characters. Places are (label, first word); matches (label, first word, last word, errors)."""
    import ahocorasick
    import regex

    base = BASE if base is None else base
    listed = [*base.items(), *notices]
    allowed = [len(x) // chars_per_error for _, x in listed]
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, (_, x) in enumerate(listed):
        for offset, piece in pieces(x, allowed[i]):
            seeds.setdefault(piece, []).append((i, offset))
    auto = ahocorasick.Automaton()
    for piece, where in seeds.items():
        auto.add_word(piece, (len(piece), where))
    auto.make_automaton()
    loose = [regex.compile(f"(?e)(?:{regex.escape(x)}){{e<={k}}}") for (_, x), k in zip(listed, allowed)]

    def scan(text: str | None):
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
        line = " " + b" ".join(words).decode("latin-1") + " "
        spaces: list[int] = []

        def word(p):  # the word that begins at this place
            if not spaces:
                at = -1
                for w in words:
                    at += 1
                    spaces.append(at)
                    at += len(w)
            return bisect_left(spaces, p) - 1

        starts: dict[int, set[int]] = {}
        for end, (n, where) in auto.iter(line):
            for i, offset in where:
                starts.setdefault(i, set()).add(end - n + 1 - offset)
        places, matches = [], []
        for i, found in sorted(starts.items()):
            label, notice = listed[i]
            n, k = len(notice), allowed[i]
            if i < len(base):
                for p in sorted(found):
                    if p > 0 and line[p - 1:p + n + 1] == f" {notice} ":
                        places.append((label, word(p)))
            done = 0
            windows: list[list[int]] = []
            for p in sorted(found):
                a, b = max(0, p - k), min(len(line), p + n + k)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            for a, b in windows:
                for m in loose[i].finditer(line, max(a, done), b):
                    # a short notice inside a longer word is none
                    if k == 0 and not (line[m.start() - 1] == " " and line[m.end()] == " "):
                        continue
                    done = m.end()
                    s, e = m.span()
                    while s < e and line[s] == " ":
                        s += 1
                    while e > s and line[e - 1] == " ":
                        e -= 1
                    matches.append((label, word(s), word(e), sum(m.fuzzy_counts), n))
        return len(words), sorted(places, key=lambda x: (x[1], x[0])), sorted(matches, key=lambda x: (x[1], x[2], x[0]))

    return scan


def license_spans(docs: DataFrame, key="doc_id", text="text", **options) -> DataFrame:
    """One row per document: ``n_words``, exact ``places`` and fuzzy ``matches`` (labels, word spans, errors).

    The words of a text (A-Z lower-cased, joined by one space) are searched for the pieces of all notices at
    once; candidates lie where a piece does, give or take the errors, and the regex library's bounded-error
    matching decides. Errors count in UTF-8 bytes. Null and empty texts have no words and no match; a null
    id is kept; every row of repeated rows is scanned; overlapping matches of one notice count once. Time is linear in
    the text. An empty table gives no rows; only id and text are read, so other columns may have any name.
    """

    def make():
        scan = scanner(**options)

        def fn(texts):
            got = [scan(t) for t in texts.to_pylist()]
            return ([n for n, _, _ in got], [[dict(zip(("label", "first"), p)) for p in ps] for _, ps, _ in got],
                    [[dict(zip(("label", "first", "last", "errors", "length"), m)) for m in ms] for _, _, ms in got])
        return fn

    return C.map_texts(docs, make, "n_words bigint, places array<struct<label:string,first:bigint>>, matches "
                       "array<struct<label:string,first:bigint,last:bigint,errors:bigint,length:bigint>>", (key,), text)


def license_table(docs: DataFrame, key="doc_id", **options) -> DataFrame:
    """The digest of ``license_spans``: counts, first and last place, labels, and as ``score`` the best
    match's share of unchanged characters (1 for an exact notice, 0 without one)."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own = F.transform("places", lambda x: x["label"])
    best = F.array_max(F.transform("matches", lambda m: F.lit(1.0) - m["errors"] / m["length"]))
    return license_spans(docs, key, **options).select(
        key, "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["first"])).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.transform("matches", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.coalesce(best, F.lit(0.0)))).alias("score"))
