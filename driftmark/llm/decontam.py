"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from . import common as C

#: Edits allowed per character of an item.
ERROR_RATE = 0.08
#: Places of items shorter than this many characters must begin and end at the edge of a word.
SHORT = 40
#: Characters of items that one pass over the documents searches for.
BLOCK_CHARS = 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate=ERROR_RATE) -> int:
    return int(len(item) * rate)


def edge(line: str, i: int) -> bool:
    """Whether no word goes on over place ``i``."""
    inner = lambda c: c.isalnum() or c == "_"
    return not (0 < i < len(line) and inner(line[i - 1]) and inner(line[i]))


def piece_cuts(n: int, errors: int) -> list[tuple[int, int]]:
    """``errors + 1`` consecutive pieces of ``n`` characters: so few edits leave one of them unchanged."""
    return [(n * i // (errors + 1), n * (i + 1) // (errors + 1)) for i in range(errors + 1)]


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distances(masks: dict[str, int], n: int, text: str, anywhere=True):
    """Myers' recurrence: the least edit distance of the pattern to a piece of ``text`` that ends at each
    character; with ``anywhere`` false the piece must start at the text's start."""
    full, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, get = full, 0, n, masks.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full if anywhere else ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        yield score


class Matcher:
    """Finds the places of items in normalised texts."""

    def __init__(self, items: list[str], rate=ERROR_RATE):
        import ahocorasick

        self.items = items
        self.errors = [budget(x, rate) for x in items]
        self.masks = [char_masks(x) for x in items]
        self.back = [char_masks(x[::-1]) for x in items]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, x in enumerate(items):
            for a, b in piece_cuts(len(x), self.errors[i]):
                seeds.setdefault(x[a:b], []).append((i, a))
        self.auto = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.auto.add_word(piece, (len(piece), where))
        if seeds:
            self.auto.make_automaton()

    def find(self, line: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of non-overlapping places within each item's budget."""
        if not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, (n, where) in self.auto.iter(line):
            for i, offset in where:
                starts.setdefault(i, set()).add(end - n + 1 - offset)
        found = []
        for i, places in starts.items():
            item, k = self.items[i], self.errors[i]
            n = len(item)
            windows: list[list[int]] = []
            for p in sorted(places):
                if line.startswith(item, max(p, 0)) and p >= 0:
                    if n >= SHORT or edge(line, p) and edge(line, p + n):
                        found.append((i, p, p + n, 0))
                        continue
                if k:
                    a, b = max(0, p - k), min(len(line), p + n + k)
                    if windows and a <= windows[-1][1]:
                        windows[-1][1] = max(windows[-1][1], b)
                    elif b > a:
                        windows.append([a, b])
            exact = [f for f in found if f[0] == i]
            for a, b in windows:
                if any(a <= s and e <= b for _, s, e, _ in exact) and b - a <= n + 4 * k:
                    continue  # the exact place explains the window's pieces
                found += [(i, s, e, d) for s, e, d in self._verify(i, line, a, b) if not any(s < y and x < e for _, x, y, _ in exact)]
        return sorted(found, key=lambda f: (f[1], f[0]))

    def _verify(self, i, line, a, b):
        n, k = len(self.items[i]), self.errors[i]
        if n < SHORT:
            yield from self._verify_words(i, line, a, b)
            return
        best = None  # of the current run of ends within budget
        for e, d in enumerate(distances(self.masks[i], n, line[a:b]), a + 1):
            if best and e - best[0] > n // 2:
                yield self._place(i, line, a, *best)
                best = None
            if d <= k and (best is None or d < best[1]):
                best = (e, d)
        if best:
            yield self._place(i, line, a, *best)

    def _verify_words(self, i, line, a, b):
        """Places of a short item from word edge to word edge, the nearest first, that don't overlap."""
        n, k = len(self.items[i]), self.errors[i]
        places = []
        for e, d in enumerate(distances(self.masks[i], n, line[a:b]), a + 1):
            if d <= k and edge(line, e):
                back = line[max(0, e - n - k):e][::-1]
                places += [(x, e - length, e) for length, x in enumerate(distances(self.back[i], n, back, anywhere=False), 1) if x <= k and edge(line, e - length)]
        taken: list[tuple[int, int]] = []
        for d, s, e in sorted(places, key=lambda x: (x[0], x[1], -x[2])):
            if not any(s < y and x < e for x, y in taken):
                taken.append((s, e))
                yield s, e, d

    def _place(self, i, line, a, e, d):
        """The start, by the same recurrence run backwards from the end."""
        n = len(self.items[i])
        back = line[max(a, e - n - d):e][::-1]
        for length, x in enumerate(distances(self.back[i], n, back, anywhere=False), 1):
            if x == d:
                return e - length, e, d
        return max(a, e - n), e, d


def _search(docs, items, rate, key, text):
    """One pass over the documents for a bounded block of (text, ids)."""
    texts = [t for t, _ in items]
    out = StructType([StructField("_key", docs.schema[key].dataType), *_parse_datatype_string(
        "_item int, first bigint, last bigint, edits bigint, similarity double").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        m = Matcher(texts, rate)
        for whole in batches:
            for b in C.slices(whole, 1):
                rows = [(k, *f, 1 - f[3] / len(texts[f[0]])) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in m.find(normal(t))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)], schema=arrow)

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, out)


def leaks(docs: DataFrame, items: DataFrame, rate=ERROR_RATE, key="doc_id", item="item_id", text="text", block_chars=BLOCK_CHARS) -> DataFrame:
    """One row per place where a document holds an item within its error budget: ``key``, ``item``, ``first``
    and ``last`` (characters of the normalised text, end exclusive), ``edits`` and ``similarity``.

    Texts are lower-cased with one space between words. An item of n characters may differ by rate * n edits
    (insert, delete, replace); one of its budget + 1 pieces then stands unchanged, all pieces of all items are
    found in one automaton pass, and Myers' distance over the window around a hit decides. Items of fewer than
    ``SHORT`` characters must begin and end at the edge of a word. Items are a stated query set: they are read in
    blocks of about ``block_chars`` characters, one pass over the documents each, and only a block is ever
    on the driver. Items with one normalised text are searched once and reported each. Null and empty texts
    and items have no match; null ids are reported as null; repeated documents are each reported.
    An empty table on either side gives no rows. Only ids and texts are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    plain = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    listed = items.select(F.col(item).alias("_id"), F.col(text).alias("_t")).where(F.coalesce(F.length(plain), F.lit(0)) > 0)
    total = listed.agg(F.sum(F.length("_t"))).first()[0] or 0
    blocks = -(-total // block_chars)
    kind = items.schema[item].dataType
    out = None
    for b in range(blocks):
        rows = listed.where(F.pmod(F.xxhash64("_t"), F.lit(blocks)) == b).collect()
        by: dict[str, list] = {}
        for i, t in rows:
            if normal(t):
                by.setdefault(normal(t), []).append(i)
        block = sorted(by.items())
        ids = spark.createDataFrame([(n, i) for n, (_, own) in enumerate(block) for i in own],
                                    StructType([StructField("_item", _parse_datatype_string("x int").fields[0].dataType), StructField(item, kind)]))
        found = _search(docs, block, rate, key, text).join(ids, "_item").select(
            F.col("_key").alias(key), item, "first", "last", "edits", "similarity")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], StructType([StructField(key, docs.schema[key].dataType), StructField(item, kind), *_parse_datatype_string(
            "first bigint, last bigint, edits bigint, similarity double").fields]))
    return out


def decontaminated(docs: DataFrame, items: DataFrame, key="doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; columns as given. Rows with a null id stay unless their text
    itself holds an item: they are searched by the hash of their text."""
    marked = docs.withColumn("__dm_x", F.xxhash64(options.get("text", "text")))
    bad = leaks(marked, items, key="__dm_x", **options).select("__dm_x").distinct()
    return marked.join(bad, "__dm_x", "left_anti").select(*docs.columns)
