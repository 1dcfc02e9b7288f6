"""Toxicity: token log-odds with Dirichlet priors, all maximal segments, extreme-value calibration."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import new_folder, written
from . import common as C

#: Characters of the word starts that give a word's prior, from the loosest to the word itself (0).
LEVELS = (3, 4, 5, 6, 7, 8, 0)
#: Documents' worth of prior that each level takes from the one before.
PRIOR = 8.0
#: A segment is significant when fewer than so many such segments are expected in a clean text.
E_VALUE = 0.3
#: Labels (an id and a number each) that are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows and bytes of text that share a dictionary; bounds the tasks that join them with the counts.
CHUNK_ROWS, CHUNK_BYTES = 16_384, 12 << 20
#: Words of chunks in a range, ranges at most (their cut points go to every task), marks of a chunk, marks that are cut.
RANGE_WORDS, MOST_RANGES, MARKS, MARK_SAMPLE = 500_000, 20_000, 64, 200_000
_BINS = np.concatenate((np.arange(0, 4, 0.25), np.arange(4, 20, 0.5), np.arange(20, 100, 5), [1e300]))


def _stripped(words: pa.Array) -> pa.Array:
    """Words without the punctuation at either end (a word of punctuation stays)."""
    bare = pc.utf8_trim(words, "\"'`.,;:!?()[]{}<>*_-")
    return pc.if_else(pc.equal(pc.binary_length(bare), 0), words, bare)


def packed(codes: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """Codes of ``n`` texts as bytes: seven bits a byte, the last byte of each code below 128."""
    width = 1 + sum((codes >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    end = np.concatenate(([0], np.cumsum(width)))
    out = np.zeros(end[-1], np.uint8)
    for k in range(5):
        has = width > k
        out[end[1:][has] - 1 - k] = (codes[has] >> 7 * k) & 127 | (128 if k else 0)
    ends = end[np.searchsorted(at, np.arange(n + 1))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(out)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts, and each text's number of them."""
    parts = column.to_pylist()
    data = np.frombuffer(b"".join(parts), np.uint8)
    last = data < 128
    before = np.concatenate(([0], np.cumsum(last)))
    size = np.diff(before[np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))])
    if not len(data):
        return np.zeros(0, np.int64), size
    end = np.flatnonzero(last)
    start = np.concatenate(([0], end[:-1] + 1))
    k = np.repeat(end, end - start + 1) - np.arange(len(data))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * k, start), size


def squeezed(*arrays: np.ndarray) -> bytes:
    """Integer and float arrays as one compressed value; ``loosened`` gives them back."""
    parts = [np.array([len(x) for x in arrays], np.int64).tobytes()]
    for x in arrays:  # bytes of equal weight lie together
        parts.append(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")
    return zstandard.compress(b"".join(parts), 3)


def loosened(value: bytes, *types) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.decompress(value), np.uint8)
    sizes = data[:8 * len(types)].view(np.int64)
    out, at = [], 8 * len(types)
    for n, t in zip(sizes.tolist(), types):
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(data[at:at + n * width].reshape(width, n).T).view(t).ravel())
        at += n * width
    return out


def _letters(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of strings without nulls."""
    s = strings.cast(pa.large_binary())
    ends = np.frombuffer(s.buffers()[1], np.int64)[s.offset:s.offset + len(s) + 1] if len(s) else np.zeros(1, np.int64)
    data = np.frombuffer(s.buffers()[2], np.uint8)[ends[0]:ends[-1]] if len(s) and s.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.diff(ends).astype(np.int32), data


def _strings(length: np.ndarray, data: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
    return pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


#: Values that a chunk's words, its counts and its words' priors are kept as, see ``squeezed``.
WORDS = (np.int32, np.uint8)
RANGED = (np.int32, np.uint8, np.int32)
COUNTS = (np.int32, np.uint8, np.uint8, np.int32, np.int32)
PRIORS = (np.int32, np.float32, np.int32, np.int32)


def encoded(docs: DataFrame, key="doc_id", text="text") -> tuple[DataFrame, DataFrame]:
    """Texts as codes of their chunk's words, and per chunk its words in code order (chunk, tokens, n, marks).

    Frequent words have the shorter codes; words whose codes are equally long are in order, so that a chunk's words
    compress well. ``marks`` are evenly spaced words of the chunk, from which ranges are cut.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    out = StructType([StructField("id", docs.schema[key].dataType), *_parse_datatype_string(
        "kind int, chunk bigint, codes binary, tokens binary, n int, marks array<string>").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def batch(rows_, **own):
        cols = [own[f.name].cast(f.type) if f.name in own else pa.nulls(rows_, f.type) for f in arrow]
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        for b in C.gathered(batches, 1, CHUNK_BYTES, CHUNK_ROWS):
            chunk = (part << 24) + count
            count += 1
            words, at = C.words_of(pc.utf8_lower(b.column(1).combine_chunks().cast(pa.string())), lower=False)
            code, distinct = C.coded(_stripped(words))
            often = np.argsort(-np.bincount(code, minlength=len(distinct)), kind="stable")
            place = np.empty(len(often), np.int64)
            place[pc.sort_indices(distinct).to_numpy()] = np.arange(len(often))
            width = np.searchsorted([1 << 7, 1 << 14, 1 << 21, 1 << 28], np.arange(len(often)), side="right")
            order = often[np.lexsort((place[often], width))]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            yield batch(b.num_rows, id=b.column(0).combine_chunks(), kind=pa.array(np.zeros(b.num_rows, np.int32)),
                        chunk=pa.array(np.full(b.num_rows, chunk)), codes=packed(rank[code], at, b.num_rows))
            if len(distinct):
                by_name = np.argsort(place)
                some = np.unique(np.linspace(0, len(distinct) - 1, MARKS).astype(np.int64))
                yield batch(1, kind=pa.array([1]), chunk=pa.array([chunk]), tokens=pa.array([squeezed(*_letters(distinct.take(pa.array(order))))], pa.binary()),
                            n=pa.array([len(distinct)]), marks=pa.array([distinct.take(pa.array(by_name[some])).to_pylist()]))
            pa.default_memory_pool().release_unused()

    folder = new_folder(spark, "encoded")
    rows.mapInArrow(run, out).write.partitionBy("kind").parquet(folder)
    read = lambda: spark.read.schema(out).parquet(folder)
    return read().where("kind = 0").select("chunk", "id", "codes"), read().where("kind = 1").select("chunk", "tokens", "n", "marks")


def word_table(words: DataFrame) -> DataFrame:
    """(chunk, token, code) of every chunk's words."""
    def run(batches):
        for b in batches:
            for chunk, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = _strings(*loosened(tokens, *WORDS)).cast(pa.string())
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(s), chunk)), "token": s, "code": pa.array(np.arange(len(s), dtype=np.int32))})

    return words.select("chunk", "tokens").mapInArrow(run, "chunk bigint, token string, code int")


def cut_points(words: DataFrame, size=None) -> list[bytes]:
    """Words at which the ranges after the first begin, each range for about ``size`` words of chunks.

    Cut from a hash-drawn sample of the chunks' marks. They only place the work: every range count gives the same priors.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    ranges = min(-(-total // (size or RANGE_WORDS)), MOST_RANGES)
    if ranges < 2:
        return []
    marks = words.select("chunk", F.explode("marks").alias("m")).orderBy(F.xxhash64("m", "chunk"), "m", "chunk").limit(MARK_SAMPLE)
    found = sorted(r[0].encode() for r in marks.select("m").collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)})


class Names:
    """Sorted strings as bytes, each made when it is looked at."""

    def __init__(self, strings: pa.Array):
        self.held = strings.cast(pa.large_binary())

    def __len__(self):
        return len(self.held)

    def __getitem__(self, i):
        return self.held[i].as_py()


def _ranges(strings: pa.Array, cuts: list[bytes]) -> tuple[list[int], Names]:
    """Where each range begins and ends in sorted strings, and the strings."""
    held = Names(strings)
    return [0, *(bisect_left(held, c) for c in cuts), len(held)], held


def counted(train: DataFrame, words: DataFrame, cuts=()) -> DataFrame:
    """(range, counts): per chunk and range, training texts, and toxic ones, that hold a word, or a word that starts
    with a string. A start has as many letters as its level; a shorter word counts at that level as itself.

    A start sorts before all words that begin with it. Those may lie in later ranges: the starts of a range's
    cut point (six at most) are handed on to that range as well, so that no start is a join key.
    """
    cuts = list(cuts)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"range": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
        code, size = unpacked(left.column("codes").combine_chunks())
        token = _strings(*loosened(right.column("tokens")[0].as_py(), *WORDS))
        y = left.column("label").to_numpy().astype(np.int64)
        pair = np.unique(np.repeat(np.arange(len(size)), size) * np.int64(max(1, len(token))) + code)
        doc, word = pair // max(1, len(token)), pair % max(1, len(token))
        length = pc.utf8_length(token).to_numpy(zero_copy_only=False)
        strings, whole, ns, toxics = [], [], [], []
        for level in LEVELS:
            start, distinct = C.coded(pc.utf8_slice_codeunits(token, 0, level) if level else token)
            full = length[word] >= level
            own = np.unique(doc[full] * np.int64(max(1, len(distinct))) + start[word[full]])
            of, at = own // max(1, len(distinct)), own % max(1, len(distinct))
            n, toxic = np.bincount(at, minlength=len(distinct)), np.bincount(at, y[of], len(distinct))
            held = np.flatnonzero(n)
            strings.append(distinct.take(pa.array(held)).cast(pa.large_string()))
            whole.append(np.full(len(held), level == 0, np.uint8))
            ns.append(n[held].astype(np.int32))
            toxics.append(toxic[held].astype(np.int32))
        s, whole, ns, toxics = pa.concat_arrays(strings), np.concatenate(whole), np.concatenate(ns), np.concatenate(toxics)
        order = pc.sort_indices(s).to_numpy()
        s, whole, ns, toxics = s.take(pa.array(order)), whole[order], ns[order], toxics[order]
        ends, names = _ranges(s, cuts)
        out = {"range": [], "counts": []}
        for r in range(len(cuts) + 1):
            handed = []
            for level in LEVELS[:-1] if r else ():
                start = cuts[r - 1].decode()[:level].encode()
                i = bisect_left(names, start)
                while start != cuts[r - 1] and i < ends[r] and names[i] == start:
                    handed += [i] if not whole[i] else []
                    i += 1
            rows = np.unique(np.concatenate((np.array(handed, np.int64), np.arange(ends[r], ends[r + 1]))))
            if len(rows):
                # 2: a start that another range has as its own
                kind = np.where(rows < ends[r], 2, whole[rows]).astype(np.uint8)
                out["range"].append(r)
                out["counts"].append(squeezed(*_letters(s.take(pa.array(rows))), kind, ns[rows], toxics[rows]))
        return pa.table({"range": pa.array(out["range"], pa.int64()), "counts": pa.array(out["counts"], pa.binary())})

    return train.groupBy("chunk").cogroup(words.select("chunk", "tokens").groupBy("chunk")).applyInArrow(count, "range bigint, counts binary")


def count_table(counts: DataFrame) -> DataFrame:
    """(whole, string, n, toxic) over all chunks."""
    def run(batches):
        for b in batches:
            for value in b.column(0).to_pylist():
                length, data, kind, n, toxic = loosened(value, *COUNTS)
                own = pa.array(kind < 2)
                yield pa.RecordBatch.from_pydict({"whole": pa.array(kind == 1), "string": _strings(length, data).cast(pa.string()),
                                                  "n": pa.array(n.astype(np.int64)), "toxic": pa.array(toxic.astype(np.int64))}).filter(own)

    parts = counts.select("counts").mapInArrow(run, "whole boolean, string string, n bigint, toxic bigint")
    return parts.groupBy("whole", "string").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _in_ranges(words: DataFrame, cuts: list[bytes]) -> DataFrame:
    """(range, chunk, tokens): each chunk's words by range, with their codes."""
    def run(batches):
        for b in batches:
            for chunk, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = _strings(*loosened(tokens, *WORDS))
                order = pc.sort_indices(s).to_numpy()
                s = s.take(pa.array(order))
                ends, _ = _ranges(s, cuts)
                held = [r for r in range(len(cuts) + 1) if ends[r] < ends[r + 1]]
                values = [squeezed(*_letters(s.slice(ends[r], ends[r + 1] - ends[r])), order[ends[r]:ends[r + 1]].astype(np.int32)) for r in held]
                yield pa.RecordBatch.from_pydict({"range": pa.array(held, pa.int64()), "chunk": pa.array([chunk] * len(held), pa.int64()), "tokens": pa.array(values, pa.binary())})

    return words.select("chunk", "tokens").mapInArrow(run, "range bigint, chunk bigint, tokens binary")


class Model:
    """Base rate, and after the fit the decay and rate of clean segment scores and the score's levels."""

    def __init__(self, docs, toxic_docs):
        self.base = (toxic_docs + 0.5) / (docs + 1.0)
        self.decay, self.rate = 1.0, 1.0
        self.levels = None

    def priors(self, words: DataFrame, counts: DataFrame, cuts=()) -> DataFrame:
        """(chunk, priors): code, prior, n and toxic of the chunk's words that a count bears on: what the word's starts
        say of the share of toxic texts, and the word's own texts.

        Each level is a binomial under a Dirichlet prior whose mean is the level before, and counts what the next
        one does not, so no document counts twice. Words and counts meet by range; a range holds all starts of its words.
        """
        base = float(self.base)

        def prior(left: pa.Table, right: pa.Table) -> pa.Table:
            empty = pa.table({"chunk": pa.array([], pa.int64()), "priors": pa.array([], pa.binary())})
            if not left.num_rows or not right.num_rows:
                return empty
            parts = [loosened(x, *COUNTS) for x in left.column("counts").to_pylist()]
            table = pa.table({"whole": np.concatenate([p[2] for p in parts]) == 1, "string": pa.concat_arrays([_strings(*p[:2]) for p in parts]),
                              "n": np.concatenate([p[3] for p in parts]).astype(np.int64), "toxic": np.concatenate([p[4] for p in parts]).astype(np.int64)})
            table = table.group_by(["whole", "string"]).aggregate([("n", "sum"), ("toxic", "sum")])
            held = [loosened(x, *RANGED) for x in right.column("tokens").to_pylist()]
            of, token = C.coded(pa.concat_arrays([_strings(*x[:2]) for x in held]))
            length = pc.utf8_length(token).to_numpy(zero_copy_only=False)
            found = {}
            for level in reversed(LEVELS):
                known = table.filter(pc.equal(table["whole"], level == 0))
                at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(token, 0, level) if level else token, known["string"].combine_chunks()), -1).to_numpy()
                n, t = (np.append(known[c].to_numpy(), 0)[at] for c in ("n_sum", "toxic_sum"))
                if level:  # a level of more letters than the word has holds the word alone
                    n, t = (np.where(length < level, w, x) for w, x in zip(found[0], (n, t)))
                found[level] = n, t
            p = np.full(len(token), base)
            for (n, t), (m, u) in zip([found[x] for x in LEVELS], [found[x] for x in LEVELS[1:]]):
                n, t = np.maximum(n - m, 0), np.maximum(t - u, 0)
                p = (np.minimum(t, n) + PRIOR * p) / (n + PRIOR)
            known = np.any([n > 0 for n, _ in found.values()], axis=0)
            out, at = [], 0
            for x in held:
                mine = of[at:at + len(x[2])]
                at += len(x[2])
                some = known[mine]
                mine = mine[some]
                out.append(squeezed(x[2][some], p[mine].astype(np.float32), found[0][0][mine].astype(np.int32), found[0][1][mine].astype(np.int32)))
            return pa.table({"chunk": right.column("chunk"), "priors": pa.array(out, pa.binary())})

        met = counts.groupBy("range").cogroup(_in_ranges(words, list(cuts)).groupBy("range"))
        return written(met.applyInArrow(prior, "chunk bigint, priors binary"), "priors")

    def log_odds(self, prior: np.ndarray, n: np.ndarray, toxic: np.ndarray, own=None) -> np.ndarray:
        """Log-odds of words over the base. ``own`` (a 0/1 label per row) takes the row's own document out of the
        counts; it counts in every level of the word, so only the word's own level changes."""
        if own is not None:
            n, toxic = np.maximum(n - 1, 0), np.maximum(toxic - own, 0)
        p = ((np.minimum(toxic, n) + PRIOR * prior) / (n + PRIOR)).clip(1e-6, 1 - 1e-6)
        return np.log(p / (1 - p)) - np.log(self.base / (1 - self.base))


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, end, score), in one pass over the positive places.

    Candidates keep the sums left of and up to their end; a new one joins back over the candidate whose left
    sum is the latest that is lower, if its own right sum is higher (Ruzzo and Tompa).
    """
    places = np.flatnonzero(score > 0)
    if not len(places):
        return []
    total = np.cumsum(score)
    stack: list[list[float]] = []  # start, end, left sum, right sum
    for i in places.tolist():
        left, right, start = (total[i - 1] if i else 0.0), total[i], i
        while True:
            j = len(stack) - 1
            skipped = []
            while j >= 0 and stack[j][2] >= left:
                skipped.append(j)
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append([start, i + 1, left, right])
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(int(s), int(e), float(r - l)) for s, e, l, r in stack]


def _scored(model: Model, codes: pa.Array, right: pa.Table, own=None):
    """For each text of a chunk: its number of words, and its maximal segments under the log-odds less a drift."""
    code, size = unpacked(codes)
    most = int(code.max()) + 1 if len(code) else 0
    prior, n, toxic = np.full(most, model.base), np.zeros(most), np.zeros(most)
    for value in right.column("priors").to_pylist():
        place, *cols = loosened(value, *PRIORS)
        known = place < most
        for x, c in zip((prior, n, toxic), cols):
            x[place[known]] = c[known]
    whole = model.log_odds(prior, n, toxic)
    out, a = [], 0
    for i, k in enumerate(size.tolist()):
        c = code[a:a + k]
        # in training each document is scored by counts without its own
        s = whole[c] if own is None else model.log_odds(prior[c], n[c], toxic[c], own[i])
        out.append((k, maximal_segments(s - DRIFT)))
        a += k
    return out


#: Taken from every token's log-odds, so that clean text scores below zero on average.
DRIFT = 1.0


def _evidence(model: Model, n: int, segments) -> tuple[float, float, list]:
    """(sum statistic of the significant segments, least E-value, those segments with E-values)."""
    kept, total, best = [], 0.0, float(max(n, 1)) * model.rate
    for s, e, x in segments:
        expected = model.rate * n * np.exp(-model.decay * x)
        best = min(best, expected)
        if expected < E_VALUE:
            kept.append((s, e, x, float(expected)))
            total += -np.log(max(expected, 1e-300))
    return total, best, kept


def best_scores(batches):
    """(i, n, words): histogram of the clean texts' best segment scores, and these texts' words, from (label,
    n_words, scores) batches."""
    hist = np.zeros((2, len(EDGES) - 1))
    for b in batches:
        for t, k, xs in zip(*(c.to_pylist() for c in b.columns)):
            if not t and k:
                i = int(np.searchsorted(EDGES, max(xs, default=0.0), side="right")) - 1
                hist[0, i] += 1
                hist[1, i] += k
    at = np.flatnonzero(hist[0])
    yield pa.RecordBatch.from_pydict({"i": pa.array(at.astype(np.int32)), "n": pa.array(hist[0, at]), "words": pa.array(hist[1, at])})


def evidence_levels(model: Model, batches):
    """(i, clean, toxic): histogram of the texts' evidence by label, from (label, n_words, scores) batches."""
    hist = np.zeros((2, len(_BINS)))
    for b in batches:
        for t, k, xs in zip(*(c.to_pylist() for c in b.columns)):
            hist[int(t == 1), int(np.searchsorted(_BINS, _evidence(model, k, [(0, 0, x) for x in xs])[0], side="right")) - 1] += 1
    yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(_BINS), dtype=np.int32)), "clean": pa.array(hist[0]), "toxic": pa.array(hist[1])})


def tail(model: Model, clean) -> None:
    """Decay and rate of the model from the (summed) histogram of ``best_scores``."""
    if len(clean):
        i, w = clean["i"].to_numpy(), clean["n"].to_numpy()
        x = (EDGES[i] + np.minimum(EDGES[i + 1], EDGES[-2])) / 2
        at = np.searchsorted(np.cumsum(w), 0.75 * w.sum())
        over = np.maximum(x - x[at], 0)
        model.decay = float(np.clip(w[at:].sum() / max((over * w).sum(), 1e-9), 0.3, 3.0))
        model.rate = float(w.sum() / max((clean["words"].to_numpy() * np.exp(-model.decay * x)).sum(), 1e-9))


def fit(train: DataFrame, words: DataFrame) -> tuple[Model, DataFrame] | None:
    """Model and word priors from the training texts (chunk, label, codes).

    Segment scores of clean texts have an exponential tail: its decay is one over the mean excess of each clean
    text's best segment over their upper quartile, and for that decay n * exp(-decay * best) has an exponential
    distribution whose mean gives the rate (the expected number of segments a word above score zero). Texts are
    scored here by counts without themselves. The sum of the significant segments' -log E is then mapped to
    the share of toxic texts by pooled, monotone bins. Only histograms of fixed size go to the driver.
    """
    by = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    if not by:
        return None
    model = Model(sum(by.values()), by.get(1, 0))
    cuts = cut_points(words)
    priors = model.priors(words, counted(train, words, cuts), cuts)
    ddl = "label int, n_words bigint, scores array<double>"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        y = left.column("label")
        got = _scored(model, left.column("codes").combine_chunks(), right, y.to_numpy())
        return pa.table({"label": y.cast(pa.int32()), "n_words": pa.array([k for k, _ in got], pa.int64()),
                         "scores": pa.array([[x for _, _, x in xs] for _, xs in got], pa.list_(pa.float64()))})

    rows = written(train.groupBy("chunk").cogroup(priors.groupBy("chunk")).applyInArrow(score, ddl), "scores")
    summed = lambda fn, ddl, key, sums: rows.mapInArrow(fn, ddl).groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])
    tail(model, summed(best_scores, "i int, n double, words double", "i", ("n", "words")).toPandas().sort_values("i"))
    hist = summed(lambda it: evidence_levels(model, it), "i int, clean double, toxic double", "i", ("clean", "toxic")).toPandas().sort_values("i")
    model.levels = pooled(hist["clean"].to_numpy(), hist["toxic"].to_numpy(), model.base)
    return model, priors


#: Bins of a clean text's best segment score.
EDGES = np.concatenate((np.arange(0, 40, 0.05), [1e9]))


def pooled(clean: np.ndarray, toxic: np.ndarray, base: float) -> np.ndarray:
    """Share of toxic texts per bin, never falling (adjacent violators pooled), one text of prior each."""
    blocks: list[list[float]] = []
    for c, t in zip(clean, toxic):
        blocks.append([t + (base if c + t else 0.0), c + t + (1.0 if c + t else 0.0), 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][1] == 0 or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            b = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], b)]
    return np.concatenate([np.full(int(k), t / n if n else base) for t, n, k in blocks])


SPANS = "n_words bigint, score double, evidence double, segments array<struct<first:bigint,last:bigint,score:double,e_value:double>>"


def toxic_spans(texts: DataFrame, model: Model, priors: DataFrame, key="doc_id") -> DataFrame:
    """``n_words``, ``score`` (0 to 1), ``evidence`` and the significant ``segments`` (word span, score,
    E-value) of every encoded text.

    Null and empty texts have no segment and the score of a text without evidence. The words' priors come to the
    texts by chunk, one bounded chunk at a time; texts of any length are scanned whole, in linear time.
    """
    schema = StructType([StructField(key, texts.schema["id"].dataType), *_parse_datatype_string(SPANS).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    top = np.concatenate((_BINS[1:-1], [_BINS[-2] + 5]))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        got = _scored(model, left.column("codes").combine_chunks(), right)
        found = [_evidence(model, k, segments) for k, segments in got]
        x = np.array([f[0] for f in found], float)
        i = np.searchsorted(_BINS, x, side="right") - 1
        # inside a bin the score rises towards the next, so that more evidence is never a lower or equal rank
        up = model.levels[np.minimum(i + 1, len(_BINS) - 1)]
        part = ((x - _BINS[i]) / (top[np.minimum(i, len(top) - 1)] - _BINS[i])).clip(0, 1)
        value = model.levels[i] + (up - model.levels[i]) * 0.5 * part
        names = ("first", "last", "score", "e_value")
        cols = ([k for k, _ in got], value.clip(0, 1), x, [[dict(zip(names, s)) for s in f[2]] for f in found])
        return pa.Table.from_arrays([left.column("id").combine_chunks().cast(arrow.field(0).type),
                                     *[pa.array(c, arrow.field(j).type) for j, c in enumerate(cols, 1)]], schema=arrow)

    return texts.groupBy("chunk").cogroup(priors.groupBy("chunk")).applyInArrow(score, schema)


def held_out(key="doc_id"):
    return F.coalesce(C.crc_mod(key, 4) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, key="doc_id", label="toxic", text="text", threshold=0.3) -> DataFrame:
    """Scores of all rows of ``docs``, learned from the labelled rows that are not held out.

    Null ids match no label and are not held out; a document that is labelled twice learns once per label;
    only id and text are read, so other columns may have any name. Without labels all scores are 0; an empty table of
    documents gives no rows.
    """
    marks = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label")).where(~held_out("_id") & F.col("label").isNotNull())
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    texts, words = encoded(docs, key, text)
    fitted = fit(texts.join(marks, F.col("id") == F.col("_id")).select("chunk", "label", "codes"), words)
    if fitted is None:  # no labelled row: all scores are 0
        nothing = [F.lit(0).cast(f.dataType) if f.name != "segments" else F.array().cast(f.dataType) for f in _parse_datatype_string(SPANS)]
        spans = texts.select(F.col("id").alias(key), *[c.alias(f.name) for c, f in zip(nothing, _parse_datatype_string(SPANS))])
    else:
        spans = toxic_spans(texts, *fitted, key)
    return spans.withColumn("held_out", held_out(key)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
