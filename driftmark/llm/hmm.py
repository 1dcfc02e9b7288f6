"""LM scoring: a hidden Markov model over word classes, trained by Baum-Welch counts summed over partitions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import new_folder, written
from . import common as C

#: Hidden states; a word of count c has a class of its own where (OWN * c)^2 is at least the number of training tokens N,
#: so at most OWN * sqrt(N) words have one; the others share about sqrt(N) classes by their last letters.
STATES, OWN, ENDING = 16, 32, 3
#: Baum-Welch rounds over the start sample and over all training texts; texts of the start sample.
SAMPLE_ROUNDS, ROUNDS, START_TEXTS = 15, 3, 1000
#: Tokens of a training stretch (scores run over whole texts).
STRETCH = 256
#: Rows and bytes of text that share a dictionary; bounds the tasks that join them with the vocabulary.
CHUNK_ROWS, CHUNK_BYTES = 16_384, 12 << 20


def encoded(docs: DataFrame, held, key="doc_id", text="text") -> tuple[DataFrame, DataFrame]:
    """Texts as codes of their chunk's dictionary, and the dictionaries (chunk, token, code, n in training)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), held.alias("held"), F.col(text).cast("string").alias("text"))
    ddl = "kind int, chunk bigint, held boolean, codes array<int>, token string, code int, n bigint"
    out = StructType([StructField("id", docs.schema[key].dataType), *_parse_datatype_string(ddl).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def batch(rows_, **own):
        cols = [own[f.name].cast(f.type) if f.name in own else pa.nulls(rows_, f.type) for f in arrow]
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in C.slices(whole, 2, CHUNK_ROWS, CHUNK_BYTES):
                chunk = (part << 24) + count
                count += 1
                words, at = C.words_of(b.column(2))
                code, distinct = C.coded(words)
                ends = np.concatenate(([0], np.searchsorted(at, np.arange(b.num_rows), side="right")))
                codes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code.astype(np.int32)))
                yield batch(b.num_rows, id=b.column(0), kind=pa.array(np.zeros(b.num_rows, np.int32)), held=b.column(1),
                            chunk=pa.array(np.full(b.num_rows, chunk)), codes=codes)
                if len(distinct):
                    train = ~b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                    n = np.bincount(code[train[at]], minlength=len(distinct))
                    yield batch(len(distinct), kind=pa.array(np.ones(len(distinct), np.int32)), chunk=pa.array(np.full(len(distinct), chunk)),
                                token=distinct, code=pa.array(np.arange(len(distinct), dtype=np.int32)), n=pa.array(n))

    folder = new_folder(spark, "encoded")
    rows.mapInArrow(run, out).write.partitionBy("kind").parquet(folder)
    back = spark.read.schema(out).parquet(folder)
    return back.where("kind = 0").select("chunk", "id", "held", "codes"), back.where("kind = 1").select("chunk", "token", "code", "n")


def tail_classes(tokens: int) -> int:
    return 1 << max(6, math.ceil(math.log2(max(1, tokens)) / 2))


def tail_class(token, own: int, tail: int):
    return (F.lit(1 + own) + F.pmod(F.xxhash64(F.right(token, F.lit(ENDING))), F.lit(tail))).cast("int")


class Counts:
    """What the corpus gives once: N, V, the end's count, and per class its tokens' and types' counts.

    Class 0 is the end of a text, 1 to ``own`` are the most frequent words, then come the endings."""

    def __init__(self, n, v, ends, class_n, class_v, own=None):
        self.n, self.v, self.ends = n, v, ends
        self.class_n, self.class_v = class_n, class_v
        self.own = len(class_n) - 1 if own is None else own
        #: log10 of what divides c + 1 inside a tail class: its tokens, its types and one place for unknown ones.
        self.norm = np.where(np.arange(len(class_n)) <= self.own, 0.0, np.log10(class_n + class_v + 1))
        prior = class_n + 1.0
        self.prior = prior / prior.sum()


def counted(docs: DataFrame, words: DataFrame, ends: int) -> tuple[DataFrame, Counts]:
    """Per text its known tokens, log counts and classes, and the corpus counts.

    A token's count is a window sum over its rows, one a chunk, so frequent words are no hot key. The counts go
    back to the chunks' texts by a cogroup on the chunk: it holds one bounded chunk at a time.
    """
    by = Window.partitionBy("token")
    w = written(words.select("chunk", "code", "token", F.sum("n").over(by).alias("c"), F.row_number().over(by.orderBy("chunk")).alias("_r"))
                .withColumn("first", F.col("_r") == 1).drop("_r"), "vocabulary")
    known = w.where("first and c > 0")
    tokens = (known.agg(F.sum("c")).first()[0] or 0) + ends
    frequent = known.where(F.col("c").cast("double") * F.col("c") * float(OWN * OWN) >= float(tokens)).select("token", "c")
    # at most OWN * sqrt(N) rows: one task numbers them, and they are sent to all, as is the model with STATES numbers a class
    own = written(frequent.select("token", F.row_number().over(Window.orderBy(F.col("c").desc(), "token")).alias("own")), "own")
    n_own, tail = own.count(), tail_classes(tokens)
    classed = lambda x: x.join(F.broadcast(own), "token", "left").withColumn("cls", F.coalesce("own", tail_class(F.col("token"), n_own, tail)))
    class_n, class_v = np.zeros(1 + n_own + tail), np.zeros(1 + n_own + tail)
    found = classed(known).groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()
    class_n[found["cls"]], class_v[found["cls"]] = found["c"], found["v"]
    types = int(class_v.sum()) + (ends > 0)
    class_n[0], class_v[0] = ends, ends > 0
    counts = Counts(tokens, types, ends, class_n, class_v, n_own)

    schema = StructType([StructField("id", docs.schema["id"].dataType), *_parse_datatype_string(
        "held boolean, n_words bigint, n_known bigint, log_all double, log_tail double, classes array<int>").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.column("codes").combine_chunks()
        code = pc.list_flatten(lists).to_numpy()
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(np.arange(len(size)), size)
        c, cls = np.zeros(right.num_rows), np.zeros(right.num_rows, np.int32)
        place = right.column("code").to_numpy()
        c[place], cls[place] = right.column("c").to_numpy(), right.column("cls").to_numpy()
        logs, tail, known = np.log10(c + 1), cls > n_own, c > 0
        per = lambda x: np.bincount(at, x[code], len(size))
        classes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(cls[code]))
        cols = [left.column("id").combine_chunks(), left.column("held").combine_chunks(), pa.array(size), pa.array(per(known.astype(float)).astype(np.int64)),
                pa.array(per(logs)), pa.array(per(np.where(tail, logs, 0.0))), classes]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(cols, arrow)], schema=arrow)

    coded = classed(w).select("chunk", "code", "c", "cls")
    texts = docs.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(match, schema)
    return written(texts, "texts"), counts


class Hmm:
    """start (K), moves (K x K) and emissions (K x classes)."""

    def __init__(self, start, moves, emit):
        self.start, self.moves = start, moves
        self.by_class = np.ascontiguousarray(emit.T)
        #: where a stretch inside a text begins: the states' shares in the long run
        self.inside = np.linalg.matrix_power(moves, 256)[0]

    @property
    def emit(self):
        return self.by_class.T

    @classmethod
    def first(cls, counts: Counts, states=STATES, seed=1):
        noise = np.random.default_rng(seed).random((states, len(counts.prior))) + 0.5
        emit = counts.prior * noise
        moves = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), moves, emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, x: np.ndarray, counts: Counts, states=STATES, weight=50.0):
        """Expected counts under a Dirichlet prior: the corpus' classes for emissions, even moves."""
        start, moves, emit = x[:states] + 1.0, x[states:states + states**2].reshape(states, states) + 1.0, x[states + states**2:].reshape(states, -1)
        emit = emit + weight * counts.prior
        return cls(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def expected(self, codes: np.ndarray, size: np.ndarray, first=None) -> np.ndarray:
        """Baum-Welch counts of sequences (their classes joined, and their lengths), scaled at each step.

        ``first`` tells which sequences begin a text (by default all); the others count no start."""
        k, classes = len(self.start), len(self.by_class)
        order = np.argsort(-size, kind="stable")
        first = np.ones(len(size), bool) if first is None else first[order]
        enter = np.where(first[:, None], self.start, self.inside)
        starts = (np.cumsum(size) - size)[order]
        size = size[order]
        start, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes))
        if not len(size) or not size[0]:
            return np.concatenate((start, moves.ravel(), emit.ravel()))
        active = [int(np.searchsorted(-size, -t, side="left")) for t in range(size[0] + 1)]  # sequences longer than t
        seen, forward, scale = [], [], []
        for t in range(size[0]):
            n = active[t]
            o = codes[starts[:n] + t]
            a = (enter if t == 0 else forward[-1][:n] @ self.moves) * self.by_class[o]
            c = a.sum(1, keepdims=True)
            seen.append(o)
            forward.append(a / c)
            scale.append(c)
        back = np.ones((active[size[0] - 1], k))
        post = []
        for t in range(size[0] - 1, -1, -1):
            post.append(forward[t] * back)
            if t:
                ahead = self.by_class[seen[t]] * back / scale[t]
                moves += forward[t - 1][:active[t]].T @ ahead
                b = np.ones((active[t - 1], k))
                b[:active[t]] = ahead @ self.moves.T
                back = b
        start += post[-1][first].sum(0)
        o, g = np.concatenate(seen[::-1]), np.concatenate(post)
        for i in range(k):
            emit[i] = np.bincount(o, g[:, i], classes)
        return np.concatenate((start, (moves * self.moves).ravel(), emit.ravel()))

    def log10(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of whole sequences: the scaled forward recursion over all at once."""
        order = np.argsort(-size, kind="stable")
        starts = (np.cumsum(size) - size)[order]
        size = size[order]
        total = np.zeros(len(size))
        a = None
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))
            a = (self.start if t == 0 else a[:n] @ self.moves) * self.by_class[codes[starts[:n] + t]]
            c = a.sum(1)
            a /= c[:, None]
            total[:n] += np.log10(c)
        out = np.empty(len(size))
        out[order] = total
        return out


def _with_ends(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lists joined, each closed by class 0, and their lengths."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.insert(flat, np.cumsum(size), 0), size + 1


def _stretches(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the stretches that sequences of these lengths are cut into, and whether each begins one."""
    n = -(-size // STRETCH)
    out, first = np.full(int(n.sum()), STRETCH), np.zeros(int(n.sum()), bool)
    out[np.cumsum(n) - 1] = size - (n - 1) * STRETCH
    first[np.cumsum(n) - n] = True
    return out, first


def trained(texts: DataFrame, counts: Counts, states=STATES, rounds=ROUNDS) -> Hmm:
    """Baum-Welch: some rounds on a start sample (the texts with the least hashes of ids), which only sets where
    the search begins, then ``rounds`` over all training texts. In both, each task sums its expected counts and Spark
    sums the tasks'; the driver gets one row per class and per state (classes grow as the root of the tokens)."""
    train = texts.where(~F.col("held"))
    model = Hmm.first(counts, states)
    chosen = train.select("id").orderBy(F.xxhash64("id"), "id").limit(START_TEXTS)
    begin = written(train.join(chosen.distinct(), "id", "left_semi").select("classes"), "start")
    parameters = states + states**2 + states * len(counts.prior)
    names = [f"x{k}" for k in range(states)]
    for sample in [begin] * SAMPLE_ROUNDS + [train.select("classes")] * rounds:
        now = model

        def run(batches):
            total = np.zeros(parameters)
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    codes, size = _with_ends(whole.column(0).slice(at, 512))
                    cut, first = _stretches(size)
                    ends = np.cumsum(cut)
                    for i in range(0, len(cut), 4096):
                        j = min(i + 4096, len(cut))
                        total += now.expected(codes[ends[i] - cut[i]:ends[j - 1]], cut[i:j], first[i:j])
            # a row for the starts, one for each state's moves and one for each class seen; a column for each state
            rows = np.vstack((total[:states + states**2].reshape(-1, states), total[states + states**2:].reshape(states, -1).T))
            i = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i.astype(np.int32)), **{n: pa.array(rows[i, k]) for k, n in enumerate(names)}})

        summed = sample.mapInArrow(run, "i int, " + ", ".join(f"{n} double" for n in names)).groupBy("i")
        got = summed.agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        rows = np.zeros((parameters // states, states))
        for k, n in enumerate(names):
            rows[got.column("i").to_numpy(), k] = got.column(n).to_numpy()
        model = Hmm.from_counts(np.concatenate((rows[:1 + states].ravel(), rows[1 + states:].T.ravel())), counts, states)
    return model


def scores(docs: DataFrame, held, key="doc_id", text="text", states=STATES, rounds=ROUNDS) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    A text's tokens are its words (A-Z lower-cased) and one end. The hidden Markov model gives the sequence of
    word classes (frequent words are classes of their own), and a word has the share (c + 1) / (tokens + types + 1)
    of its class; unknown words share one place. ``score`` is the log10 probability of the whole text. All counts
    come from the rows that are not ``held`` (a boolean column expression).

    Null and empty texts have the end alone; null ids keep their row; repeated rows count and score each;
    without training texts both scores follow from empty counts. An empty table gives no rows. Only id, text and what
    ``held`` names are read, so other columns may have any name.
    """
    coded, words = encoded(docs, held, key, text)
    ends = coded.where(~F.col("held")).count()
    texts, counts = counted(coded, words, ends)
    model = trained(texts, counts, states, rounds)
    out = StructType([StructField(key, docs.schema[key].dataType), *_parse_datatype_string(
        "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                codes, size = _with_ends(b.column("classes"))
                of = np.repeat(np.arange(len(size)), size)
                num = lambda c: b.column(c).to_numpy(zero_copy_only=False)
                score = model.log10(codes, size) + num("log_tail") - np.bincount(of, counts.norm[codes], len(size))
                base = num("log_all") + np.log10(counts.ends + 1) - size * np.log10(counts.n + counts.v + 1)
                cols = [b.column("id"), b.column("held"), pa.array(size), pa.array(num("n_known") + int(counts.ends > 0)),
                        pa.array(np.full(len(size), counts.n)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, arrow)], schema=arrow)

    return texts.select("id", "held", "n_known", "log_all", "log_tail", "classes").mapInArrow(run, out)
