"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays, with calibrated rejection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER = 5
#: Training documents per language (expected number; the bound of the fitted sample).
PER_LANGUAGE = 3000
_START, _END = "\x02", "\x03"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def sample(docs: DataFrame, label: str, bound: int, key="doc_id") -> DataFrame:
    """Rows with a label: of each label about ``bound``, by the hash of the id, or all if there are fewer."""
    rows = docs.where(F.col(label).isNotNull())
    share = rows.groupBy(F.col(label).alias("_l")).agg((F.lit(float(bound)) / F.count(F.lit(1))).alias("_share"))
    at = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(share), F.col(label) == F.col("_l")).where(at < F.col("_share")).drop("_l", "_share")


def _grams(word: str) -> list[str]:
    """For every character after the start mark, the longest n-gram of the word that ends there."""
    s = _START + word + _END
    return [s[max(0, i - ORDER + 1):i + 1] for i in range(1, len(s))]


def gram_counts(docs: DataFrame, label: str, text="text") -> DataFrame:
    """(label, gram, n): how often each longest n-gram stands in the words of a label's texts."""
    def run(batches):
        for whole in batches:
            for b in C.slices(whole, 1):
                words, at = C.words_of(pc.utf8_lower(b.column(1).cast(pa.string())), lower=False)
                if not len(words):
                    continue
                code, distinct = C.coded(words)
                lang, names = C.coded(b.column(0).cast(pa.string()))
                pairs = pd.Series(lang[at] * np.int64(len(distinct)) + code).value_counts()
                own, total = distinct.to_pylist(), {}
                for p, n in zip(pairs.index.tolist(), pairs.tolist()):
                    x, w = divmod(p, len(distinct))
                    for g in _grams(own[w]):
                        total[x, g] = total.get((x, g), 0) + n
                yield pa.RecordBatch.from_pydict({"label": pa.array([names[x].as_py() for x, _ in total]), "gram": pa.array([g for _, g in total]),
                                                  "n": pa.array(list(total.values()), pa.int64())})

    return docs.select(label, text).mapInArrow(run, "label string, gram string, n bigint").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def _code(chars: np.ndarray) -> np.ndarray:
    """Characters (code points) to well-spread 64-bit values."""
    x = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _hash(grams: list[str]) -> np.ndarray:
    """The rolling hash of each gram, as ``word_scores`` computes it."""
    out = np.zeros(len(grams), np.uint64)
    for n in {len(g) for g in grams} - {0}:
        at = [i for i, g in enumerate(grams) if len(g) == n]
        chars = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h = h * _BASE + _code(chars[:, j])
        out[at] = h
    return out


def _levels(raw: pd.Series, order: int):
    """One language's floor (log-probability of a character never seen), and for each order the hashes and
    log-probabilities of its grams and the hashes and log back-off weights of its contexts."""
    size = raw.index.str.len().to_numpy()
    levels, above = {}, None
    for m in range(order, 0, -1):
        own = raw[size == m]  # the longest order, and grams that a word's start cuts short: counted as they stand
        if above is not None:  # others: by the number of different characters before them
            own = pd.concat([own, pd.Series(1.0, index=above.index.str[1:])]).groupby(level=0, sort=False).sum()
        levels[m] = above = own
    floor = -np.log(len(levels[1]) + 1.0)
    grams, contexts, lower = {}, {}, None
    for m in range(1, order + 1):
        n = levels[m].to_numpy()
        if not len(n):
            break
        names = levels[m].index
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95) if once else 0.5
        at, heads = pd.factorize(names.str[:-1])
        total, kinds = np.bincount(at, n), np.bincount(at)
        weight = discount * kinds / total
        below = np.exp(floor) if m == 1 else lower.reindex(names.str[1:]).to_numpy()
        lower = pd.Series(np.maximum(n - discount, 0) / total[at] + weight[at] * below, index=names)
        grams[m] = (_hash(names.tolist()), np.log(lower.to_numpy()))
        contexts[m] = (_hash(heads.tolist()), np.log(weight))
    return floor, grams, contexts


class Model:
    """Per order: sorted gram hashes with log-probabilities of all languages (nan: not seen), and sorted
    context hashes with log back-off weights (0 for a context not seen)."""

    def __init__(self, counts: pa.Table, order=ORDER):
        """From rows (label, gram, n); one language is worked on at a time, which bounds the memory."""
        self.order = order
        label = counts.column("label").combine_chunks().dictionary_encode()
        self.labels = sorted(label.dictionary.to_pylist())
        parts = []
        for x in self.labels:
            own = counts.filter(pc.equal(counts.column("label"), x))
            parts.append(_levels(pd.Series(own.column("n").to_numpy().astype(np.float64), index=own.column("gram").to_pylist()), order))
        self.floor = np.array([p[0] for p in parts])
        self.grams = {m: self._merged([p[1].get(m) for p in parts], np.nan) for m in range(1, order + 1)}
        self.contexts = {m: self._merged([p[2].get(m) for p in parts], 0.0) for m in range(1, order + 1)}

    def _merged(self, tables, empty):
        """Sorted hashes of all languages, and a column of values for each."""
        keys = np.unique(np.concatenate([t[0] for t in tables if t] or [np.zeros(1, np.uint64)]))
        rows = np.full((len(keys), len(tables)), empty, np.float32)
        for i, t in enumerate(tables):
            if t:
                rows[np.searchsorted(keys, t[0]), i] = t[1]
        return keys, rows

    @staticmethod
    def _look(table, h):
        keys, rows = table
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[i] == h, rows, i

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word and its end under every language."""
        if not words:
            return np.zeros((0, len(self.labels)))
        chars = np.frombuffer((_START + (_END + _START).join(words) + _END).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array([len(w) for w in words]) + 2
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(chars)) - starts[word]
        code = _code(chars)
        at = np.flatnonzero(place > 0)
        depth = np.minimum(place[at] + 1, self.order)
        hashes, power = {}, 1
        h = np.zeros(len(chars), np.uint64)
        for m in range(1, self.order + 1):  # h[i]: hash of the m characters that end at i
            h = h.copy()
            h[m - 1:] += code[:max(0, len(code) - m + 1)] * np.uint64(power)
            power = power * int(_BASE) % (1 << 64)
            hashes[m] = h
        out = np.zeros((len(at), len(self.labels)))
        open_ = np.ones((len(at), len(self.labels)), bool)
        for m in range(self.order, 0, -1):
            rows = np.flatnonzero((depth >= m) & open_.any(1))
            if not len(rows):
                continue
            i = at[rows]
            hit, table, j = self._look(self.grams[m], hashes[m][i])
            value = np.where(hit[:, None], table[j], np.nan)
            still = open_[rows]
            got = still & ~np.isnan(value)
            out[rows] += np.where(got, value, 0)
            still &= ~got
            before = hashes[m - 1][i - 1] if m > 1 else np.zeros(len(i), np.uint64)
            seen, table, j = self._look(self.contexts[m], before)
            out[rows] += np.where(still & seen[:, None], table[j], 0)
            open_[rows] = still
        out += np.where(open_, self.floor, 0)
        total = np.zeros((len(words), len(self.labels)))
        np.add.at(total, word[at], out)
        return total


def text_scorer(model: Model, cache=1 << 19):
    """A function from an Arrow array of texts to (cross-entropy a character in each language, characters).

    Words are scored once and kept, up to ``cache`` words at a time."""
    place: dict[str, int] = {}
    store = [np.zeros((0, len(model.labels)))]

    def fn(texts):
        words, at = C.words_of(pc.utf8_lower(texts.cast(pa.string())), lower=False)
        code, distinct = C.coded(words)
        own = distinct.to_pylist()
        if len(place) + len(own) > cache:
            place.clear()
            store[0] = store[0][:0]
        new = [w for w in own if w not in place]
        for i in range(0, len(new), 1 << 15):
            part = new[i:i + (1 << 15)]
            for j, w in enumerate(part, len(place)):
                place[w] = j
            store.append(model.word_scores(part))
        store[:] = [np.concatenate(store)]
        rows = store[0][[place[w] for w in own]] if own else store[0][:0]
        chars = (pc.utf8_length(distinct).to_numpy(zero_copy_only=False) + 1)[code]
        n = np.bincount(at, chars, len(texts))
        sums = np.stack([np.bincount(at, rows[code, x], len(texts)) for x in range(len(model.labels))], 1)
        return -sums / np.maximum(n, 1)[:, None], n

    return fn


def fit(train: DataFrame, label="lang", key="doc_id", text="text", per_language=PER_LANGUAGE, margin=2.0):
    """(model, limits): models from four fifths of the sample; the rest calibrates the rejection.

    A text is rejected when its cross-entropy exceeds its language's mean by over ``margin`` times the
    largest excess among 99.9% of the held-back texts, where the excess of shorter texts may be larger (it
    is scaled by the root of the length, up to 400 characters). Only the sample's n-gram counts and one row per
    held-back text reach the driver: both are bounded by the sample.
    """
    drawn = sample(train.select(key, label, text), label, per_language, key).withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(5)))
    counts = gram_counts(drawn.where("_part <> 0"), label, text).toArrow()
    if not counts.num_rows:
        return None, None
    model = Model(counts)

    def make():
        score = text_scorer(model)

        def fn(texts):
            ce, n = score(texts)
            return (list(ce), n.astype(np.int64))
        return fn

    held = C.map_texts(drawn.where("_part = 0"), make, "ce array<double>, n bigint", (label,), text).where("n > 0").toPandas()
    mean, limit = np.zeros(len(model.labels)), np.full(len(model.labels), np.inf)
    for i, x in enumerate(model.labels):
        own = held[held[label].astype(str) == x]
        if len(own):
            ce, n = np.array([r[i] for r in own["ce"]]), own["n"].to_numpy()
            mean[i] = np.average(ce, weights=n)
            excess = (ce - mean[i]) * np.sqrt(np.minimum(n, 400))
            limit[i] = max(margin * np.quantile(excess, 0.999), 1.0)
    return model, (mean, limit)


def predict(docs: DataFrame, fitted, key=("doc_id",), text="text") -> DataFrame:
    """``lang_pred`` (the language of the lowest cross-entropy a character; und for null texts and texts
    without a letter), ``score`` (its share of the languages' likelihoods of 20 characters, 0 to 1),
    ``cross_entropy`` and ``rejected`` (too unlikely for the language, or und)."""
    model, limits = fitted

    def make():
        score = text_scorer(model) if model else None

        def fn(texts):
            n = len(texts)
            if model is None:
                return (["und"] * n, np.zeros(n), [None] * n, [True] * n)
            ce, chars = score(texts)
            best = ce.argmin(1)
            low = ce[np.arange(n), best]
            p = 1 / np.exp(-(ce - low[:, None]) * np.minimum(chars, 20)[:, None]).sum(1)
            letters = pc.fill_null(pc.match_substring_regex(texts.cast(pa.string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            ok = letters & (chars > 0)
            far = (low - limits[0][best]) * np.sqrt(np.minimum(chars, 400)) > limits[1][best]
            names = np.array(model.labels, object)[best]
            return (np.where(ok, names, "und").tolist(), np.where(ok, p, 0.0), pa.array(low, mask=~ok), (~ok | far).tolist())
        return fn

    return C.map_texts(docs, make, "lang_pred string, score double, cross_entropy double, rejected boolean", key, text)


def held_out(key="doc_id"):
    return F.coalesce(C.crc_mod(key, 3) == 1, F.lit(False))


def identified(docs: DataFrame, key="doc_id", **options) -> DataFrame:
    """Languages of all rows, learned from those with a language that are not held out.

    Null ids are not held out; repeated rows are each predicted; without any labelled text every row is und
    and rejected. An empty table gives no rows. Other columns are not read, so they may have any name."""
    fitted = fit(docs.where(~held_out(key)), key=key, **options)
    return predict(docs, fitted, (key,)).withColumn("held_out", held_out(key))


def accepted(docs: DataFrame, key="doc_id", text="text", **options) -> DataFrame:
    """The rows of ``docs`` whose language is known and not rejected; columns as given."""
    fitted = fit(docs.where(~held_out(key)), key=key, **options)
    rest = [c for c in docs.columns if c != text]
    own = docs.select(*[F.col(c).alias(f"__dm_{i}") for i, c in enumerate(rest)], F.col(text).alias("__dm_whole"))
    kept = predict(own, fitted, own.columns, "__dm_whole").where(~F.col("rejected"))
    back = {c: F.col(f"__dm_{i}").alias(c) for i, c in enumerate(rest)} | {text: F.col("__dm_whole").alias(text)}
    return kept.select(*[back[c] for c in docs.columns])
