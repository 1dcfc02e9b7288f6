"""Document fingerprints: threshold-scaled sketches of byte shingles, and their containment."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from . import common as C

#: Bytes of a shingle (three words of a long), and the fraction of all hashes that a sketch retains.
WIDTH, FRACTION = 24, 1 / 8
#: A text with fewer distinct hashes below the fraction keeps all its hashes.
LEAST = 32
# Odd multipliers of a 64-bit mix.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def shingle_hashes(data: bytes) -> np.ndarray:
    """A hash for every place of a ``WIDTH``-byte shingle; a shorter text is one shingle, padded."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < WIDTH:
        data += b"\x00" * (WIDTH - 1 - n) + bytes([n])
    v = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    m = len(data) - WIDTH + 1
    h = v[:m] * _MIX[0]
    h ^= (h >> np.uint64(29)) + v[8:8 + m] * _MIX[1]
    h ^= (h >> np.uint64(31)) + v[16:16 + m] * _MIX[2]
    h ^= h >> np.uint64(30)
    h *= _MIX[3]
    h ^= h >> np.uint64(27)
    h *= _MIX[4]
    h ^= h >> np.uint64(31)
    return h


def _blocks(text: str, step=1 << 20):
    """The shingle hashes in blocks, which bound the memory of very long texts."""
    data = text.encode("utf-8", "surrogatepass")
    for at in range(0, max(1, len(data) - WIDTH + 1), step):
        yield shingle_hashes(data[at:at + step + WIDTH - 1])


def _top(fraction) -> np.uint64:
    return np.uint64(min(int(fraction * 2**64), 2**64 - 1))


def sketch(text: str, fraction=FRACTION) -> np.ndarray:
    """All distinct shingle hashes below the fraction, ascending; where these are fewer than ``LEAST``, all distinct
    hashes. So a sketch with fewer below the fraction is whole, and only the empty text has an empty one."""
    top = _top(fraction)
    out = np.unique(np.concatenate([h[h < top] for h in _blocks(text)]))
    if len(out) < LEAST:
        out = np.zeros(0, np.uint64)
        for h in _blocks(text):
            out = np.union1d(out, h)
    return out


def whole(s: np.ndarray, fraction=FRACTION) -> bool:
    """Whether the sketch holds every hash of its text."""
    return int(np.searchsorted(s, _top(fraction))) < LEAST


def merge(a: np.ndarray, b: np.ndarray, fraction=FRACTION) -> np.ndarray:
    """The sketch of two texts taken together: what is above the fraction stays only while the sketch is whole."""
    out = np.union1d(a, b)
    return out if whole(out, fraction) else out[out < _top(fraction)]


def containment(a: np.ndarray, b: np.ndarray, fraction=FRACTION) -> float:
    """Estimated share of the smaller text's shingles that the larger has; two empty texts contain each other.

    Two whole sketches are compared in full, others by the hashes below the fraction. Where a whole sketch
    has none there, the sketches don't tell (NaN); ``compared`` asks the text then.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if not (whole(a, fraction) and whole(b, fraction)):
        a, b = a[a < _top(fraction)], b[b < _top(fraction)]
        if not len(a) or not len(b):
            return float("nan")
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def _within(own: np.ndarray, text: str) -> float:
    """Exact containment of all hashes of a text with those of another ``text``."""
    found, seen = np.zeros(len(own), bool), np.zeros(0, np.uint64)
    for h in _blocks(text):
        i = np.minimum(np.searchsorted(own, h), len(own) - 1)
        found[i[own[i] == h]] = True
        if len(seen) < len(own):
            seen = np.union1d(seen, h)
    return int(found.sum()) / min(len(own), len(seen))


def compared(a: np.ndarray, text_a: str, b: np.ndarray, text_b: str, fraction=FRACTION) -> float:
    """``containment`` of two texts' sketches, where a whole sketch is compared with all hashes of the other text."""
    if len(a) and len(b) and whole(a, fraction) != whole(b, fraction):
        return _within(a, text_b) if whole(a, fraction) else _within(b, text_a)
    return containment(a, b, fraction)


def as_text(s: np.ndarray) -> str:
    """16 hex digits a hash, ascending."""
    return s.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, key="doc_id", text="text", fraction=FRACTION) -> DataFrame:
    """``key`` and ``fingerprint`` of every row; nothing is shuffled. Null texts are empty."""
    def make():
        return lambda texts: ([as_text(sketch(t or "", fraction)) for t in texts.to_pylist()],)

    return C.map_texts(docs, make, "fingerprint string", (key,), text)


def with_next(docs: DataFrame, fn, ddl: str, key="doc_id", text="text") -> DataFrame:
    """``key`` and what ``fn(text, next text)`` gives, next by ascending ``key`` (after the last: the first).

    Texts are moved once, dealt by range of the key. Cut points come from a sample by hash (about 100
    ids a partition); each range's first row is copied to the end of the range before it, so every task reads its
    rows in order and needs no neighbour. Null ids stand first; rows with one id stand by the hash of their text.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_type = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).withColumn("_x", F.xxhash64("_t"))
    total = max(1, docs.count())
    drawn = docs.select(F.col(key).alias("k")).where(F.col("k").isNotNull() & (F.pmod(F.xxhash64("k"), F.lit(1 << 40)) < F.lit(min(1 << 40, (100 * n << 40) // total))))
    ids = sorted(r[0] for r in drawn.collect())  # about 100 a partition, or all of a small table
    step = max(1, -(-len(ids) // n))
    cuts = sorted(set(ids[step::step]))
    held = np.array(cuts, dtype=object if cuts and isinstance(cuts[0], str) else None)

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        out = np.zeros(len(k), np.int32)
        full = k.notna().to_numpy()
        if len(held) and full.any():
            out[full] = np.searchsorted(held, k[full].to_numpy(held.dtype), side="right")
        return pd.Series(out)

    placed = rows.withColumn("_p", place("_k"))
    firsts = placed.groupBy("_p").agg(F.min(F.struct(F.col("_k").isNotNull().alias("full"), "_k", "_x")).alias("f")).select("_p", "f._k", "f._x").collect()
    firsts.sort(key=lambda r: r[0])
    schema = StructType([StructField("_f", id_type), StructField("_fx", docs.select(F.lit(0).cast("long")).schema[0].dataType), StructField("_to", docs.select(F.lit(0)).schema[0].dataType)])
    ahead = spark.createDataFrame([(f["_k"], f["_x"], firsts[i - 1]["_p"]) for i, f in enumerate(firsts)], schema)
    copies = rows.join(F.broadcast(ahead), F.col("_k").eqNullSafe(F.col("_f")) & (F.col("_x") == F.col("_fx"))).dropDuplicates(["_to"]).select(
        "_k", "_t", "_x", F.col("_to").alias("_p"), F.lit(1).alias("_copy"))
    dealt = placed.select("_k", "_t", "_x", "_p", F.lit(0).alias("_copy")).union(copies).repartitionById(n, "_p").sortWithinPartitions(
        F.col("_copy"), F.col("_k").asc_nulls_first(), "_x")
    out = StructType([StructField(key, id_type), *_parse_datatype_string(ddl).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        last = None
        for whole in batches:
            for b in C.slices(whole, 1):
                got = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if last is not None:
                        got.append((last[0], *fn(last[1], t)))
                    last = (k, t)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return dealt.select("_k", "_t").mapInArrow(run, out)


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as much of the start of the following one."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def edit_table(docs: DataFrame, key="doc_id", text="text", fraction=FRACTION) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the containment of its sketch with the edited
    text's and with the next document's.

    Null texts are empty and have an empty fingerprint; a lone document is followed by itself; repeated rows
    follow each other; an empty table gives no rows. Only id and text are read, so other columns may have any name.
    """
    kept: list = [None, None]  # the text last seen as the following one, and its sketch

    def fn(t, following):
        own = kept[1] if kept[0] is t else sketch(t, fraction)
        e = edited(t, following)
        new, nxt = sketch(e, fraction), sketch(following, fraction)
        kept[:] = [following, nxt]
        return (len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(new),
                compared(own, t, new, e, fraction), compared(own, t, nxt, following, fraction))

    return with_next(docs, fn, "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", key, text)
