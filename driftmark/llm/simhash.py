"""SimHash near-duplicates: segment bit counts, a grid join under Manhattan distance, exact verification."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import common as C

SEED = 42  # fixed value: the seed of XXH64
LOW_BITS = 0x5555555555555555
_BLOCK = 1 << 18


def fingerprint_batch(texts: pa.Array, width=4) -> np.ndarray:
    """SimHash of each text over its ``width``-word shingles; zero for a text without words."""
    import xxhash

    out = np.zeros(len(texts), np.int64)
    words, at = C.words_of(texts)
    if not len(words):
        return out
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().encode()
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    ends = starts + size
    first = np.searchsorted(at, at, side="left")
    count = np.bincount(at, minlength=len(texts))
    i = np.arange(len(at))
    # a shingle starts at every word that has width - 1 after it; a shorter text is one shingle
    last = i + width - 1
    whole = (i == first) & (count[at] < width)
    keep = (last < first + count[at]) | whole
    last = np.where(whole, first + count[at] - 1, last)[keep]
    of, digest = at[keep], xxhash.xxh64_intdigest
    a, b = starts[keep], ends[last]
    votes = np.zeros((len(texts), 64), np.int64)
    for lo in range(0, len(of), _BLOCK):
        hi = min(lo + _BLOCK, len(of))
        h = np.fromiter((digest(line[x:y], SEED) for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist())), np.uint64, hi - lo)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.concatenate(([True], of[lo + 1:hi] != of[lo:hi - 1])))
        votes[of[lo:hi][cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    n = np.bincount(of, minlength=len(texts))
    bits = (2 * votes > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, key="doc_id", text="text", width=4, keep=()) -> DataFrame:
    """``key``, the columns ``keep`` and ``fp`` (a signed long) of every row; nothing is shuffled."""
    def make():
        return lambda texts: (pa.array(fingerprint_batch(texts, width)),)

    return C.map_texts(docs, make, "fp bigint", (key, *keep), text)


def cell_masks(groups: int, errors: int) -> list[int]:
    """Masks over the embedding, one per choice of ``groups - errors`` of the groups of its 32 axes."""
    cuts = [32 * i // groups for i in range(groups + 1)]
    one = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(one, groups - errors)]


def embedding(fp):
    """The 32 bit counts of two-bit segments, each in its own two bits of one long (a column or an array)."""
    if isinstance(fp, np.ndarray):
        return (fp & LOW_BITS) + ((fp >> 1) & LOW_BITS)
    a, b = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))  # the sum, without a checked addition


def near(a: np.ndarray, b: np.ndarray, errors: int) -> np.ndarray:
    """Whether pairs differ in at most so many bits: the Manhattan distance of the embeddings, which no pair's
    Hamming distance is below, drops most pairs; the rest are compared exactly."""
    x, y = embedding(a), embedding(b)
    d = x ^ y  # fields: 0-1, 1-2 and 0-2 apart give 1, 3 and 2
    odd = (d & LOW_BITS)
    two = (d >> 1) & ~d & LOW_BITS
    ok = np.bitwise_count(odd) + 2 * np.bitwise_count(two) <= errors
    out = np.zeros(len(ok), bool)
    at = np.flatnonzero(ok)
    out[at] = np.bitwise_count(a[at] ^ b[at]) <= errors
    return out


def forest(fp: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of one cell: at most one edge per fingerprint."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            hit = near(np.full(len(left), fp[u]), fp[left], errors)
            found = left[hit]
            a.append(np.full(len(found), fp[u]))
            b.append(fp[found])
            queue.extend(found.tolist())
            left = left[~hit]
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _links_in_cells(batches, errors, most, schema):
    """Rows (cell, fp) sorted by cell -> links (a, b), and the rows of cells of over ``most`` rows as (cell, fp)."""
    def out(cells, a, b):
        as_long = lambda x: pa.array(x.astype(np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([cells, as_long(a), as_long(b)], schema=schema)

    def work(cell, part, fp):
        change = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))))
        size = np.diff(np.concatenate((change, [len(cell)])))
        for s, n in zip(change[size >= 16].tolist(), size[size >= 16].tolist()):
            a, b = forest(fp[s:s + n], errors)
            if len(a):
                yield out(pa.nulls(len(a), pa.int64()), a, b)
        place = np.repeat(size, size) - (np.arange(len(cell)) - np.repeat(change, size))  # rows from here to the cell's end
        small = np.repeat(size < 16, size)
        for step in range(1, 16):
            i = np.flatnonzero(small & (place > step))
            if not len(i):
                break
            i = i[near(fp[i], fp[i + step], errors)]
            if len(i):
                yield out(pa.nulls(len(i), pa.int64()), fp[i], fp[i + step])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    hot = None  # the cell whose rows are passed on
    for batch in batches:
        rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        if hot is not None:
            n = int(np.argmin(np.concatenate(((rows[0] == hot[0]) & (rows[1] == hot[1]), [False]))))
            if n:
                yield out(pa.array(rows[0][:n]), rows[2][:n], rows[2][:n])
            rows = [x[n:] for x in rows]
            if not len(rows[0]):
                continue
            hot = None
        held = [np.concatenate(x) for x in zip(held, rows)]
        c, p = held[0], held[1]
        tail = int(np.searchsorted(-((c != c[-1]) | (p != p[-1])).astype(np.int8), 0, side="left"))
        done, held = [x[:tail] for x in held], [x[tail:] for x in held]
        if len(done[0]):
            yield from work(*done)
        if most and len(held[0]) > most:
            hot = (held[0][0], held[1][0])
            yield out(pa.array(held[0]), held[2], held[2])
            held = [x[:0] for x in held]
    if len(held[0]):
        yield from work(*held)


def links(fps: DataFrame, errors=4, groups=7, most=4096) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that join all that differ in at most ``errors`` bits.

    Bit counts of 32 two-bit segments embed a fingerprint in a grid; the Manhattan distance there is at most
    the Hamming distance. Of ``groups`` groups of axes, ``groups - errors`` agree for any link, so the pair
    meets in a cell of one of the C(groups, errors) projections on that many groups (35 by default). Cells
    give spanning forests, not all pairs: the links lost are implied. A cell of over ``most`` fingerprints is
    passed on and cut in blocks that meet two by two, so that no task holds an unbounded cell. Rows shuffled:
    35 a fingerprint; with far more than 10^8 distinct fingerprints raise ``groups`` (narrower cells).
    """
    masks = F.array(*[F.lit(m) for m in cell_masks(groups, errors)])
    keyed = fps.select("fp", embedding(F.col("fp")).alias("e")).select("fp", "e", F.posexplode(masks).alias("m", "mask"))
    cells = keyed.select(F.xxhash64("m", F.col("e").bitwiseAND(F.col("mask"))).alias("cell"), F.lit(0).cast("bigint").alias("part"), "fp")
    import pyspark.sql.types as T

    ddl = T.StructType([T.StructField(x, T.LongType()) for x in ("cell", "a", "b")])
    arrow = pa.schema([(x, pa.int64()) for x in ("cell", "a", "b")])

    def run(df, limit):
        return df.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(
            lambda it: _links_in_cells(it, errors, limit, arrow), ddl)

    first = written(run(cells, most), "links")
    found = first.where("cell is null").select("a", "b")
    over = first.where("cell is not null").select("cell", F.col("a").alias("fp"))
    big = over.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * 2 / most).cast("int").alias("n"))
    block = over.join(big, "cell").withColumn("i", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("n")).cast("int"))
    pairs = block.select("cell", "fp", "i", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j")).select(
        "cell", (F.least("i", "j") * F.col("n").cast("bigint") + F.greatest("i", "j")).alias("part"), "fp")
    return found.union(run(pairs, 0).select("a", "b")).distinct()


def groups_of(prints: DataFrame, key="doc_id", errors=4, **options) -> DataFrame:
    """``fp``, ``label`` (least fingerprint of its component) and ``component_id`` (least id of the component)
    for each distinct fingerprint; copies are one fingerprint, counted before any join."""
    fps = written(prints.groupBy("fp").agg(F.min(key).alias("rep")), "fps")
    labels = written(C.components(links(fps, errors, **options)), "labels")
    own = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = own.groupBy("label").agg(F.min("rep").alias("component_id"))
    return own.select("fp", "label").join(least, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, key="doc_id", text="text", width=4, errors=4, **options) -> DataFrame:
    """``key``, ``fingerprint`` (hex) and ``component_id`` of every row.

    Texts without words have fingerprint zero and link like others (so do null texts). Null ids keep their
    row and never name a component that has another id; repeated rows are repeated in the result.
    An empty table gives no rows. Only id and text are read, so other columns may have any name.
    """
    prints = written(fingerprints(docs, key, text, width), "prints")
    return prints.join(groups_of(prints, key, errors, **options), "fp").select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, key="doc_id", text="text", **options) -> DataFrame:
    """One document of each component stays: the one with the least id. Columns as given.

    Rows equal in id and text are one document. Documents with null ids stay only where their component has
    no other.
    """
    rows = docs.withColumn("__dm_x", F.xxhash64(text))
    prints = written(fingerprints(rows, key, text, keep=("__dm_x",)), "prints")
    stay = prints.join(groups_of(prints, key, **options), "fp").where(F.col(key).eqNullSafe(F.col("component_id"))).select(
        F.col(key).alias("__dm_stay"), F.col("__dm_x").alias("__dm_y")).distinct()
    rows = rows.join(stay, F.col(key).eqNullSafe(F.col("__dm_stay")) & (F.col("__dm_x") == F.col("__dm_y")), "left_semi")
    return rows.dropDuplicates([key, "__dm_x"]).select(*docs.columns)
