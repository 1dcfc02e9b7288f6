"""Phrase collocations: dynamic itemset counting over cyclic shard scans, scored by their weakest cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder, written
from . import common as C

#: Shards of the corpus, which are scanned by turns; words of the corpus to a slot of the activation table (one byte
#: each), and its least and largest size (what a task gets is bounded by the latter).
SHARDS, WORDS_PER_SLOT, LEAST_SLOTS, MOST_SLOTS = 3, 16, 1 << 16, 1 << 27
#: Slots of a block of the table.
BLOCK = 1 << 14
#: Words of the longest phrase.
LONGEST = 4
#: Bytes of text that share a dictionary; bounds a task's memory.
CHUNK_BYTES = 3 << 20
#: Borders of pieces, and what stands between the words of one.
CLASSES = C.byte_classes(border=b".,;:!?\n\x0b\x0c\r", between=b" \t")
#: In the activation table: no phrase of this slot has reached the threshold.
NEVER = 255
# Odd multipliers of a 64-bit mix.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9))
CODED = "shard int, langs array<string>, totals array<bigint>, words array<string>, word_lang binary, hashes binary, codes binary"
COUNTED = "exact boolean, lang string, phrase string, n bigint, block int, at binary, add binary"


def encoded(docs: DataFrame, folder: str, shards=SHARDS, chunk_bytes=CHUNK_BYTES, lang="lang", text="text") -> DataFrame:
    """The texts of each chunk as codes of its own (language, word) dictionary, -1 at every border; dealt to shards.

    A chunk is a bounded run of texts (a longer text is a chunk of its own). Chunks go to the shards by turns, so
    every task has some of each shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    arrow = _arrow(CODED)

    def run(batches):
        part = TaskContext.get().partitionId()
        for count, b in enumerate(C.gathered(batches, 1, chunk_bytes)):
            words, doc, apart = C.byte_words(b.column(1).combine_chunks(), CLASSES)
            if not len(words):
                continue
            langs = b.column(0).combine_chunks().dictionary_encode()
            of_doc, names = langs.indices.to_numpy().astype(np.int64), langs.dictionary
            code, distinct = C.coded(words)
            both = pa.array(code * len(names) + of_doc[doc]).dictionary_encode()
            code, pair = both.indices.to_numpy(), both.dictionary.to_numpy()
            often = np.argsort(-np.bincount(code, minlength=len(pair)), kind="stable")  # frequent words have small codes, which compress well
            code, pair = np.argsort(often).astype(np.int32)[code], pair[often]
            word, word_lang = distinct.take(pa.array(pair // len(names))), pair % len(names)
            salt = np.array([xxhash.xxh64_intdigest(x, 1) for x in names.to_pylist()], np.uint64)
            hashes = np.array([xxhash.xxh64_intdigest(x) for x in word.to_pylist()], np.uint64) * _MIX[1] + salt[word_lang]
            row = [part + count, names.to_pylist(), np.bincount(of_doc[doc], minlength=len(names)).tolist(), word, word_lang.astype(np.int32).tobytes(),
                   hashes.tobytes(), np.insert(code, np.flatnonzero(apart), -1).tobytes()]
            row[0] %= shards
            cols = [pa.ListArray.from_arrays(pa.array([0, len(word)], pa.int32()), word.cast(pa.string())) if f.name == "words" else pa.array([x], f.type)
                    for x, f in zip(row, arrow)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)
            pa.default_memory_pool().release_unused()

    rows.mapInArrow(run, CODED).write.partitionBy("shard").parquet(folder, compression="zstd")
    return spark.read.schema(CODED).parquet(folder)


def _arrow(ddl):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _slots(hashes: np.ndarray, length: int, slots: int) -> np.ndarray:
    h = (hashes + np.uint64(length)) * _MIX[2]
    h ^= h >> np.uint64(31)
    h *= _MIX[0]
    return ((h >> np.uint64(20)) % np.uint64(slots)).astype(np.int64)


def active(words: pa.Array, hashes: np.ndarray, codes: np.ndarray, reached: np.ndarray, step: int, shards: int, longest=LONGEST):
    """(length, phrases, first word's code, slots, counts, in slots, exact) of the phrases that a chunk has in ``step``:
    which of them count in their slot now, and which count exactly.

    ``reached`` holds, for each slot, the step in which the slot's count first stood at the threshold. A phrase counts
    as reached once its own slot is and both of its subphrases are; its slot counts it for one cycle from the step
    after its later subphrase, and it is counted exactly for one cycle from the step after it is reached itself. These
    steps follow from the table alone, so they are the same in all chunks. A slot's count is never less than that
    of a phrase in it, so no frequent phrase is missed; what shares a slot with others may be counted needlessly.
    """
    held = codes >= 0
    slot = _slots(hashes, 1, len(reached))
    own_step, start = reached[slot].astype(np.int64), np.zeros(len(words), np.int64)  # every word starts in step 0
    n = np.bincount(codes[held], minlength=len(words))
    yield 1, words, np.arange(len(words)), slot, n, (own_step == NEVER) & (step < start + shards), (own_step < NEVER) & (step <= own_step + shards)
    when = np.full(len(codes), NEVER, np.int16)  # by place: the step in which the phrase that begins there was reached
    when[held] = own_step[codes[held]]
    ident, phrases, hash_of = codes, words, hashes
    for length in range(2, longest + 1):
        places = np.flatnonzero((when[:-1] < NEVER) & (when[1:] < NEVER))
        if not len(places):
            return
        key = pa.array(ident[places].astype(np.int64) * len(words) + codes[places + length - 1]).dictionary_encode()
        own = key.indices.to_numpy()
        some = np.empty(len(key.dictionary), np.int64)
        some[own] = places  # a place of each phrase
        start = np.maximum(when[some], when[some + 1]).astype(np.int64) + 1
        prefix, last = ident[some], codes[some + length - 1]
        hash_of = (hash_of[prefix] ^ (hash_of[prefix] >> np.uint64(29))) * _MIX[0] + hashes[last]
        phrases = _Joined(phrases, prefix, words, last)
        slot = _slots(hash_of, length, len(reached))
        own_step = np.where(reached[slot] == NEVER, NEVER, np.maximum(reached[slot], start - 1))
        yield (length, phrases, codes[some], slot, np.bincount(own, minlength=len(some)), (own_step == NEVER) & (step < start + shards),
               (own_step < NEVER) & (step <= own_step + shards))
        when = np.full(len(codes), NEVER, np.int16)
        when[places] = own_step[own]
        ident = np.full(len(codes), -1, np.int32)
        ident[places] = own


class _Joined:
    """Phrases as a prefix and a last word; only those asked for become strings."""

    def __init__(self, phrases, prefix, words, last):
        self.phrases, self.prefix, self.words, self.last = phrases, prefix, words, last

    def take(self, at: pa.Array) -> pa.Array:
        i = at.to_numpy()
        return pc.binary_join_element_wise(self.phrases.take(pa.array(self.prefix[i])), self.words.take(pa.array(self.last[i])), pa.scalar(" ", pa.large_string()))


def _blocks(slots: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Sums by slot as (blocks, places in the block, sums up to 255), two and one bytes each."""
    slot, n = np.concatenate(slots), np.concatenate(counts)
    order = np.argsort(slot, kind="stable")
    slot, n = slot[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, np.int64)
    total = np.minimum(np.add.reduceat(n, first), 255).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
    block, begin = np.unique(slot[first] // BLOCK, return_index=True)
    ends = np.append(begin, len(first)).astype(np.int32)
    at = (slot[first] % BLOCK).astype(np.uint16)
    binary = lambda x, width: pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(ends * np.int32(width)), pa.py_buffer(x)])
    return block, binary(at, 2), binary(total, 1)


def _scan(coded: DataFrame, reached, step: int, shards: int, longest: int) -> DataFrame:
    """Of the shard of this step, by chunk: the exactly counted phrases, and the sums by slot of the others."""
    arrow = _arrow(COUNTED)

    def batch(rows, **own):
        cols = [own[f.name].cast(f.type) if f.name in own else pa.nulls(rows, f.type) for f in arrow]
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    def run(batches):
        table = reached.value
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i] for n in b.schema.names}
                words, langs = row["words"].values.cast(pa.large_string()), pa.array(row["langs"].as_py(), pa.string())
                lang_of = np.frombuffer(row["word_lang"].as_buffer(), np.int32)
                hashes, codes = np.frombuffer(row["hashes"].as_buffer(), np.uint64), np.frombuffer(row["codes"].as_buffer(), np.int32)
                slots, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for _, phrases, first, slot, n, in_slots, exact in active(words, hashes, codes, table, step, shards, longest):
                    slots.append(slot[in_slots])
                    counts.append(n[in_slots])
                    now = np.flatnonzero(exact)
                    for at in range(0, len(now), 1 << 16):
                        x = now[at:at + (1 << 16)]
                        yield batch(len(x), exact=pa.array(np.ones(len(x), bool)), lang=langs.take(pa.array(lang_of[first[x]])),
                                    phrase=phrases.take(pa.array(x)), n=pa.array(n[x].astype(np.int64)))
                block, places, sums = _blocks(slots, counts)
                yield batch(len(block), exact=pa.array(np.zeros(len(block), bool)), block=pa.array(block), at=places, add=sums)
                pa.default_memory_pool().release_unused()

    return coded.where(F.col("shard") == step % shards).select("langs", "words", "word_lang", "hashes", "codes").mapInArrow(run, COUNTED)


SUMMED = "block int, added int, at binary, add binary, over binary"


def _summed(rows: DataFrame, least: int, slots: int, step: int, shards: int) -> DataFrame:
    """Rows (block, added, at, add) summed by slot and by the step that added them; ``over`` has a bit for each slot that
    reached ``least`` within one cycle, which is as long as any phrase counts there.

    Blocks are dealt to the tasks, which add row by row; a task holds its own blocks of the table and no more. What
    the next cycle still needs stays: sums of the last steps, without the slots over the threshold.
    """
    n = min(max(1, slots // BLOCK), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    arrow = _arrow(SUMMED)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, added, at, add in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                total = held.setdefault(block, np.zeros((shards, BLOCK), np.uint16))[added % shards]
                i = np.frombuffer(at.as_buffer(), np.uint16)
                total[i] = np.minimum(total[i] + np.frombuffer(add.as_buffer(), np.uint8), 255)
        for block, total in held.items():
            over = total.sum(0) >= least
            for added in range(max(0, step - shards + 1), step + 1):
                own = total[added % shards]
                i = np.flatnonzero((own > 0) & ~over) if added > step - shards + 1 else np.zeros(0, np.int64)
                bits = np.packbits(over).tobytes() if added == step and over.any() else None
                if len(i) or bits:
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                        (block, added, i.astype(np.uint16).tobytes(), own[i].astype(np.uint8).tobytes(), bits), arrow)], schema=arrow)

    return rows.repartition(n, "block").mapInArrow(run, SUMMED)


def frequent(docs: DataFrame, least=30, shards=SHARDS, slots=None, longest=LONGEST, chunk_bytes=CHUNK_BYTES, lang="lang", text="text") -> tuple[DataFrame, DataFrame]:
    """(lang, len, phrase, n) of all phrases of 1 to ``longest`` words with at least ``least`` occurrences, and the
    number of words of each language (lang, n).

    Dynamic itemset counting: each step scans one shard, by turns, and counts all lengths at once. Counts begin in
    the slots of a table of fixed size, which bound the counts of the phrases in them from above. Words start in the
    first step; a longer phrase starts in the step after both of its subphrases (without the last, without the first
    word) have reached ``least``, long before those have been counted in full. A phrase whose slot reaches ``least``
    gets an exact count, over one full cycle of the shards, and ends. Steps end when nothing can start or is open.
    So few phrases below ``least`` are ever written out, and the exact counts meet in one shuffle at the end.
    ``slots`` follows the number of words, up to a fixed size; more phrases a slot cost time, not truth.
    """
    if not 1 <= shards * (longest + 1) < NEVER or not 1 <= least < NEVER:
        raise ValueError("steps and threshold must fit one byte a slot")
    spark = docs.sparkSession
    root = new_folder(spark, "phrases")
    coded = encoded(docs, f"{root}/coded", shards, chunk_bytes, lang, text)
    words = written(coded.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n")), "words")
    if slots is None:
        total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (int(total) // WORDS_PER_SLOT).bit_length()))
    table = f"{COUNTED}, step int"
    counts = lambda: spark.read.schema(table).parquet(f"{root}/counts")
    sums = lambda step: spark.read.schema(SUMMED).parquet(f"{root}/slots-{step}")
    reached, last = np.full(slots, NEVER, np.uint8), 0
    for step in range(shards * (longest + 1)):
        sent = spark.sparkContext.broadcast(reached)
        _scan(coded, sent, step, shards, longest).write.partitionBy("exact").parquet(f"{root}/counts/step={step}", compression="zstd")
        sent.destroy()
        rows = counts().where((F.col("step") == step) & ~F.col("exact")).select("block", F.lit(step).alias("added"), "at", "add")
        rows = rows.union(sums(step - 1).select("block", "added", "at", "add")) if step else rows
        _summed(rows, least, slots, step, shards).write.parquet(f"{root}/slots-{step}")
        C.drop(spark, f"{root}/counts/step={step}/exact=false")
        if step:
            C.drop(spark, f"{root}/slots-{step - 1}")
        fresh = False
        for block, over in sums(step).where("over is not null").select("block", "over").toLocalIterator():  # a bit a slot at most
            at = block * BLOCK + np.flatnonzero(np.unpackbits(np.frombuffer(over, np.uint8)))
            at = at[reached[at] == NEVER]
            if len(at):
                reached = reached if fresh else reached.copy()
                reached[at], fresh = step, True
        last = step if fresh else last
        if step >= max(shards - 1, last + shards):
            break
    exact = counts().where("exact").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    exact = written(exact.select("lang", F.size(F.split("phrase", " ")).alias("len"), "phrase", "n"), "frequent")
    C.drop(spark, f"{root}/coded")
    return exact, words


def _part(first, size):
    return F.array_join(F.slice("words", first, size), " ")


def collocations(docs: DataFrame, least=30, top=2000, salts=32, **options) -> DataFrame:
    """The ``top`` phrases of 2 to 4 words of each language by their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A cut after ``k`` words has the score floor(2000000 * a / (l + r)) of the phrase's count ``a`` and its parts'
    counts; the lowest cut counts (the smallest k of equal ones). Phrases inside a longer one that has at least 80%
    of their count go. Arithmetic is decimal, so products may pass 64 bits. The first rows are picked per salted
    share of a language, then per language, so a language of most rows meets in no task.

    Null texts are empty, a null language is ``und`` (and is counted together with a real ``und``); repeated rows
    count each; equal scores stand by count, then by the bytes of the phrase; an empty table gives no rows. Only
    language and text are read, so other columns may have any name.
    """
    counts, words = frequent(docs, least, **options)
    parts = counts.select("lang", "phrase", "n")
    cand = counts.where("len >= 2").select("lang", "phrase", "len", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = cand.withColumn("k", F.explode(F.expr("sequence(1, len - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("_l"), _part(F.col("k") + 1, F.col("len") - F.col("k")).alias("_r"))
    for side in ("l", "r"):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(f"_{side}"), F.col("n").alias(side)), ["lang", f"_{side}"])
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("t", F.lit(2000000).cast("decimal(7,0)") * big("a")).withColumn("s", big("l") + big("r"))
    best = cuts.withColumn("score", F.expr("t div s")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x"))
    inside = cand.where("len >= 3").withColumn("m", F.explode(F.expr("sequence(2, len - 1)"))).withColumn("i", F.explode(F.expr("sequence(1, len - m + 1)")))
    inside = inside.select("lang", _part(F.col("i"), F.col("m")).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    left = best.select("lang", "phrase", "x.*").join(inside, ["lang", "phrase"], "left")
    left = left.where(F.col("f").isNull() | (big("f") * 100 < big("a") * 80))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = left.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    share = share.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_n") <= top)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: What the operator returns under its default parameters.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, greatest(len(ws) - m, 0) + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS cnt, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
x AS MATERIALIZED (SELECT lang, phrase, cnt, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:m], ' ') AS rp
  FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
c AS (SELECT x.lang, x.phrase, x.cnt AS a, k, l.cnt AS l, r.cnt AS r, ((2000000::HUGEINT * x.cnt) // (l.cnt + r.cnt))::BIGINT AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.phrase = x.rp),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(cnt) AS cnt FROM (SELECT lang, cnt, unnest(list_transform(range(1, m - s + 2), lambda i: array_to_string(ws[i:i + s - 1], ' '))) AS phrase
  FROM f, (SELECT unnest([2, 3]) AS s) WHERE s < m) GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n, b.score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.cnt IS NULL OR 100::HUGEINT * i.cnt < 80::HUGEINT * b.a QUALIFY rank <= 2000"""
