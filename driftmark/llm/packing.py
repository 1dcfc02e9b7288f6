"""Packing: documents cut to sequences of a fixed length, balanced by their attention cost."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from . import common as C

#: Tokens of a sequence; the id that ends a document; hidden width of the model whose cost is estimated.
LENGTH, END, WIDTH = 2048, 1, 1024
#: Bytes of text and documents that are packed together; bounds a task's memory.
PACK_BYTES, PACK_ROWS = 16 << 20, 1 << 15
#: Characters of a long text that are encoded at once.
PART_CHARS = 1 << 18


def encoder(path: str | None = None):
    """A function from a text to the ids of the byte-level BPE in a tokenizer file (default: the public 50k one).

    The merges run in tiktoken, three times as fast as the library that the file is written for and equal to it on
    every code point; special tokens in a text get their own ids, as there. A long text is cut at a space between
    two ASCII letters, where the file's word pattern always begins a new piece.
    """
    import public_tokenizers
    import regex
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 0x100
    of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    seam = regex.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

    def encode(text: str) -> np.ndarray:
        parts, at = [], 0
        while len(text) - at > PART_CHARS:
            m = seam.search(text, at + PART_CHARS)
            if not m:
                break
            parts.append(bpe.encode_to_numpy(text[at:m.start()], allowed_special="all"))
            at = m.start()
        parts.append(bpe.encode_to_numpy(text[at:], allowed_special="all"))
        return np.concatenate(parts)

    return encode


def cost(length, width=WIDTH):
    """Estimated cost of attending within a piece: linear (projections and feed-forward) plus quadratic (attention)."""
    return 6 * width * length + length * length


def capacities(total: int, length=LENGTH) -> np.ndarray:
    """Sequence lengths that hold ``total`` tokens without padding: whole ones, and a power of two per bit of the rest."""
    whole, rest = divmod(int(total), length)
    return np.array([length] * whole + [1 << k for k in reversed(range(length.bit_length())) if rest >> k & 1], np.int64)


def balanced(sizes: np.ndarray, length=LENGTH, width=WIDTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in it, tokens, sequence, offset there) that fill the sequences of ``capacities(sum)``.

    Items (of at most ``length`` tokens) come in descending order; each goes whole to the sequence of the lowest cost
    so far that has room for it. Where none has, it's cut over those with the most room.
    """
    room = capacities(sizes.sum(), length)
    used, load = np.zeros(len(room), np.int64), np.zeros(len(room))
    out = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        start, left = 0, int(sizes[i])
        while left:
            at = int(np.where(room >= left, load, np.inf).argmin())
            if room[at] < left:
                at = int(room.argmax())
            n = min(left, int(room[at]))
            out.append((i, start, n, at, int(used[at])))
            room[at] -= n
            used[at] += n
            load[at] += cost(n, width)
            start, left = start + n, left - n
    return out


def packed(docs: DataFrame, length=LENGTH, end=END, width=WIDTH, key="doc_id", text="text", tokenizer=None) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is its text's ids and the ``end`` id. Runs of ``length`` ids are sequences of their own; what is left
    of each document is packed with the others of a bounded batch, by descending cost. The batch's tokens fill its
    sequences exactly: whole ones, and a power of two for each bit of the rest. Batches are what a task reads, so
    nothing is shuffled and no batch waits for another; which documents share one follows the layout of the files.

    Null and empty texts are the end id alone; null ids and repeated rows are packed each; a text of any length is
    encoded whole; equal sizes keep their order; an empty table gives no rows. Only id and text are read, so other
    columns may have any name.
    """
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    out = StructType([StructField(key, docs.schema[key].dataType), *_parse_datatype_string(
        "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        encode, next_id = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for b in C.gathered(batches, 1, PACK_BYTES, PACK_ROWS):
            ids = [np.append(encode(t or ""), end).astype("<u4") for t in b.column(1).to_pylist()]
            sizes = np.array([len(x) for x in ids], np.int64)
            full = sizes // length
            pieces = [(i, k * length, length, n, 0) for n, (i, k) in enumerate((i, k) for i in np.flatnonzero(full).tolist() for k in range(full[i]))]
            first = len(pieces)
            pieces += [(i, int(full[i]) * length + start, n, first + at, offset) for i, start, n, at, offset in balanced(sizes % length, length, width)]
            doc, start, n, sequence, offset = np.array(pieces, np.int64).T
            crc = [zlib.crc32(ids[i][a:a + k].tobytes()) for i, a, k, _, _ in pieces]
            cols = [b.column(0).combine_chunks().take(pa.array(doc)), start, n, crc, sizes[doc], next_id + sequence, offset]
            whole = pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)
            next_id += int(sequence.max()) + 1

    return rows.mapInArrow(run, out)
