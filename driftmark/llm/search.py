"""Ranked lexical search: item and document trees of coordinate maxima, pruned by node-pair bounds."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import new_folder, written
from . import common as C

#: Words are runs of ASCII letters and digits and of all else beyond ASCII.
CLASSES = C.byte_classes(between=[b for b in range(128) if not chr(b).isalnum()])
#: Characters of items that are searched together; documents of a tree, of a leaf; leaves of a middle node; items of a leaf.
BLOCK_CHARS, TREE_DOCS, LEAF_DOCS, FAN, LEAF_ITEMS = 4_000_000, 1 << 15, 32, 16, 8
#: Bytes of text handled at once.
CHUNK_BYTES = 8 << 20


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def item_terms(texts: pa.Array) -> list[list[str]]:
    """The distinct terms of each text."""
    words, at, _ = C.byte_words(texts, CLASSES)
    ends = np.searchsorted(at, np.arange(len(texts)), side="right")
    words = words.to_pylist()
    return [sorted(set(words[a:b])) for a, b in zip([0, *ends[:-1]], ends)]


def vectors(docs: DataFrame, vocabulary: pa.Array, key="doc_id", text="text") -> DataFrame:
    """Of every document its number of terms ``n``, and the vocabulary's terms in it with their occurrences."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    schema = StructType([StructField("id", docs.schema[key].dataType), *_parse_datatype_string("row bigint, n bigint, terms array<int>, tf array<int>").fields])
    arrow = _arrow(schema)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        row, known = TaskContext.get().partitionId() << 40, sent.value
        for b in C.gathered(batches, 1, CHUNK_BYTES):
            words, doc, _ = C.byte_words(b.column(1).combine_chunks(), CLASSES)
            code, distinct = C.coded(words)
            term = pc.fill_null(pc.index_in(distinct, known), -1).to_numpy().astype(np.int64)[code]
            pair, tf = np.unique(doc[term >= 0] * max(1, len(known)) + term[term >= 0], return_counts=True)
            at = np.searchsorted(pair // max(1, len(known)), np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (pair % max(1, len(known)), tf)]
            n = np.bincount(doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(
                [b.column(0).combine_chunks(), pa.array(row + np.arange(b.num_rows)), pa.array(n), *lists], arrow)], schema=arrow)
            row += b.num_rows

    return rows.mapInArrow(run, schema)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _impacts(w, tf, n, documents, terms):
    """What a term adds to a document's score."""
    m = 10 + (90 * n * documents) // max(1, terms)
    return w * ((1000000000 * tf) // (1000 * tf + 8 * m))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact integer sums by place."""
    low = np.bincount(at, values & 0xFFFFF, n).astype(np.int64)
    return low + (np.bincount(at, values >> 20, n).astype(np.int64) << 20)


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges low to high, joined."""
    size = high - low
    return np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


class Level:
    """Nodes of one level, by term: the nodes that hold the term and the largest impact it has in each."""

    def __init__(self, ptr, node, most):
        self.ptr, self.node, self.most = ptr, node, most

    @classmethod
    def of(cls, term, node, most, terms):
        """From entries sorted by (term, node), repeated where a node's documents share a term."""
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (node[1:] != node[:-1])))) if len(term) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(most, first) if len(first) else most[:0]
        return cls(np.searchsorted(term[first], np.arange(terms + 1)), node[first], top)

    def bounds(self, terms: np.ndarray, nodes: int) -> np.ndarray:
        """By node: the sum of the largest impacts of the terms, which no document below exceeds."""
        at = _spans(self.ptr[terms], self.ptr[terms + 1])
        return _sums(self.node[at], self.most[at], nodes)


class Tree:
    """Documents in the order of their strongest terms, and three levels of maxima over runs of them."""

    def __init__(self, ids: pa.Array, doc, term, most):
        self.ids, self.docs = ids, len(ids)
        self.terms, local = np.unique(term, return_inverse=True)
        order = np.lexsort((doc, local))
        doc, local, most = doc[order], local[order], most[order]
        self.leaves, self.middles = -(-self.docs // LEAF_DOCS), -(-self.docs // (LEAF_DOCS * FAN))
        make = lambda node: Level.of(local, node, most, len(self.terms))
        self.levels = [make(doc), make(doc // LEAF_DOCS), make(doc // (LEAF_DOCS * FAN)), make(np.zeros_like(doc))]
        self.place = np.empty(self.docs, np.int64)  # by document: its place in the order of ids, null last
        self.place[pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()] = np.arange(self.docs)

    def local(self, terms: np.ndarray) -> np.ndarray:
        """The tree's own numbers of those terms that it has."""
        at = np.searchsorted(self.terms, terms)
        at = at[at < len(self.terms)] if len(at) else at
        return at[self.terms[at] == terms[:len(at)]] if len(at) else at

    def scores(self, terms: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) of the documents below these (sorted) leaves that hold a term."""
        base = self.levels[0]
        at = []
        for t in terms.tolist():
            own = base.node[base.ptr[t]:base.ptr[t + 1]]
            low, high = np.searchsorted(own, leaves * LEAF_DOCS), np.searchsorted(own, (leaves + 1) * LEAF_DOCS)
            at.append(base.ptr[t] + _spans(low, high))
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        doc, slot = np.unique(base.node[at], return_inverse=True)
        return doc, _sums(slot, base.most[at], len(doc))


class Items:
    """Items in the order of their rarest terms, in a tree whose nodes hold the union of their items' terms."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        order = sorted(range(len(terms)), key=lambda i: sorted(((-int(weights[t]), int(t)) for t in terms[i]))[:4])
        self.terms = terms
        nodes = [(np.array([i]), []) for i in order]
        size = LEAF_ITEMS
        while len(nodes) > 1:
            nodes = [(np.concatenate([n[0] for n in nodes[a:a + size]]), nodes[a:a + size]) for a in range(0, len(nodes), size)]
            size = 4
        self.root = nodes[0] if nodes else None
        self.unions = {}
        self._union(self.root) if nodes else None

    def _union(self, node):
        got = self.terms[node[0][0]] if not node[1] else reduce(np.union1d, [self._union(c) for c in node[1]])
        self.unions[id(node)] = got
        return got

    def union(self, node) -> np.ndarray:
        return self.unions[id(node)] if self.unions else self.terms[node[0][0]]


class Best:
    """By item: the best (score, id) rows so far, and the score that a further one must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.rows, self.least = k, [[] for _ in least], least.copy()

    def add(self, item: int, tree: Tree, doc: np.ndarray, score: np.ndarray):
        keep = score >= max(1, self.least[item])
        doc, score = doc[keep], score[keep]
        if not len(doc):
            return
        top = np.lexsort((tree.place[doc], -score))[:self.k]
        new = list(zip(score[top].tolist(), tree.ids.take(pa.array(doc[top])).to_pylist()))
        rows = sorted(self.rows[item] + new, key=lambda x: (-x[0], x[1] is None, x[1]))[:self.k]
        self.rows[item] = rows
        if len(rows) == self.k:
            self.least[item] = max(self.least[item], rows[-1][0])


def search(tree: Tree, items: Items, best: Best) -> int:
    """Adds the tree's documents that can be among an item's best; returns how many documents were scored.

    A pair of an item node and a document node is left, with everything below both, where the sum of the document
    node's maxima over the item node's terms is less than the least score that any of its items still needs. What
    could tie is never left. Middle nodes that a pair leaves are not looked at again below it.
    """
    scored = 0

    def visit(node, alive):
        nonlocal scored
        members, below = node
        terms = tree.local(items.union(node))
        least = max(1, int(best.least[members].min()))
        if not len(terms) or tree.levels[3].bounds(terms, 1)[0] < least:
            return
        alive = alive & (tree.levels[2].bounds(terms, tree.middles) >= least)
        if not alive.any():
            return
        if below:
            for x in below:
                visit(x, alive)
            return
        item = int(members[0])
        bound = tree.levels[1].bounds(terms, tree.leaves)
        leaves = np.flatnonzero((bound >= least) & alive[np.arange(tree.leaves) // FAN])
        leaves = leaves[np.argsort(-bound[leaves], kind="stable")]
        step = 4
        while len(leaves):  # strongest first, so that the needed score rises early
            now = np.sort(leaves[:step])
            doc, score = tree.scores(terms, now)
            scored += len(doc)
            best.add(item, tree, doc, score)
            leaves = leaves[step:]
            leaves = leaves[bound[leaves] >= max(1, best.least[item])]
            step *= 2

    if items.root is not None:
        visit(items.root, np.ones(tree.middles, bool))
    return scored


def seeds(tree: Tree, items: Items, best: Best) -> None:
    """Scores each item's strongest leaf, if it can matter."""
    for item, terms in enumerate(items.terms):
        own = tree.local(terms)
        if not len(own) or tree.levels[3].bounds(own, 1)[0] < max(1, best.least[item]):
            continue
        bound = tree.levels[1].bounds(own, tree.leaves)
        best.add(item, tree, *tree.scores(own, np.array([int(bound.argmax())])))


def _trees(batches):
    """Trees of a task's documents: (id, doc offsets, terms, impacts) rows, in bounded batches."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, TREE_DOCS // 4):
            held.append(b.slice(at, TREE_DOCS // 4))
            n += held[-1].num_rows
            if n >= TREE_DOCS:
                yield _tree(held)
                held, n = [], 0
    if held:
        yield _tree(held)


def _tree(held) -> Tree:
    t = pa.Table.from_batches(held).combine_chunks()
    lists = t.column(1).combine_chunks()
    doc = np.repeat(np.arange(t.num_rows), pc.list_value_length(lists).to_numpy())
    return Tree(t.column(0).combine_chunks(), doc, pc.list_flatten(lists).to_numpy().astype(np.int64), pc.list_flatten(t.column(2).combine_chunks()).to_numpy())


def _block(docs: DataFrame, block: list[tuple[int, list[str]]], k: int, key: str, text: str) -> DataFrame:
    """(item number, score, key) of the best rows of each item, a task's own best at most."""
    spark = docs.sparkSession
    vocabulary = pa.array(sorted({t for _, x in block for t in x}), pa.large_string())
    rows = written(vectors(docs, vocabulary, key, text), "vectors")
    documents, length = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block
        df[term] = n
    weights = np.array([weight(documents, int(x)) for x in df], np.int64)
    index = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    items = Items([np.array(sorted(index[t] for t in x), np.int64) for _, x in block], weights)
    sent = spark.sparkContext.broadcast((weights, items.terms))
    kind = rows.schema["id"].dataType
    schema = StructType([StructField("id", kind), *_parse_datatype_string("row bigint, terms array<int>, impacts array<bigint>, k1 int, k2 int, k3 int").fields])
    arrow = _arrow(schema)

    def impacts(batches):
        w = sent.value[0]
        for b in batches:
            lists = b.column(3)
            term, tf = pc.list_flatten(lists).to_numpy().astype(np.int64), pc.list_flatten(b.column(4)).to_numpy().astype(np.int64)
            size = pc.list_value_length(lists).to_numpy()
            doc = np.repeat(np.arange(b.num_rows), size)
            value = _impacts(w[term], tf, b.column(2).to_numpy()[doc], documents, length)
            order = np.lexsort((term, -value, doc))
            begin = np.cumsum(size) - size
            keys = []
            for i in range(3):  # the strongest terms, which put like documents side by side
                own = np.full(b.num_rows, -1, np.int64)
                own[size > i] = term[order[begin[size > i] + i]]
                keys.append(own)
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            cols = [b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(value)),
                    *map(pa.array, keys)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, arrow)], schema=arrow)

    near = ["k1", "k2", "k3", "row"]
    placed = rows.where(F.size("terms") > 0).mapInArrow(impacts, schema).repartitionByRange(*near).sortWithinPartitions(*near).select("id", "terms", "impacts")
    placed = written(placed, "placed")
    found = StructType([*_parse_datatype_string("item int, score bigint").fields, StructField("id", kind)])
    out = _arrow(found)

    def over(visit, least):
        def run(batches):
            w, terms = sent.value
            own, best = Items(terms, w), Best(least, k)
            for tree in _trees(batches):
                visit(tree, own, best)
            rows_ = [(i, s, d) for i, x in enumerate(best.rows) for s, d in x]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows_], f.type) for j, f in enumerate(out)], schema=out)

        return placed.mapInArrow(run, found)

    first = over(seeds, np.zeros(len(block), np.int64))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
    least = np.zeros(len(block), np.int64)
    for item, score in first.withColumn("r", rank).where(F.col("r") == k).select("item", "score").collect():  # one row an item of the block
        least[item] = score
    best = over(search, least)
    return best.select((F.col("item") + F.lit(block[0][0])).alias("item"), "score", "id")  # a block's numbers follow each other


def ranked(docs: DataFrame, items: DataFrame, k=10, key="doc_id", text="text", item_key="item_id", item_text="text", block_chars=BLOCK_CHARS) -> DataFrame:
    """``item_key``, ``rank``, ``key`` and ``score`` of the ``k`` highest-scoring documents of each item (all, if fewer).

    Items are searched in blocks of bounded text, each against all documents: the block's vocabulary and item tree go
    to the tasks. Documents become vectors of the block's terms, range-sorted by their strongest terms, so that a
    run of them has tight maxima; trees over bounded runs are built in the tasks. A first pass scores each item's
    strongest leaves; the k-th best score found so is the least that the second pass, the search, looks for.

    Null and empty texts have no term, match nothing, and an item without a match has no rows. Equal scores stand by
    ascending document id, null ids last; every row of repeated documents ranks; rows of items that agree in id and
    text are one item. Empty tables give no rows. Only ids and texts are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    wanted = written(items.select(F.col(item_key).alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct(), "items")
    whole = C.prefix_sums(wanted.withColumn("chars", F.length("text").cast("long")).withColumn("one", F.lit(1)), [], ["id", "text"], {"before": "chars", "number": "one"})
    whole = written(whole.select("id", "text", "number", F.expr(f"before div {int(block_chars)}").alias("block")), "blocks")
    parts = []
    for (block,) in whole.select("block").distinct().orderBy("block").collect():
        t = whole.where(F.col("block") == block).orderBy("number").select("number", "text").toArrow()  # one block
        listed = list(zip(t.column(0).to_pylist(), item_terms(t.column(1).combine_chunks())))
        parts.append(_block(docs, listed, k, key, text))
    if not parts:
        kinds = {f.name: f.dataType for f in docs.schema.fields} | {f"_{f.name}": f.dataType for f in items.schema.fields}
        return spark.createDataFrame([], StructType([StructField(item_key, kinds[f"_{item_key}"]), *_parse_datatype_string("rank int").fields,
                                                     StructField(key, kinds[key]), *_parse_datatype_string("score bigint").fields]))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    best = reduce(DataFrame.union, parts).withColumn("rank", rank).where(F.col("rank") <= k)
    names = whole.select(F.col("number").alias("item"), F.col("id").alias("__dm_item"))
    return best.join(names, "item").select(F.col("__dm_item").alias(item_key), "rank", F.col("id").alias(key), "score")


#: What the operator returns under its default parameters.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS nd, sum(len(ts))::BIGINT AS l FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, nd),
x AS (SELECT q.item_id, tf.r, any_value(tf.doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY q.item_id, tf.r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10"""
