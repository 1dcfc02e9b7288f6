"""Phrase mining, ranked search and packing against brute force, on small tables with awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftmark.llm import packing, phrases, search

EXTRA = ["len", "n", "start", "hit", "step", "state", "phrase", "words", "a", "l", "r", "score", "rank", "id", "row", "terms", "item",
         "block", "number", "chars", "_l", "_s", "k", "sequence_id", "offset", "length", "doc_tokens"]
rng = random.Random(7)
VOCAB = ["red", "Blue", "green", "of", "the", "fox", "ünder", "x\x1fy", "<|endoftext|>", "nbsp\xa0joined", "\U0001f600"]


def sentence(n):
    return "".join(rng.choice(VOCAB) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(n))


ROWS = [(i, sentence(rng.randint(1, 60)), rng.choice(["en", "en", "de", None]), f"s{i % 3}") for i in range(120)]
ROWS += [(i, "the red fox of the red fox of the red fox", "en", "copy") for i in range(200, 260)]  # a third of all rows
ROWS += [(300, None, "en", "a"), (301, "", None, None), (302, " \t\n.,;", "de", "a"), (None, "the red fox", "en", "a"), (None, "the red fox", "en", "a"),
         (303, "the blue fox " * 6000, "und", "a"), (304, "the", "fr", None), (200, "the red fox of the red fox of the red fox", "en", "copy"),
         (305, "a" * 5000 + " THE RED FOX", "en", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(c) for c in EXTRA}).repartition(5)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- phrases ------------------------------------------------------------------------------------

def counted_by_hand(rows):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for m in range(1, 5):
                counts[lang or "und"].update(" ".join(w[i:i + m]) for i in range(len(w) - m + 1))
    return counts, totals


def collocations_by_hand(rows, least, top):
    counts, totals = counted_by_hand(rows)
    out = []
    for lang, f in counts.items():
        kept = {p: (p.split(" "), a) for p, a in f.items() if a >= least and " " in p}
        ranked = []
        for p, (w, a) in kept.items():
            if any(100 * b >= 80 * a and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v))) for v, b in kept.values()):
                continue
            cut = min((2000000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            ranked.append((-cut[0], -a, p.encode(), f[" ".join(w[:cut[1]])], f[" ".join(w[cut[1]:])]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("shards,slots", [(1, None), (3, 1 << 16), (4, 1 << 14)])
def test_phrase_counts_equal_brute_force(docs, shards, slots):
    counts, totals = counted_by_hand(ROWS)
    got, words = phrases.frequent(docs, 5, shards=shards, slots=slots, chunk_bytes=2000)
    want = sorted((lang, len(p.split(" ")), p, n) for lang, f in counts.items() for p, n in f.items() if n >= 5)
    assert sorted(rows_of(got)) == want
    assert dict(rows_of(words)) == {k: v for k, v in totals.items() if v}


def test_collocations_equal_brute_force(docs):
    got = sorted(rows_of(phrases.collocations(docs, least=4, top=25, chunk_bytes=4000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")))
    assert got == collocations_by_hand(ROWS, 4, 25)
    assert len({lang for lang, *_ in got}) > 2


def test_longer_phrases_start_before_shorter_ones_are_done():
    """In the second shard of a cycle the pairs of the first one's frequent words are counted already."""
    words = pa.array(["a", "b"], pa.large_string())
    hashes, codes = np.array([11, 22], np.uint64), np.array([-1, 0, 1, 0, 1], np.int32)
    reached = np.full(1 << 10, phrases.NEVER, np.uint8)
    seen = lambda step: {x[0]: (x[1].take(pa.array([0, 1])).to_pylist(), *(v.tolist() for v in x[4:])) for x in phrases.active(words, hashes, codes, reached, step, 3)}
    assert seen(0) == {1: (["a", "b"], [2, 2], [True, True], [False, False])}
    reached[phrases._slots(hashes, 1, 1 << 10)] = 0
    for step in (1, 2, 3):
        assert seen(step)[1][2:] == ([False, False], [True, True])
        assert seen(step)[2] == (["a b", "b a"], [2, 1], [True, True], [False, False])
    assert seen(4)[1][2:] == seen(4)[2][2:] == ([False, False], [False, False])  # each has had its one cycle


def test_phrase_arithmetic_passes_64_bits(spark, monkeypatch):
    big = 9 * 10**14
    counts = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1)], "lang string, len int, phrase string, n long")
    monkeypatch.setattr(phrases, "frequent", lambda *a, **k: (counts, spark.createDataFrame([("en", 2 * big)], "lang string, n long")))
    assert rows_of(phrases.collocations(None)) == [("en", 1, "a b", big - 1, big, big, 2 * big, 2000000 * (big - 1) // (2 * big))]


def test_phrases_of_empty_tables(docs):
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(docs.where("text is null or doc_id = 302"), least=1).count() == 0


# --- ranked search ------------------------------------------------------------------------------

ITEMS = [(1, "The red fox"), (2, "of the of the ünder"), (3, None), (4, ""), (5, "nothing known"), (6, "blue Blue, BLUE!"), (6, "green"), (1, "The red fox"),
         (None, "fox nbsp"), (7, "joined \U0001f600 x"), (8, "the red fox of green"), (9, " ".join(v for v in VOCAB))]


def terms_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def search_by_hand(rows, items, k):
    docs = [(d, Counter(terms_by_hand(t))) for d, t, *_ in rows]
    n_docs, length = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in {x for x in items if x[1] is not None}:
        got = []
        for d, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(terms_by_hand(text)) if t in c)
            if s > 0:
                got.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(got)[:k], 1)]
    return out


@pytest.mark.parametrize("k,block", [(10, 4_000_000), (3, 20), (200, 4_000_000)])
def test_ranked_search_equals_brute_force(spark, docs, k, block, monkeypatch):
    monkeypatch.setattr(search, "TREE_DOCS", 64)  # several trees in a task
    monkeypatch.setattr(search, "LEAF_DOCS", 4)
    monkeypatch.setattr(search, "FAN", 4)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(c) for c in EXTRA})
    got = rows_of(search.ranked(docs, items, k, block_chars=block).select("item_id", "rank", "doc_id", "score"))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(search_by_hand(ROWS, ITEMS, k), key=key)


def _collection(n, seed=1):
    """Documents of a few themes as a tree (strongest terms side by side), and item term lists."""
    r = np.random.default_rng(seed)
    theme = np.sort(r.integers(0, 40, n))
    term = np.concatenate([theme * 10 + r.integers(0, 10, n), theme * 10 + r.integers(0, 10, n), 400 + r.integers(0, 50, n)])
    doc, most = np.tile(np.arange(n), 3), np.concatenate([r.integers(500, 900, 2 * n), r.integers(1, 60, n)]) * 1_000_000
    pair, first = np.unique(doc * 1000 + term, return_index=True)
    tree = search.Tree(pa.array(np.arange(n)), pair // 1000, pair % 1000, most[first])
    items = [np.unique(np.append(r.integers(0, 10, 3) + 10 * r.integers(0, 40), 400 + r.integers(0, 50, 2))) for _ in range(60)]
    return tree, items


def test_pairs_of_nodes_are_pruned_and_nothing_is_lost():
    tree, terms = _collection(20_000)
    items = search.Items(terms, np.ones(1000, np.int64))
    first = search.Best(np.zeros(len(terms), np.int64), 10)
    search.seeds(tree, items, first)
    best = search.Best(first.least, 10)
    scored = search.search(tree, items, best)
    everything = np.arange(tree.leaves)
    for i, t in enumerate(terms):
        doc, score = tree.scores(tree.local(t), everything)
        order = np.lexsort((doc, -score))[:10]
        assert best.rows[i] == list(zip(score[order].tolist(), doc[order].tolist()))
    assert scored < sum(len(tree.scores(tree.local(t), everything)[0]) for t in terms) / 3


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.ranked(docs.where("false"), items).count() == 0
    got = search.ranked(docs, items.where("false"))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
    assert search.ranked(docs.where("text is null"), items).count() == 0


# --- packing ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def checked(pieces, texts, plain, length=packing.LENGTH):
    """All pieces together are the texts' ids, and the sequences need no padding."""
    by = defaultdict(list)
    for key, start, n, crc, tokens, seq, offset in pieces:
        by[seq].append((offset, n))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == length or at <= length and at & (at - 1) == 0
    left = Counter((key, start, n, crc, tokens) for key, start, n, crc, tokens, _, _ in pieces)
    got = defaultdict(list)
    for key, start, n, crc, tokens, _, _ in pieces:
        got[key].append((start, n, crc, tokens))
    for key, text in texts:
        ids = np.append(np.array(plain.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(packing.END)).astype("<u4")
        at = 0
        while at < len(ids):  # each place once, repeated rows included
            hits = [p for p in got[key] if p[0] == at and p[3] == len(ids) and zlib.crc32(ids[at:at + p[1]].tobytes()) == p[2]]
            assert hits, (key, at)
            got[key].remove(hits[0])
            at += hits[0][1]
        assert at == len(ids)
    assert not any(got.values()) and left


def test_packing_holds_every_id_once(docs, plain):
    small = docs.where("doc_id is null or doc_id not in (200)")  # of equal rows that are cut at other places pieces can't be told apart
    texts = [(d, t) for d, t, *_ in ROWS if d != 200]
    checked(rows_of(packing.packed(small)), texts, plain)


@pytest.mark.parametrize("length", [16, 128])
def test_packing_of_short_sequences(docs, plain, length):
    some = docs.where("doc_id < 100 or doc_id = 303")
    checked(rows_of(packing.packed(some, length=length)), [(d, t) for d, t, *_ in ROWS if d is not None and (d < 100 or d == 303)], plain, length)


def test_encoder_equals_the_file_s_library(plain):
    encode = packing.encoder()
    texts = [t or "" for _, t, *_ in ROWS] + ["a" * 700_000, "word " * 120_000, "x <|endoftext|> y" * 30_000, "  \n\n tab\t" * 60_000, "it's 1234567 ½ ǅ ͅ"]
    for t in texts:
        assert encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_costs_are_balanced_and_whole_documents_stay_whole():
    r = np.random.default_rng(3)
    sizes = r.integers(5, 400, 5000)
    pieces = packing.balanced(sizes)
    room = packing.capacities(sizes.sum())
    load, used = np.zeros(len(room)), np.zeros(len(room), np.int64)
    for _, _, n, at, offset in pieces:
        assert offset == used[at]
        load[at] += packing.cost(n)
        used[at] += n
    assert (used == room).all()
    assert len(pieces) <= len(sizes) + len(room)  # about a cut a sequence, which fills it
    load = load[room == packing.LENGTH]
    assert load.std() < 0.05 * load.mean()


def test_capacities_need_no_padding():
    for total in (0, 1, 2047, 2048, 2049, 123_457):
        c = packing.capacities(total)
        assert c.sum() == total and all(x & (x - 1) == 0 and x <= 2048 for x in c.tolist())


def test_packing_of_an_empty_table(docs):
    assert packing.packed(docs.where("false")).count() == 0
