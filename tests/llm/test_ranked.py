"""Ranked search against scoring every document, at small and large blocks, and the defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from capsift.llm import ranked

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_rule(docs, items, k=10):
    held = [(doc_id, Counter(words(text))) for doc_id, text in docs if words(text)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for doc_id, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in words(text) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if none else doc_id, -s) for r, (s, none, doc_id) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    rows = ranked.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                         spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    return sorted(map(tuple, rows), key=str)


def corpus(seed, n, vocabulary, longest):
    rng = random.Random(seed)
    vocabulary = [f"w{int(i ** 1.3)}" for i in range(vocabulary)]
    text = lambda size: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=size))
    docs = [(i, text(rng.randint(1, longest))) for i in range(n)]
    return docs, [(i, text(rng.randint(1, 30))) for i in range(12)]


@pytest.mark.parametrize("blocks", [(7, 40), (8192, 1 << 21)])
def test_equals_scoring_every_document(spark, monkeypatch, blocks):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", blocks[0])
    monkeypatch.setattr(ranked, "BLOCK_POSTINGS", blocks[1])
    docs, items = corpus(1, 300, 200, 60)
    assert found(spark, docs, items) == by_rule(docs, items)


def test_odd_rows(spark):
    docs = [(1, "Ünï code-Ünï 12"), (2, None), (3, ""), (4, "--- !"), (None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (6, "A, B; c!"),
            (7, "x " * 200_000 + "rare"), (8, "rare a"), *[(100 + i, "a b") for i in range(40)]]
    items = [(1, "a b c"), (1, "a b c"), (1, "rare"), (2, "ünï ÜNÏ"), (3, "unseen"), (4, None), (5, "!!"), (None, "c c c a"), (6, "a b")]
    assert found(spark, docs, items) == by_rule(docs, items)


def test_ties_of_a_thousand_copies_go_to_the_smallest_ids(spark):
    docs = [(i, "same words here") for i in range(1000, 0, -1)] + [(i, "other text") for i in range(2000, 2400)]
    assert found(spark, docs, [(0, "same here")]) == by_rule(docs, [(0, "same here")])


def test_items_of_many_terms_and_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ranked, "PIECE", 16)
    monkeypatch.setattr(ranked, "TURNED", 64)
    docs, _ = corpus(2, 120, 300, 150)
    items = [(0, " ".join(f"w{i}" for i in range(200))), (1, " ".join(f"w{i} w{i + 1}" for i in range(60)))]
    sent = {f"w{i}".encode(): i for i in range(300)}
    counts = ranked.term_counts(np.frombuffer(docs[0][1].encode(), np.uint8), sent)
    assert counts[0] == len(words(docs[0][1])) and sum(counts[1].values()) == sum(w.encode() in sent for w in words(docs[0][1]))
    block_docs = [(i, t) for i, t in docs]
    assert by_rule(block_docs, items) == rank_locally(block_docs, items)


def rank_locally(docs, items, k=10):
    """The functions of one task, without Spark."""
    terms, plans = {}, []
    for item_id, text in items:
        held = Counter(words(text))
        plans.append((item_id, [terms.setdefault(w.encode(), len(terms)) for w in held], list(held.values())))
    rows = [(doc_id, *ranked.term_counts(np.frombuffer(text.encode(), np.uint8), terms)) for doc_id, text in docs]
    total = sum(n for _, n, _ in rows)
    lengths = np.array([25 + 75 * n * len(rows) // total for _, n, _ in rows], np.int64)
    triples = np.array([(i, t, c) for i, (_, _, counts) in enumerate(rows) for t, c in sorted(counts.items())])
    block = ranked.Block([r[0] for r in rows], lengths, *triples.T)
    df = Counter(triples[:, 1].tolist())
    weight = {t: math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item_id, held, times in plans:
        best = ranked.Best(k)
        ranked.rank(block, [t for t in held if t in weight], [n * weight[t] for t, n in zip(held, times) if t in weight], best)
        out += [(item_id, r + 1, doc_id, -s) for r, (s, _, doc_id) in enumerate(best.rows)]
    return sorted(out, key=str)


def test_masks_group_documents_and_end_early():
    rng = random.Random(4)
    lengths = np.full(5000, 100, np.int64)
    holders = [np.array(sorted(rng.sample(range(5000), n))) for n in (4000, 300, 20)]
    docs = np.concatenate(holders)
    block = ranked.Block(list(range(5000)), lengths, docs, np.repeat([0, 1, 2], [4000, 300, 20]), np.ones(len(docs), np.int64))
    masks, order, ends = block.groups([0, 1, 2])
    assert sorted(map(tuple, masks.tolist())) == sorted({tuple(int(d in set(h.tolist())) for h in holders) for d in set(docs.tolist())})
    assert sorted(order.tolist()) == sorted(set(docs.tolist())) and ends[-1] == len(order)
    best = ranked.Best(10)
    weights = [10, 2000, 9000]
    scored = ranked.rank(block, [0, 1, 2], weights, best)
    impact = 10**9 // (1000 + 800)
    whole = sorted((-sum(w * impact for w, h in zip(weights, holders) if d in set(h.tolist())), False, d) for d in set(docs.tolist()))[:10]
    assert best.rows == whole
    again = ranked.rank(block, [0], [1], best)
    assert scored < 5000 and again == 0  # a bound below the k-th score known ends it before masks are made


def test_items_in_parts(spark):
    docs, items = corpus(3, 80, 50, 30)
    assert found(spark, docs, items, part_bytes=100) == by_rule(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []
    docs = spark.createDataFrame([(1, "a b", 7, "x", "y"), (2, "b", 8, "x", "y")], "doc_id long, text string, n long, terms string, score string")
    items = spark.createDataFrame([("i", "a", 3)], "item_id string, text string, rank int")
    assert [tuple(r) for r in ranked.search(docs, items).collect()] == [("i", 1, 1, by_rule([(1, "a b"), (2, "b")], [("i", "a")])[0][3])]
