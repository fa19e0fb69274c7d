import math
import random
import re

import numpy as np
import pytest

from rivermark.llm import lexical_search
from rivermark.llm.common import blocks, terms_of
from rivermark.llm.lexical_search import Trie, ranked, scores
from tests.llm.conftest import ODD

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def by_hand(docs, items, top=50):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    out = []
    for item_id, text in items:
        weights = {}
        for t in set(terms(text)):
            df = sum(t in w for _, w in held)
            weights[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        found = []
        for i, words in held:
            m = 50 + (50 * len(words) * n) // total
            score = sum(w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m)) for t, w in weights.items() if (tf := words.count(t)))
            if score > 0:
                found.append((-score, i is None, i, score))
        found.sort(key=lambda x: x[:2] + (x[2] or 0,))
        out += [(item_id, k + 1, i, score) for k, (_, _, i, score) in enumerate(found[:top])]
    return sorted(map(str, out))


def got(docs, items, **more):
    return sorted(str((r.item_id, r.rank, r.doc_id, r.score)) for r in ranked(docs, items, **more).collect())


@pytest.fixture(scope="module")
def items_of(spark):
    return lambda pairs: spark.createDataFrame([(i, t, "x", 1) for i, t in pairs], "item_id long, text string, doc_id string, rank int")


def random_docs(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["ÉCOLE", "école", "东京", "a1"]
    odds = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(r.choices(vocabulary, odds, k=r.randint(1, 60)))) for k in range(n)]
    return docs + [(n + k, docs[k % 7][1]) for k in range(200)], r, vocabulary


def test_ranks_as_by_hand(spark, rows_of, items_of, monkeypatch):
    docs, r, vocabulary = random_docs(1, 700)
    docs += ODD + [(5000, "W1-w2_w3 w1"), (5001, "only here zyx")]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(1, 25)))) for k in range(25)]
    items += [(90, None), (91, ""), (92, "unknown words"), (93, "one"), (93, "one"), (None, "W0 w0 É"), (94, "w0 " * 500), (95, "zyx école ÉCOLE 东京")]
    want = by_hand(docs, items)
    assert got(rows_of(docs).repartition(5), items_of(items)) == want
    monkeypatch.setattr(lexical_search, "CELLS", 9000)  # many tries a task
    assert got(rows_of(docs).repartition(3), items_of(items), block=300) == want  # and many blocks


def test_empty_tables(rows_of, items_of):
    assert ranked(rows_of([]), items_of([(1, "a")])).count() == 0
    assert ranked(rows_of([(1, "a")]), items_of([])).count() == 0
    assert ranked(rows_of([(1, None), (2, " ")]), items_of([(1, "a")])).count() == 0


def test_trie_bounds_every_document_and_skips_many():
    rng = np.random.default_rng(5)
    n, width = 3000, 400
    tf = (rng.random((n, width)) < 0.8 / (1 + np.arange(width)) ** 0.8).astype(np.uint32) * rng.integers(1, 5, (n, width)).astype(np.uint32)
    tf[100:160] = tf[100]  # copies
    m = rng.integers(50, 150, n)
    paths = [np.flatnonzero(row).astype(">u4").tobytes() for row in tf]
    trie = Trie(tf, m, np.arange(n), paths)
    weights = np.array([lexical_search.weight(n, k) for k in (tf > 0).sum(0).tolist()])
    for node, (low, high) in enumerate(trie.runs):
        assert (trie.most[node] == trie.tf[low:high].max(0)).all() and trie.least[node] == trie.m[low:high].min()
    seen = 0
    for seed in range(20):
        terms = np.sort(np.random.default_rng(seed).choice(width, 12, replace=False))
        best = []
        seen += trie.search(terms, weights[terms], best, 10)
        plain = scores(tf[:, terms], m, weights[terms])
        want = sorted(((int(s), -i) for i, s in enumerate(plain) if s), reverse=True)[:10]
        assert sorted(best, reverse=True) == want
    assert seen < 0.7 * 20 * n  # terms independent of each other are the hardest case


def test_terms_and_blocks(spark):
    for text in ["", "A-b C1éß, \x00x\x7fy_Z", "日本 語　x", "İIK"]:
        assert [t.decode() for t in terms_of(text.encode())] == terms(text)
    df = spark.createDataFrame([(k, s) for k, s in enumerate([3, 3, 9, 1, 1, 1, 50, 2])], "k int, s int").coalesce(1)
    assert [[r.s for r in b] for b in blocks(df, "s", 6)] == [[3, 3], [9], [1, 1, 1], [50], [2]]
