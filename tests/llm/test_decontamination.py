import hashlib
import random

import numpy as np
import pytest

from rivermark.llm import decontamination
from rivermark.llm.decontamination import Finder, Windows, contaminated, report
from tests.llm.conftest import ODD
from tests.llm.test_lexical_search import terms


def by_hand(docs, items, size=10):
    windows = set()
    for item_id, text in items:
        words = terms(text)
        for k in range(max(1, len(words) - size + 1) if words else 0):
            windows.add((tuple(words[k : k + size]), item_id))
    out = []
    for doc_id, text in docs:
        words, hit, who = terms(text), set(), set()
        where = {}
        for k, w in enumerate(words):
            where.setdefault(w, []).append(k)
        for window, item_id in windows:
            for k in where.get(window[0], ()):
                if tuple(words[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    who.add(item_id)
        ids = ",".join(sorted(str(i) for i in who if i is not None))
        out.append((doc_id, len(words), len(hit), len(who), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def got(docs, items, **more):
    rows = report(contaminated(docs, items, **more)).collect()
    return sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in rows)


@pytest.fixture(scope="module")
def items_of(spark):
    return lambda pairs: spark.createDataFrame([(i, t, "x", 1) for i, t in pairs], "item_id long, text string, doc_id string, starts int")


def planted():
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(6)] + ["École", "ß", "x1"]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([3, 9, 10, 11, 25, 60])))) for k in range(40)]
    items += [(100, "a b c d e f g h " * 3), (101, "A"), (102, "zz yy"), (103, None), (104, "--"), (105, "w1 " * 30), (None, "w1 " * 12), (105, "x1 ß q"), (106, items[0][1])]
    docs = []
    for k in range(250):
        words = r.choices(vocabulary, k=r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            passage = terms(r.choice(items)[1])
            at, a = r.randint(0, len(words)), r.randint(0, 3)
            words[at:at] = passage[a:]
        docs.append((k, ", ".join(words)))
    return docs + ODD + [(900, "w1 " * 4000), (901, items[3][1]), (902, "ZZ"), (903, "Yy zz YY zz"), (904, items[4][1] * 30)], items


def test_hits_as_by_hand(rows_of, items_of, monkeypatch):
    docs, items = planted()
    want = by_hand(docs, items)
    assert got(rows_of(docs).repartition(5), items_of(items)) == want
    assert got(rows_of(docs).repartition(2), items_of(items).coalesce(1), block=400) == want  # many blocks
    monkeypatch.setattr(decontamination, "CHUNK", 100)
    assert got(rows_of(docs), items_of(items), shingle=2) == want
    assert got(rows_of(docs), items_of(items), window=4) == by_hand(docs, items, 4)


def test_stretches(rows_of, items_of):
    docs = [(1, "x a b c y a b c a b c z"), (2, "a b")]
    rows = {r.doc_id: (r.starts, r.ends, r["items"]) for r in contaminated(rows_of(docs), items_of([(7, "A b, C")])).collect()}
    assert rows == {1: ([1, 5], [4, 11], ["7"]), 2: ([], [], [])}


def test_empty_tables(rows_of, items_of):
    assert contaminated(rows_of([]), items_of([(1, "a")])).count() == 0
    assert got(rows_of([(1, "a b")]), items_of([])) == by_hand([(1, "a b")], [])
    assert got(rows_of([(1, "a b")]), items_of([(1, None)])) == by_hand([(1, "a b")], [])


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontamination, "mixed", lambda stretch: np.zeros(len(stretch), np.uint64))
    windows = Windows(["a", "b"], [b"one two three four", b"one two four three"], 4, 2)
    finder = Finder(windows, {})
    numbers = np.array([windows.number[w] for w in b"one two three four one two four three".split()])
    begin, end = np.zeros(8, int), np.full(8, 8)
    found = sorted((s, sorted(finder.owners[w])) for s, _, w in finder.occurrences(numbers, begin, end).tolist())
    assert found == [(0, ["a"]), (4, ["b"])]


def test_the_rarest_shingle_is_the_prefix():
    windows = Windows(["a"], [b"one two three four"], 4, 2)
    counts = {s: n for s, n in zip(windows.all_shingles(), [5, 5, 5])}
    rare = tuple(windows.number[w] for w in (b"three", b"four"))
    counts[rare] = 1
    keys, _, pairs = Finder(windows, counts).prefix[2]
    assert keys.tolist() == [windows.key(rare)] and pairs.tolist() == [[2, 4]]
