import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rivermark.llm import exact_dedup, near_dedup
from rivermark.llm.common import Copies
from tests.llm.conftest import ODD

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def exact_by_hand(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out = []
    for i, t in pairs:
        norm = SPACE.sub(" ", t or "")
        ids = [x for x in groups[norm] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("key", [None, 0, 2])
def test_exact(spark, rows_of, key):
    """Also with hashes of no or two bits, where nearly all texts collide."""
    pairs = ODD + [(20 + k, f"text  {k % 7}\t") for k in range(40)] + [(90, "text 3 "), (91, "text 3")]
    own = exact_dedup.content_key if key is None else lambda c: F.substring(F.conv(F.substring(F.md5(c), 1, 1), 16, 2), 1, key)
    got = exact_dedup.decisions(rows_of(pairs), own).collect()
    assert sorted(map(tuple, got), key=str) == exact_by_hand(pairs)


def test_drop_copies(spark, rows_of):
    docs = rows_of(ODD)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [SPACE.sub(" ", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({SPACE.sub(" ", t or "") for _, t in ODD})
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0
    assert exact_dedup.decisions(docs.limit(0)).count() == 0


def shingles_by_hand(text, size=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in SPACE.split(lower) if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_by_hand(pairs):
    sets = [shingles_by_hand(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if find(j) == find(k) and pairs[j][0] is not None] if sets[k] else [i]
        own = min(ids) if ids and ids != [None] else None
        out.append((i, len(sets[k]), own, i == own))
    return sorted(out, key=str)


def family(r, n, base, changes):
    """Texts that differ from one base, and so from each other, in some words."""
    words = [f"w{r.randrange(10_000)}" for _ in range(base)]
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(r.randint(0, changes)):
            own[r.randrange(base)] = f"x{r.randrange(10_000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("pivots", [near_dedup.PIVOTS, 1])
def test_near(spark, rows_of, pivots):
    """Families around the limit of 0.8, chains, copies; few rounds and many."""
    r = random.Random(5)
    texts = family(r, 25, 120, 6) + family(r, 25, 60, 5) + family(r, 10, 12, 1) + [t.upper() for t in family(r, 3, 40, 0)]
    chain = [f"c{k}" for k in range(200)]
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 120, 6)]
    ids = list(range(100, 100 + len(texts)))
    r.shuffle(ids)
    pairs = ODD + list(zip(ids, texts))
    got = near_dedup.decisions(rows_of(pairs), pivots=pivots).drop("mark").collect()
    assert sorted(map(tuple, got), key=str) == near_by_hand(pairs)


def small_pairs(n):
    """Pairs of texts with 4 to 30 shingles that are similar at the limit of 0.8 or just above."""
    shapes = [(4, 0, 1), (8, 0, 2), (8, 1, 1), (16, 0, 4), (16, 2, 2), (17, 0, 4), (24, 0, 6), (24, 3, 3)]
    out = []
    for k in range(n):
        both, left, right = shapes[k % len(shapes)]
        words = [f"p{k}w{j}" for j in range(left + both + right + 3)]
        out += [" ".join(words[: left + both + 3]), " ".join(words[left:])]
    return out


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 40])
def test_near_small_sets_in_one_bucket(spark, rows_of, block):
    """Pairs that only the rounds after the first can join, as the bucket's smallest node is in one pair only."""
    texts = small_pairs(240)
    docs = rows_of(list(enumerate(texts)))
    copies = Copies(spark)
    signed = copies.write("signed", near_dedup.signatures(docs).withColumn("bands", F.array(F.lit(1).cast("long"))))
    nodes, roots = near_dedup.links_of(docs, signed, copies, block=block)
    placed = nodes.select("node", "doc_id").join(roots, "node", "left")
    root = {r.doc_id: r.root for r in placed.collect()}
    assert [k for k in range(0, len(texts), 2) if root[k] is None or root[k] != root[k + 1]] == []
    assert len(set(root.values())) == len(texts) // 2


def test_sketches_of_small_sets():
    """At the limit no pair's sketches differ in too many places, whatever the size of the sets."""
    import numpy as np

    r = np.random.default_rng(3)
    for both, left, right in [(4, 0, 1), (4, 1, 0), (8, 0, 2), (8, 1, 1), (16, 0, 4), (16, 2, 2), (24, 0, 6), (24, 3, 3)]:
        for _ in range(60):
            every = r.integers(0, 1 << 64, left + both + right, dtype=np.uint64)
            a, b = near_dedup._sketch(every[: left + both]), near_dedup._sketch(every[left:])
            assert int((a != b).sum()) <= near_dedup._unlike(80)


def test_drop_near_copies(spark, rows_of):
    docs = rows_of([(1, "a b c d e f g h i j k l m n o p"), (2, "A b c d e f g h i j k l m n o p"), (3, "q r s t u"), (4, None)])
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert near_dedup.drop_near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links for x in (a, b) if a != b}
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in linked)


def test_long_text_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a b c d e", "", "  x  y z w v ", "é ß"] * 5)
    whole = [s.tolist() for s in near_dedup.shingle_sets(texts, 4)]
    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    assert [s.tolist() for s in near_dedup.shingle_sets(texts, 4)] == whole
    assert [len(s) for s in whole[:4]] == [2, 0, 2, 1]
