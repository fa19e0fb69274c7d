"""Benchmark decontamination by a prefix-filtered set join.

Each item is cut into windows of consecutive words, and each window is a set of shingles
of ``SHINGLE`` words. A document holds a window only if it holds all of its shingles, so
any one of them is a necessary prefix; the rarest is the cheapest. One pass counts the
items' shingles over all documents, which orders them by rarity. A second pass looks
every document position up among the rarest shingles alone. A hit at a known place of a
window fixes where the window would have to begin; the length bound and the position
bound (it must begin and end inside the document) go first, then the words of that
stretch are compared with the windows themselves, one by one.

Items are taken in blocks of bounded text, which is what a task holds besides one batch of
documents. A second block works on what the first one wrote: the documents with the
stretches and items found so far.

Defined results: null and empty texts have no words; items without words have no window;
items with fewer words than a window are one window; documents that repeat are reported
once each; item ids that repeat count once, a null id counts as an item but has no place in
a digest; empty tables give no rows or no hits. Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermark.llm.common import Copies, blocks, table, terms_of, text_of
from rivermark.llm.lexical_search import LOWERED, TERM
from rivermark.registry import query

WINDOW, SHINGLE = 10, 3
#: Bytes of item text in one block; a longer item is a block of its own.
BLOCK = 1_000_000
#: Words of documents that are looked at together.
CHUNK = 2_000_000
#: Multiplier of the word numbers of a stretch; any odd number works.
MIX = np.uint64(0x9E3779B97F4A7C15)

FOUND = "doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"


class Windows:
    """The windows of a block of items with their words as numbers from 1; 0 is any other word."""

    def __init__(self, ids: list[str | None], texts: list[bytes], window: int, shingle: int):
        words = [terms_of(t) for t in texts]
        self.number = {w: i + 1 for i, w in enumerate(sorted(set().union(*words)))}
        self.base = len(self.number) + 1
        owners = defaultdict(set)
        for item, own in zip(ids, words):
            numbers = tuple(self.number[w] for w in own)
            for k in range(max(1, len(own) - window + 1) if own else 0):
                owners[numbers[k : k + window]].add(item)
        self.windows = sorted(owners)
        self.owners = [owners[w] for w in self.windows]
        self.shingle = shingle
        self.counts: dict[tuple, int] = {}

    def shingles(self, window: tuple) -> list[tuple]:
        size = min(self.shingle, len(window))
        return [window[k : k + size] for k in range(len(window) - size + 1)]

    def all_shingles(self) -> list[tuple]:
        return sorted({s for w in self.windows for s in self.shingles(w)})

    def key(self, shingle: tuple) -> int:
        out = 0
        for number in shingle:
            out = out * self.base + number
        return out


def keys_at(numbers: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``size`` words are all known, and the key of these words."""
    n = max(len(numbers) - size + 1, 0)
    known = np.ones(n, bool)
    for k in range(size):
        known &= numbers[k : k + n] > 0
    at = np.flatnonzero(known)
    key = np.zeros(len(at), np.int64)
    for k in range(size):
        key = key * base + numbers[at + k]
    return at, key


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys`` are known, and where."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    hit = np.flatnonzero(sorted_keys[place] == keys)
    return hit, place[hit]


def mixed(stretch: np.ndarray) -> np.ndarray:
    """One 64-bit number for each row of word numbers."""
    out = np.zeros(len(stretch), np.uint64)
    for k in range(stretch.shape[1]):
        out = (out ^ stretch[:, k].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return out


class Finder:
    """Tables to find the windows of a block in word numbers."""

    def __init__(self, windows: Windows, counts: dict[tuple, int]):
        self.number, self.base, self.owners = windows.number, windows.base, windows.owners
        places = defaultdict(set)
        by_length = defaultdict(list)
        for k, window in enumerate(windows.windows):
            each = windows.shingles(window)
            rarest = min(range(len(each)), key=lambda i: (counts.get(each[i], 0), each[i]))
            places[each[rarest]].add((rarest, len(window)))
            by_length[len(window)].append(k)
        self.shortest = min(by_length, default=0)
        self.prefix = {}
        for size in sorted({len(s) for s in places}):
            own = sorted((s for s in places if len(s) == size), key=windows.key)
            pairs = [sorted(places[s]) for s in own]
            ends = np.cumsum([len(p) for p in pairs])
            self.prefix[size] = (np.array([windows.key(s) for s in own], np.int64), ends,
                                 np.array([p for each in pairs for p in each], np.int64).reshape(-1, 2))
        self.lengths = {}
        for length, own in by_length.items():
            words = np.array([windows.windows[k] for k in own], np.int64)
            hashes = mixed(words)
            order = np.argsort(hashes, kind="stable")
            self.lengths[length] = (hashes[order], words[order], np.array(own)[order])

    def occurrences(self, numbers: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Starts, lengths and windows of all occurrences; ``begin`` and ``end`` bound the document of each position."""
        starts, lengths = [], []
        for size, (keys, ends, pairs) in self.prefix.items():
            at, key = keys_at(numbers, size, self.base)
            hit, place = find(keys, key)
            at, count = at[hit], np.diff(ends, prepend=0)[place]
            pair = np.repeat(ends[place] - np.cumsum(count), count) + np.arange(count.sum())
            at = np.repeat(at, count)
            start, length = at - pairs[pair, 0], pairs[pair, 1]
            # Position and length bounds: the window lies inside the document.
            inside = (start >= begin[at]) & (start + length <= end[at])
            starts.append(start[inside])
            lengths.append(length[inside])
        both = np.unique(np.stack([np.concatenate(lengths or [[]]), np.concatenate(starts or [[]])], 1).astype(np.int64), axis=0)
        out = []
        for length, (hashes, words, window) in self.lengths.items():
            start = both[both[:, 0] == length, 1]
            stretch = numbers[start[:, None] + np.arange(length)]
            wanted = mixed(stretch)
            low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
            while (open_ := low < high).any():
                own = np.flatnonzero(open_)
                same = own[(words[low[own]] == stretch[own]).all(1)]
                out.append(np.stack([start[same], np.full(len(same), length), window[low[same]]], 1))
                low = low + 1
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def numbered(texts: list[bytes], number: dict[bytes, int], chunk: int = CHUNK):
    """Word numbers of runs of documents, a 0 after each: (first document, numbers, word counts)."""
    first, held, counts = 0, [], []
    for i, text in enumerate(texts):
        words = terms_of(text)
        counts.append(len(words))
        held.extend(map(number.get, words, repeat(0)))
        held.append(0)
        if len(held) > chunk:
            yield first, np.array(held, np.int64), np.array(counts)
            first, held, counts = i + 1, [], []
    if counts:
        yield first, np.array(held, np.int64), np.array(counts)


def _counts(docs: DataFrame, windows: Windows) -> dict[tuple, int]:
    """Occurrences of each shingle of the block in all documents."""
    shingles = windows.all_shingles()
    tables = {}
    for size in sorted({len(s) for s in shingles}):
        own = sorted((windows.key(s), i) for i, s in enumerate(shingles) if len(s) == size)
        tables[size] = (np.array([k for k, _ in own], np.int64), np.array([i for _, i in own]))
    shared = docs.sparkSession.sparkContext.broadcast((windows.number, windows.base, tables, len(shingles)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, base, tables, total = shared.value
        seen = np.zeros(total, np.int64)
        for batch in batches:
            for _, numbers, _ in numbered(batch.column("text").cast(pa.binary()).to_pylist(), number):
                for size, (keys, index) in tables.items():
                    _, place = find(keys, keys_at(numbers, size, base)[1])
                    seen += np.bincount(index[place], minlength=total)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["shingle", "n"])

    rows = docs.select("text").mapInArrow(run, "shingle int, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return {shingles[r.shingle]: r.n for r in rows}


def _runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edges[::2].tolist(), edges[1::2].tolist()


def _marked(docs: DataFrame, finder: Finder, last: bool) -> DataFrame:
    """Documents with the stretches of words and the items found, added to those found before."""
    shared = docs.sparkSession.sparkContext.broadcast(finder)
    before = "starts" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            old = [batch.column(c).to_pylist() if before else [[]] * len(texts) for c in ("starts", "ends", "items")]
            n_words, starts, ends, items = [], [], [], []
            for first, numbers, counts in numbered(texts, finder.number):
                begin = np.concatenate([[0], np.cumsum(counts + 1)])
                doc = np.repeat(np.arange(len(counts)), counts + 1)
                found = finder.occurrences(numbers, begin[doc], begin[doc] + counts[doc])
                edge = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(edge, found[:, 0], 1)
                np.add.at(edge, found[:, 0] + found[:, 1], -1)
                hit = np.cumsum(edge) > 0
                of = defaultdict(set)
                for d, w in np.unique(np.stack([doc[found[:, 0]], found[:, 2]], 1), axis=0).tolist():
                    of[d] |= finder.owners[w]
                for d, count in enumerate(counts.tolist()):
                    own, before_items = hit[begin[d] : begin[d] + count], old[2][first + d]
                    for a, b in zip(old[0][first + d], old[1][first + d]):
                        own[a:b] = True
                    a, b = _runs(own) if d in of or before_items else ([], [])
                    n_words.append(count)
                    starts.append(a)
                    ends.append(b)
                    items.append(list(of[d] | set(before_items)) if d in of else before_items)
            longs = pa.list_(pa.int64())
            columns = {
                "doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "starts": pa.array(starts, longs),
                "ends": pa.array(ends, longs), "items": pa.array(items, pa.list_(pa.string())),
            }
            if not last:
                columns["text"] = batch.column("text")
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, FOUND if last else f"{FOUND}, text string")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per document: its number of words, the stretches of words found (end exclusive) and the items."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), text_of().alias("text"), F.octet_length(text_of()).alias("size"))
    state, copies, held = read, Copies(docs.sparkSession), None
    for rows in blocks(sized, "size", block):
        if held is not None:
            state = copies.write("marked", _marked(state, held, False))
            copies.drop("marked", keep=1)
        windows = Windows([r.item_id for r in rows], [r.text.encode() for r in rows], window, shingle)
        held = Finder(windows, _counts(read, windows))
    return _marked(state, held or Finder(Windows([], [], window, shingle), {}), True)


def report(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items of each document."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    named = F.array_join(F.array_sort(F.filter("items", lambda i: i.isNotNull())), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


SQL = rf"""
WITH item AS (SELECT item_id, regexp_extract_all({LOWERED}, '{TERM}') AS words FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(words), {WINDOW}) AS size, array_to_string(words[k + 1 : k + least(len(words), {WINDOW})], ' ') AS win
  FROM item, unnest(range(greatest(1, len(words) - {WINDOW} + 1))) u(k) WHERE len(words) > 0),
doc AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all({LOWERED}, '{TERM}') AS words FROM documents),
spot AS (
  SELECT doc, k, size, array_to_string(words[k + 1 : k + size], ' ') AS win
  FROM doc, (SELECT DISTINCT size FROM win), unnest(range(len(words) - size + 1)) u(k)),
found AS MATERIALIZED (SELECT doc, k, size, item_id FROM spot JOIN win USING (size, win)),
hit AS (SELECT doc, count(*) AS n_hit FROM (SELECT DISTINCT doc, unnest(range(k, k + size)) AS at FROM found) GROUP BY doc),
who AS (
  SELECT doc, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc, item_id::VARCHAR AS id FROM found) GROUP BY doc)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc) LEFT JOIN who USING (doc)"""


@query("op13_decontamination", SQL)
def op13_decontamination(spark, sf_dir):
    return report(contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
