"""Ranked lexical search: documents in a trie of their terms, searched by bound.

Queries are taken in blocks of bounded text. For a block, one pass turns every document
into its restricted term vector: the terms that the block's items use, with their counts,
beside the length of the document. The pass also counts documents, terms and how many
documents hold each term.

In a second pass each task orders the terms of its documents from the most frequent to
the rarest and sorts the documents by that, so that documents with a common start are
neighbours and a trie path is a run of rows. A node keeps, for every term, the largest
count below it, and the smallest length norm ``m``. As a score grows with the count and
falls with ``m``, these give an upper bound for every document below the node. For each
item the trie is walked depth first, the better child first, and a node is left alone once
its bound cannot reach the item's fiftieth document so far. The survivors of all tasks
meet per item, first in groups of a hash of the document.

A trie spans at most ``CELLS`` counts, so memory does not grow with the input; the fifty best
of each item stay from one trie to the next. All steps are whole numbers but the weights.

Defined results: null and empty texts have no terms and count nowhere; items without a
known term give no rows; documents that repeat count and rank once each; equal scores go
by ascending id, null ids last; items that repeat are ranked once each; empty tables give no
rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rivermark.llm.common import Copies, blocks, table, terms_of, text_of
from rivermark.registry import query

TOP = 50
#: Bytes of query text in one block; a longer item is a block of its own.
BLOCK = 200_000
#: Term counts in one trie (documents times terms of the block) and documents in a leaf.
CELLS, LEAF = 12_000_000, 16
#: Groups in which the tasks' results of one item first meet.
GROUPS = 64

VECTORS = "doc_id long, n long, terms binary, tfs binary, at array<int>, held array<long>"


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Restricted term vectors, and one row of counts per task: documents of each term, of any, all terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held = np.zeros(len(known) + 2, np.int64)
        for batch in batches:
            ids, lengths, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                counts = Counter(map(known.get, words))
                counts.pop(None, None)
                own = np.fromiter(counts.keys(), np.uint32, len(counts))
                held[own] += 1
                held[-2] += 1
                held[-1] += len(words)
                ids.append(doc_id)
                lengths.append(len(words))
                terms.append(own.tobytes())
                tfs.append(np.fromiter(counts.values(), np.uint32, len(counts)).tobytes())
            n = len(ids)
            yield _rows(pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()),
                        pa.array(tfs, pa.binary()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())))
        at = np.flatnonzero(held)
        yield _rows(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                    pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([held[at].tolist()], pa.list_(pa.int64())))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, VECTORS)


def _rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n", "terms", "tfs", "at", "held"])


class Trie:
    """Documents sorted by their ordered terms, with bounds for every node.

    ``tf`` is (documents, terms) in trie order; leaves are runs of documents, other nodes
    have children. Adjacent small branches share a leaf.
    """

    def __init__(self, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, paths: list[bytes]):
        order = sorted(range(len(paths)), key=paths.__getitem__)
        self.paths = [paths[i] for i in order]
        self.tf, self.m, self.ids = tf[order], m[order], ids[order]
        self.runs, self.children = [(0, len(order))], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            for run in self._split(*self.runs[node]):
                self.children[node].append(len(self.runs))
                todo.append(len(self.runs))
                self.runs.append(run)
                self.children.append([])
        leaves = sorted((run[0], i) for i, run in enumerate(self.runs) if not self.children[i])
        starts, at = [s for s, _ in leaves], [i for _, i in leaves]
        self.most = np.zeros((len(self.runs), tf.shape[1]), tf.dtype)
        self.least, self.first = np.zeros(len(self.runs), np.int64), np.zeros(len(self.runs), ids.dtype)
        self.most[at] = np.maximum.reduceat(self.tf, starts, axis=0)
        self.least[at], self.first[at] = np.minimum.reduceat(self.m, starts), np.minimum.reduceat(self.ids, starts)
        for node in range(len(self.runs) - 1, -1, -1):
            if below := self.children[node]:
                self.most[node] = self.most[below].max(0)
                self.least[node], self.first[node] = self.least[below].min(), self.first[below].min()

    def _split(self, low: int, high: int) -> list[tuple[int, int]]:
        """The branches below the path that all these documents share; none for a leaf."""
        a, b = self.paths[low], self.paths[high - 1]
        if high - low <= LEAF or a == b:
            return []
        shared = next((i for i in range(0, min(len(a), len(b)), 4) if a[i : i + 4] != b[i : i + 4]), min(len(a), len(b)))
        heads = [p[shared : shared + 4] for p in self.paths[low:high]]
        cuts = [low, *[low + i for i in range(1, high - low) if heads[i] != heads[i - 1]], high]
        runs = [(cuts[0], cuts[1])]
        for begin, end in zip(cuts[1:], cuts[2:]):
            if end - runs[-1][0] <= LEAF:
                runs[-1] = (runs[-1][0], end)
            else:
                runs.append((begin, end))
        return runs

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list, top: int) -> int:
        """Improve ``best``, a heap of (score, minus id), and count the documents scored."""
        bound = scores(self.most[:, terms], self.least, weights)
        stack, scored = [0], 0
        while stack:
            node = stack.pop()
            if not bound[node] or len(best) == top and (bound[node], -self.first[node]) <= best[0]:
                continue
            if below := self.children[node]:
                stack += sorted(below, key=bound.__getitem__)
                continue
            low, high = self.runs[node]
            scored += high - low
            found = scores(self.tf[low:high, terms], self.m[low:high], weights)
            floor = best[0][0] if len(best) == top else 1
            for i in np.flatnonzero(found >= floor):
                entry = (int(found[i]), -int(self.ids[low + i]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def scores(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[:, None]))).sum(1)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


#: Stands for a null id, after all others.
LAST = np.iinfo(np.int64).max


def _search(vectors: DataFrame, plan: dict, id_type, top: int) -> DataFrame:
    """The best documents of each item within each task."""
    shared = vectors.sparkSession.sparkContext.broadcast(plan)
    arrow_id = to_arrow_type(id_type)

    def tries(batches, plan) -> Iterator[Trie]:
        rank, width = plan["rank"], len(plan["weights"])
        size = max(1, CELLS // max(width, 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                terms, tfs = (b"".join(part.column(c).to_pylist()) for c in ("terms", "tfs"))
                lengths = np.array([len(x) // 4 for x in part.column("terms").to_pylist()])
                ranks = rank[np.frombuffer(terms, np.uint32)]
                row = np.repeat(np.arange(len(lengths)), lengths)
                kept = ranks >= 0
                row, ranks, counts = row[kept], ranks[kept], np.frombuffer(tfs, np.uint32)[kept]
                tf = np.zeros((len(lengths), width), np.uint32)
                tf[row, ranks] = counts
                order = np.argsort(row * width + ranks, kind="stable")
                raw = ranks[order].astype(">u4").tobytes()
                ends = np.cumsum(np.bincount(row, minlength=len(lengths))) * 4
                paths = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                m = np.array([50 + 50 * n * plan["documents"] // plan["total"] for n in part.column("n").to_pylist()], np.int64)
                ids = np.array([LAST if i is None else i for i in part.column("doc_id").to_pylist()], np.int64)
                yield Trie(tf, m, ids, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        best = [[] for _ in plan["items"]]
        for trie in tries(batches, plan):
            for heap, terms in zip(best, plan["items"]):
                if len(terms):
                    trie.search(terms, plan["weights"][terms], heap, top)
        for k, heap in enumerate(best):
            if heap:
                docs = [None if -i == LAST else -i for _, i in heap]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(heap), pa.int32()), pa.array([plan["ids"][k]] * len(heap), arrow_id),
                     pa.array(docs, pa.int64()), pa.array([s for s, _ in heap], pa.int64())],
                    ["item", "item_id", "doc_id", "score"])

    return vectors.mapInArrow(run, f"item int, item_id {id_type.simpleString()}, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``top`` best documents of each item."""
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType
    copies, found = Copies(spark), []
    sized = items.select("item_id", text_of().alias("text"), F.octet_length(text_of()).alias("size"))
    for rows in blocks(sized, "size", block):
        texts = [set(terms_of(r.text.encode())) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*texts)))}
        vectors = copies.write("vectors", _vectors(docs, vocabulary))
        each = vectors.filter("at IS NOT NULL").select(F.explode(F.arrays_zip("at", "held")).alias("c"))
        held = dict(each.groupBy("c.at").agg(F.sum("c.held")).collect())
        documents, total = held.pop(len(vocabulary), 0), held.pop(len(vocabulary) + 1, 0)
        # From the most frequent term to the rarest; terms that no document has, or of weight 0, have no rank.
        known = sorted((t for t, n in held.items() if weight(documents, n)), key=lambda t: (-held[t], t))
        rank = np.full(len(vocabulary) + 1, -1, np.int64)
        rank[known] = np.arange(len(known))
        terms = [np.array(sorted(r for r in (rank[vocabulary[t]] for t in text) if r >= 0), np.int64) for text in texts]
        plan = {
            "rank": rank, "weights": np.array([weight(documents, held[t]) for t in known], np.int64), "items": terms,
            "ids": [r.item_id for r in rows], "documents": documents, "total": total,
        }
        best = _search(vectors.filter("octet_length(terms) > 0").select("doc_id", "n", "terms", "tfs"), plan, id_type, top)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        group = F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))
        first = Window.partitionBy("item", group).orderBy(*order)
        last = Window.partitionBy("item").orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
        best = best.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
        found.append(copies.write("ranks", best.select("item_id", "rank", "doc_id", "score")))
        copies.drop("vectors")
    if not found:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = rf"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all({LOWERED}, '{TERM}') AS terms FROM documents),
stat AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM doc WHERE len(terms) > 0),
tf AS MATERIALIZED (
  SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM doc) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stat),
item AS (
  SELECT DISTINCT item, item_id, term FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all({LOWERED}, '{TERM}')) AS term FROM benchmark)),
scored AS (
  SELECT item, item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // total)))))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term), stat GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}"""


@query("op12_lexical_search", SQL)
def op12_lexical_search(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
