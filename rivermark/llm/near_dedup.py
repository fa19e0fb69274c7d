"""Near duplicates by min-max hashing, confirmed on full shingle sets.

A document is the set of its distinct ``shingle``-word shingles (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``; with fewer words the whole sequence is the one shingle). Documents
with a Jaccard similarity of at least ``percent`` / 100 are linked, and linked documents
form components.

Min-max hashing keeps both the smallest and the largest value under each of 64
permutations, which gives 128 signature values for 64 hash evaluations. They are cut
into 32 bands of four; two documents meet if one band agrees. At a similarity of 0.8 a
pair meets nowhere with a probability of 5e-8.

What happens with the documents that meet:

* Equal sets fold to one node first, known by a 128-bit digest of the whole set, so
  exact copies cost nothing further.
* In every bucket each node is compared with one pivot, the bucket's smallest node, so a
  bucket of k nodes gives k - 1 pairs. Pairs are confirmed by intersecting the full sets.
* Buckets whose nodes are now in one component are finished. In the others every node is
  compared with ``PIVOTS`` random pivots of other components, then with ``GROWTH`` times as
  many, until each bucket is one component or all its nodes have been pivots. Pairs
  inside a component need no comparison, and as components grow from round to round
  little is left for the large rounds; but nothing that could join two is left out.
* Nodes and sets of a large bucket are dealt over blocks of bounded size and sent once per
  pair of blocks. Pairs exist as rows only after the sketch let them pass, each pair once.
* Before the second comparison the shingles that only one unfinished node has are counted.
  They can be in no intersection, which bounds the similarity of every pair from above;
  nodes that cannot reach the limit with any other are finished.
* The unfinished nodes also get a sketch: one mixed bit of each minimum and maximum under
  1024 more permutations. Pairs whose sketches differ in more places than ``_unlike`` are
  not compared; a pair at the limit falls to that with a probability of at most 1e-9, in
  sets of any size.

Defined results: null and empty texts and texts of white space only have no shingles,
are linked with nothing and keep themselves. A component's id is its smallest id that is
not null; rows with a null id are kept only if the whole component has none. Rows that
repeat an id and text are one document: they stay or go together. An empty table gives
no rows. Only ``doc_id`` and ``text`` are read; ``drop_near_copies`` returns the input's
columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.llm.common import Copies, table, text_of
from rivermark.registry import query

SHINGLE, PERCENT = 4, 80
PERMUTATIONS, ROWS, SKETCH = 64, 4, 1024
#: Pivots per unfinished bucket after the first, and their growth from round to round.
PIVOTS, GROWTH = 64, 64
#: Nodes of a bucket that are compared in one block; shingles and sets in one block of the confirmation.
BLOCK, SHINGLES, SETS = 2048, 500_000, 512
#: Bytes of text that are hashed at one time.
CHUNK = 4_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(seed: int, n: int) -> np.ndarray:
    """``n`` fixed random odd numbers."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = _numbers(1, 256)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BAND = _numbers(3, 64)
_SLOPES, _SHIFTS = _numbers(4, PERMUTATIONS)[:, None], _numbers(5, PERMUTATIONS)[:, None]
_MORE_SLOPES, _MORE_SHIFTS = _numbers(9, SKETCH)[:, None], _numbers(10, SKETCH)[:, None]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in a byte array, and where each begins."""
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(begins):
        return np.empty(0, np.uint64), begins
    spans = np.diff(np.append(begins, len(data)))
    place = np.arange(begins[0], len(data)) - np.repeat(begins, spans)
    parts = _BYTE[data[begins[0] :]] * _numbers(2, int(spans.max()))[place]
    parts[space[begins[0] :]] = 0
    return _mix(np.add.reduceat(parts, begins - begins[0])), begins


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a document's shingles."""
    if not len(words):
        return words
    if len(words) < size:
        factors = _numbers(7 + len(words), len(words))
        return _mix(np.array([(words * factors).sum()], np.uint64))
    factors, n = _numbers(6, size), len(words) - size + 1
    total = words[:n] * factors[0]
    for k in range(1, size):
        total = total + words[k : k + n] * factors[k]
    return np.unique(_mix(total))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text."""
    lens = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(lens):
        upto, held = at, 0
        while upto < len(lens) and (upto == at or held + lens[upto] <= CHUNK):
            held += int(lens[upto])
            upto += 1
        joined = b" ".join(x.encode() for x in texts.slice(at, upto - at).to_pylist())
        hashes, begins = word_hashes(np.frombuffer(joined, np.uint8)) if joined else (np.empty(0, np.uint64), np.empty(0, int))
        ends = np.cumsum(lens[at:upto].astype(np.int64) + 1)
        cuts = np.searchsorted(begins, ends)
        begin = 0
        for cut in cuts:
            yield _shingles(hashes[begin:cut], size)
            begin = cut
        at = upto


def _signature(elements: np.ndarray, slopes: np.ndarray = _SLOPES, shifts: np.ndarray = _SHIFTS) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of the set under each permutation."""
    low = np.full(len(slopes), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(slopes), np.uint64)
    step = 65_536 // len(slopes)
    for at in range(0, len(elements), step):
        values = elements[at : at + step] * slopes + shifts
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return low, high


def _sketch(elements: np.ndarray) -> np.ndarray:
    """One bit of each minimum and maximum under the further permutations.

    Slopes and shifts are odd, so a value's own lowest bit is that of the element, whatever
    the permutation; mixed it depends on all bits of both.
    """
    return (_mix(np.concatenate(_signature(elements, _MORE_SLOPES, _MORE_SHIFTS))) & np.uint64(1)).astype(np.uint8)


def _digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else b""


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, node (digest of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = PERMUTATIONS // ROWS
        for batch in batches:
            counts, nodes, kept, low, high = [], [], [], [], []
            for elements in shingle_sets(batch.column("text"), size):
                counts.append(len(elements))
                nodes.append(_digest(elements))
                if len(elements):
                    a, b = _signature(elements)
                    low.append(a)
                    high.append(b)
            full = np.array(counts, np.int64) > 0
            keys = np.empty((int(full.sum()), 2 * per), np.uint64)
            if len(keys):
                values = np.concatenate([np.stack(low).reshape(-1, per, ROWS), np.stack(high).reshape(-1, per, ROWS)], axis=1)
                keys = _mix((values * _numbers(8, ROWS)).sum(axis=2, dtype=np.uint64) + _BAND[: 2 * per])
            offsets = np.concatenate([[0], np.cumsum(full * 2 * per)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), bands],
                ["doc_id", "mark", "n_shingles", "node", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, n_shingles long, node binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and shingles of the wanted nodes; ``wanted`` has node, doc_id and mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets, held = [], [], 0
            for elements in shingle_sets(batch.column("text"), size):
                nodes.append(_digest(elements))
                sets.append(elements.view(np.int64))
                held += len(elements)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])
                    nodes, sets, held = [], [], 0
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).withColumn("m", F.xxhash64("text"))
    hit = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark"))
    return rows.join(wanted, hit, "left_semi").select("text").mapInArrow(run, "node binary, shingles array<long>")


def _sketches(sets: DataFrame) -> DataFrame:
    """node and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.packbits(_sketch(e.values.to_numpy().view(np.uint64))).tobytes() for e in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(rows, pa.binary())], ["node", "sketch"])

    return sets.select("node", "shingles").mapInArrow(run, "node binary, sketch binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` of a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if not len(columns[0]):
            continue
        new = np.zeros(len(columns[0]), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for k, (begin, end) in enumerate(zip(cuts, cuts[1:])):
            if k and held:
                yield pa.Table.from_batches(held)
                held = []
            if end > begin:
                held.append(batch.slice(begin, end - begin))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _bytes(column: pa.ChunkedArray, kind) -> np.ndarray:
    """A binary column whose values have equal length, as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _candidates(open_: DataFrame, chosen: Column, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (bucket, deals, a, b) of members and pivots of a bucket that may be similar, each pair once.

    ``open_`` has bucket, band, total, deals, node, root, n, r, lower (its bands below the bucket's own) and
    sketch; ``chosen`` tells the pivots. Members and pivots of a large bucket are dealt over
    blocks, and every block of members meets every block of pivots, so a row travels once
    per block of the other side and pairs exist only where they are compared. A pair that
    shares several buckets is taken in the one with the lowest band: while their roots differ
    that one is unfinished too, or has compared all its nodes.
    """
    blocks = F.ceil(F.col("total") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(5)), blocks.cast("long")).cast("int")
    rows = open_.withColumn("pivot", chosen).withColumn("_own", own)
    every = F.sequence(F.lit(0), blocks - 1)
    sides = F.array(
        F.struct(F.lit(False).alias("met"), every.alias("others")),
        F.struct(F.lit(True).alias("met"), F.when(F.col("pivot"), every).otherwise(F.array().cast("array<int>")).alias("others")),
    )
    facts = ["node", "root", "n", "r", "lower", "sketch", "pivot"]
    sent = rows.withColumn("_side", F.explode(sides)).withColumn("_other", F.explode("_side.others")).select(
        "bucket", "band", "deals", F.when(F.col("_side.met"), F.col("_other")).otherwise(F.col("_own")).alias("mine"),
        F.when(F.col("_side.met"), F.col("_own")).otherwise(F.col("_other")).alias("theirs"), F.col("_side.met").alias("met"), *facts,
    )
    limit, keys = _unlike(percent), ["bucket", "band", "mine", "theirs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            met = group.column("met").to_numpy(zero_copy_only=False).astype(bool)
            if met.all() or not met.any():
                continue
            node = group.column("node").to_numpy(zero_copy_only=False)
            root = np.unique(group.column("root").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            n, r = (group.column(c).to_numpy() for c in ("n", "r"))
            sketch, pivot = _bytes(group.column("sketch"), np.uint64), group.column("pivot").to_numpy(zero_copy_only=False).astype(bool)
            lower = _bytes(group.column("lower"), np.uint8).view(np.int64) if len(group.column("lower")[0].as_py()) else np.zeros((len(n), 0), np.int64)
            left, right = np.flatnonzero(~met), np.flatnonzero(met)
            step = max(1, 2_000_000 // (len(right) * sketch.shape[1]))
            for at in range(0, len(left), step):
                mine = left[at : at + step]
                most = np.minimum(r[mine][:, None], r[right][None])
                ok = (root[mine][:, None] != root[right][None]) & (100 * most >= percent * (n[mine][:, None] + n[right][None] - most))
                i, j = np.nonzero(ok)
                i, j = mine[i], right[j]
                for cut in range(0, len(i), 100_000):
                    a, b = i[cut : cut + 100_000], j[cut : cut + 100_000]
                    near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64) <= limit
                    a, b = a[near], b[near]
                    # Two pivots meet twice, and pairs that share a lower band met there.
                    once = ~(lower[a] == lower[b]).any(1) & (~pivot[a] | np.array([node[x] < node[y] for x, y in zip(a, b)], bool))
                    a, b = a[once], b[once]
                    if len(a):
                        x = [min(node[p], node[q]) for p, q in zip(a, b)]
                        y = [max(node[p], node[q]) for p, q in zip(a, b)]
                        yield pa.RecordBatch.from_arrays(
                            [*[group.column(c).combine_chunks().take(pa.array(a)) for c in ("bucket", "deals")], pa.array(x, pa.binary()), pa.array(y, pa.binary())],
                            ["bucket", "deals", "a", "b"])

    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "bucket long, deals int, a binary, b binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of (bucket, deals, a, b) whose full sets are similar enough.

    The sets of a bucket are dealt over ``deals`` blocks and travel once for every pair of
    blocks that has a pair of documents, not once for every pair.
    """

    def dealt(node: str) -> Column:
        return F.pmod(F.xxhash64(node, F.lit(6)), F.col("deals").cast("long")).cast("int")

    placed = pairs.select("bucket", dealt("a").alias("i"), dealt("b").alias("j"), "a", "b")
    keys = ["bucket", "i", "j"]
    side = lambda end: placed.select(*keys, F.col(end).alias("node")).distinct()
    wanted = side("a").union(side("b")).distinct()
    none = F.lit(None)
    first = wanted.join(sets, "node").select(*keys, F.col("node").alias("a"), none.cast("binary").alias("b"), "shingles")
    rows = first.unionByName(placed.select(*keys, "a", "b", none.cast("array<long>").alias("shingles")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            held, found = {}, []
            for a, b, shingles in zip(group.column("a").to_pylist(), group.column("b").to_pylist(), group.column("shingles")):
                if b is None:
                    held[a] = shingles.values.to_numpy()
                    continue
                x, y = held[a], held[b]
                common = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["a", "b"])

    # Within a group the sets come before the pairs.
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.col("b").asc_nulls_first()).mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, copies: Copies | None = None) -> DataFrame:
    """node and root (the component's smallest node) for all nodes with a link.

    Alternating large-star and small-star steps: every node is hung below the smallest
    node it knows, first its larger neighbours, then its smaller ones. Rounds grow with
    the logarithm of a component's size, and a hub's neighbours are folded before they
    meet. The result reads the copy ``edges``.
    """
    def known(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    copies = copies or Copies(links.sparkSession)
    edges = copies.write("edges", links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, known(edges)
    while now != before:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        below = copies.write("below", large.filter("a <> b").distinct())
        least = below.groupBy("a").agg(F.min("b").alias("m"))
        met = below.join(least, "a")
        small = met.select("a", F.col("m").alias("b")).union(met.select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = copies.write("edges", small.filter("a <> b").distinct())
        copies.drop("below")
        copies.drop("edges", keep=1)
        before, now = now, known(edges)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _merged(roots: DataFrame, found: DataFrame, copies: Copies) -> DataFrame:
    """``roots`` after more links: only links between different components are followed."""
    at = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))
    between = found.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")
    )
    higher = components(between, copies)
    moved = roots.join(higher.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
        "node", F.coalesce("top", "root").alias("root")
    )
    return moved.unionByName(higher.join(roots.select("node"), "node", "left_anti"))


def _unlike(percent: int) -> int:
    """Places in which the sketches of a pair at the limit differ at most, but for one pair in 1e9.

    A permutation's minima differ with a probability of 1 - J and their bits then with one
    half: q = (1 - J) / 2, and so for its maxima. Both differ with at most q * q, as the two
    ends of the union are different shingles, drawn without replacement. So the number of
    places has no larger exponential moments than the binomial B(2 * SKETCH, q), whatever the
    size of the sets, and Chernoff's bound exp(-n * KL(k / n, q)) holds for it.
    """
    n, q = 2 * SKETCH, (1 - percent / 100) / 2

    def bound(k: int) -> float:
        """Logarithm of the bound on k or more places."""
        return -sum(x * math.log(x / n / y) for x, y in ((k, q), (n - k, 1 - q)) if x)

    k = math.ceil(n * q)
    while k < n and q and bound(k + 1) > math.log(1e-9):
        k += 1
    return k


def links_of(docs: DataFrame, signed: DataFrame, copies: Copies, size: int = SHINGLE, percent: int = PERCENT, pivots: int = PIVOTS, block: int = BLOCK):
    """``nodes`` (one row per different set) and ``roots`` (components over nodes)."""
    nodes = copies.write("nodes",
        signed.filter("n_shingles > 0").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first"), F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        ).select("node", "first.doc_id", "first.mark", "n", "bands")
    )
    # Buckets with several nodes: their smallest node, which is the first pivot, and over how many blocks their sets are dealt.
    entries = nodes.select(F.posexplode("bands").alias("band", "bucket"), "node", "n")
    deals = F.ceil(F.greatest(F.sum("n") / F.lit(SHINGLES), F.count(F.lit(1)) / F.lit(SETS))).cast("int")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"), deals.alias("deals"), F.min(F.struct("node", "n")).alias("p")).filter("total > 1")
    members = copies.write("members", entries.join(shared, "bucket"))
    wanted = nodes.select("node", "doc_id", "mark").join(members.select("node").distinct(), "node", "left_semi")
    sets = copies.write("sets", _sets(docs, wanted, size))

    # Every node against that pivot; sets that differ too much in size cannot be similar.
    star = members.filter((F.col("node") != F.col("p.node")) & (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")))
    pairs = star.groupBy(F.col("p.node").alias("a"), F.col("node").alias("b")).agg(F.min(F.struct("bucket", "deals")).alias("t")).select("t.*", "a", "b")
    pairs, members = copies.write("pairs", pairs), members.drop("p")
    found = copies.write("found", _confirmed(pairs, sets, percent))
    copies.drop("pairs")
    roots, turn = copies.write("roots", components(found, copies)), 0
    copies.drop("edges")
    while True:
        turn += 1
        placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
        several = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("bucket")
        members = copies.write("members", placed.join(several, "bucket", "left_semi"))
        copies.drop("members", keep=1)
        if members.isEmpty():
            for name in ("members", "sets", "found", "facts"):
                copies.drop(name)
            return nodes, roots
        if turn == 1:
            # The shingles that only one unfinished node has are in no intersection.
            own = sets.join(members.select("node").distinct(), "node", "left_semi").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
            alone = own.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).filter("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
            hopeful = members.select("node", "n").distinct().join(alone, "node", "left").withColumn("r", F.col("n") - F.coalesce("alone", F.lit(0)))
            hopeful = hopeful.filter(100 * F.col("r") >= percent * F.col("n")).select("node", "r")
            facts = _sketches(sets.join(hopeful.select("node"), "node", "left_semi")).join(hopeful, "node").join(nodes.select("node", "bands"), "node")
            facts = copies.write("facts", facts)
            members = copies.write("members", members.join(facts.select("node"), "node", "left_semi"))
            copies.drop("members", keep=1)
        # The bands below the bucket's own, as bytes.
        lower = F.to_binary(F.array_join(F.transform(F.slice("bands", F.lit(1), F.col("band")), lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit("hex"))
        open_ = members.join(facts, "node").withColumn("lower", lower).drop("bands")
        chance = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        pairs = copies.write("pairs", _candidates(open_, chance * F.col("total") < pivots, percent, block))
        found = copies.write("found", _confirmed(pairs, sets, percent))
        copies.drop("pairs")
        copies.drop("found", keep=1)
        # Where all nodes were pivots, all pairs have been compared.
        members = members.filter(F.col("total") > pivots).drop("root")
        if not found.isEmpty():
            roots = copies.write("roots", _merged(roots, found, copies))
            copies.drop("roots", keep=1)
            copies.drop("edges")
        pivots *= GROWTH


def decisions(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, pivots: int = PIVOTS) -> DataFrame:
    """One row per input row: doc_id, mark, n_shingles, component_id, kept."""
    copies = Copies(docs.sparkSession)
    signed = copies.write("signed", signatures(docs, size))
    nodes, roots = links_of(docs, signed, copies, size, percent, pivots)
    placed = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(smallest, "root").select("node", "component_id")
    joined = signed.drop("bands").join(named, "node", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    done = copies.write("decisions", joined.select("doc_id", "mark", "n_shingles", own.alias("component_id")))
    for name in ("signed", "nodes", "roots"):
        copies.drop(name)
    return done.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = decisions(docs, size, percent).filter("kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    hit = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_mark"))
    return row.join(kept, hit, "left_semi").select("_row.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op9_minhash_near_dedup", SQL)
def op9_minhash_near_dedup(spark, sf_dir):
    return decisions(table(spark, sf_dir, "documents")).drop("mark")
