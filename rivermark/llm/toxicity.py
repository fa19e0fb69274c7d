"""Toxicity by a counterfactually regularised classifier.

The score is a logistic model over counts of words and word beginnings, ``log(1 + count)``
each, and the log of the number of words. In labelled texts that mention a group, the
group's term is swapped for another term of the same kind, and the training loss adds
the squared change of the score that the swap causes. A term that merely goes along with
toxic examples then gets no weight of its own, and neutral mentions stay neutral.

Training uses a bounded sample: the ``SAMPLE`` labelled documents with the smallest hash
of their id. Spark counts in how many of them each feature occurs, by label; the
``FEATURES`` most telling ones are kept, the sample's counts of these few features come to
the driver (at most SAMPLE rows) and Newton steps fit the weights. Every document is then
scored over its whole text. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts get the score of a text without words; null labels
and documents without a label are not learned from; without both labels in the sample all
scores are 0.5; repeated rows get equal scores; a null id is not held out; an empty table
gives no rows. Only ``doc_id`` and ``text`` of the documents and ``doc_id`` and ``toxic`` of
the labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.llm.common import staged, table, text_of
from rivermark.registry import query

#: Labelled documents that are learned from, at most, and features that are kept.
SAMPLE, FEATURES = 20_000, 400
#: Lengths of word beginnings that are features besides whole words.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Weight of the squared weights, and of the squared score changes under swaps.
RIDGE, SWAP = 0.5, 20.0
LETTERS = r"[^\p{L}]+"
#: Bytes of text that are taken apart at one time.
CHUNK = 4_000_000

# Terms for groups of people; a swap stays within one line.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frau", "mann"), ("frauen", "männer"), ("femme", "homme"), ("femmes", "hommes"), ("mujer", "hombre"), ("mujeres", "hombres"),
)


@dataclass(frozen=True)
class Model:
    """Weights by feature (a beginning, or a whole word with ``$`` behind it)."""

    weights: dict[str, float]
    bias: float = 0.0
    length: float = 0.0


def _features(word: Column) -> Column:
    """The features of one word as an array."""
    begins = [F.when(F.length(word) >= n, F.substring(word, 1, n)) for n in PREFIXES]
    return F.array_compact(F.array(F.concat(word, F.lit("$")), *begins))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), LETTERS, -1), "")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """words and toxic of the labelled documents that are learned from."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # At most ``size`` pairs of numbers are sent along.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("text", text_of())
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return staged(once.select(_words(F.col("text")).alias("words"), "toxic"))


def telling(sample: DataFrame, n: int = FEATURES) -> list[str]:
    """The features whose presence differs most between toxic and other texts."""
    each = sample.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct("words"), _features)))).alias("feature"))
    seen = each.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter("a + b >= 4")
    total = sample.agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).first()
    if not total["n1"] or not total["n0"]:
        return []
    p1, p0 = (F.col("a") + 0.5) / (total["n1"] + 1.0), (F.col("b") + 0.5) / (total["n0"] + 1.0)
    z = F.abs(F.log(p1 / p0)) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    return [r["feature"] for r in seen.orderBy(z.desc(), "feature").limit(n).collect()]


def _swapped(words: list[str], groups, at: int) -> list[str] | None:
    """The words with every group term replaced by another of its group; None without any."""
    place = {t: (g, k) for g in groups for k, t in enumerate(g)}
    if not any(w in place for w in words):
        return None
    out = []
    for w in words:
        if w in place:
            group, k = place[w]
            w = group[(k + 1 + at % (len(group) - 1)) % len(group)]
        out.append(w)
    return out


def _vector(words: list[str], index: dict[str, int]) -> np.ndarray:
    x = np.zeros(len(index) + 2)
    for w in words:
        for f in (f"{w}$", *(w[:n] for n in PREFIXES if len(w) >= n)):
            if f in index:
                x[index[f]] += 1
    x = np.log1p(x)
    x[-2:] = 1, np.log1p(len(words))
    return x


def train(
    docs: DataFrame, labels: DataFrame, size: int = SAMPLE, n: int = FEATURES, groups=IDENTITY, swap: float = SWAP
) -> Model:
    sample = sample_of(docs, labels, size)
    chosen = telling(sample, n)
    if not chosen:
        return Model({})
    index = {f: j for j, f in enumerate(chosen)}

    # Only the counts of the chosen features leave the executors.
    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, diffs = [], []
            for words in batch.column("words").to_pylist():
                x, other = _vector(words, index), _swapped(words, groups, len(words))
                xs.append(x.astype("<f4").tobytes())
                diffs.append(None if other is None else (_vector(other, index) - x).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(xs, pa.binary()), pa.array(diffs, pa.binary()), batch.column("toxic")], ["x", "diff", "toxic"]
            )

    rows = sample.select("words", "toxic").mapInArrow(compact, "x binary, diff binary, toxic int").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), "<f4").reshape(-1, len(index) + 2)
    y = rows["toxic"].to_numpy().astype(np.float64)
    diffs = [d for d in rows["diff"].to_pylist() if d is not None]
    change = np.frombuffer(b"".join(diffs), "<f4").reshape(-1, len(index) + 2)
    w = _newton(x, y, change, swap)
    return Model({f: float(w[j]) for f, j in index.items()}, float(w[-2]), float(w[-1]))


def _newton(x: np.ndarray, y: np.ndarray, change: np.ndarray, swap: float, steps: int = 25) -> np.ndarray:
    """Weights of the penalised logistic loss."""
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-2] = 1e-3  # the constant is free
    fixed = np.diag(ridge) + swap * (change.T.astype(np.float64) @ change)
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        s = x @ v
        return float(np.logaddexp(0, s).sum() - (y * s).sum() + 0.5 * v @ fixed @ v)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (p - y) + fixed @ w
        curve = fixed.copy()
        for at in range(0, len(x), 4096):  # the weighed copy of the rows stays small
            part = x[at : at + 4096]
            curve += part.T @ (part * (p * (1 - p))[at : at + 4096, None])
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-6 * max(1.0, abs(now)):
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, from its whole text."""
    weights = np.array([*model.weights.values(), 0.0])
    index = {f: j for j, f in enumerate(model.weights)}

    def hits(word: str) -> list[int]:
        found = [index[f] for f in (f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)) if f in index]
        return found

    def sums(texts: pa.Array) -> np.ndarray:
        marked = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " ")
        lists = pc.ascii_split_whitespace(marked)
        flat = lists.flatten()
        flat = flat.dictionary_encode() if len(flat) else pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), pa.array([], pa.string()))
        words = flat.dictionary.to_pylist()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        at = flat.indices.to_numpy(zero_copy_only=False)
        empty = np.array([not w for w in words] + [True])[at] if len(at) else np.empty(0, bool)
        per = np.add.reduceat(np.append(~empty, False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) if len(texts) else np.empty(0)
        # (document, feature) of every hit, counted once per pair.
        known = [hits(w) for w in words]
        some = np.array([bool(k) for k in known] + [False])[at] if len(at) else np.empty(0, bool)
        where = np.flatnonzero(some)
        rows = np.searchsorted(offsets, where, side="right") - 1
        pairs = [(r, j) for r, i in zip(rows.tolist(), at[where].tolist()) for j in known[i]]
        total = model.bias + model.length * np.log1p(per.astype(np.float64))
        if pairs:
            keys, counts = np.unique(np.array(pairs, np.int64), axis=0, return_counts=True)
            np.add.at(total, keys[:, 0], weights[keys[:, 1]] * np.log1p(counts))
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.append(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), 0)
            begin, held = 0, 0
            for i in range(batch.num_rows + 1):
                if i > begin and (i == batch.num_rows or held + sizes[i] > CHUNK):
                    part = batch.slice(begin, i - begin)
                    total = np.clip(sums(part.column("text")), -35, 35)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-total)))], ["doc_id", "score"])
                    begin, held = i, 0
                held += sizes[i]

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return score(docs, train(docs, labels, **options)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
