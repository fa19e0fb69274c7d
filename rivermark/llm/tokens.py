"""Token counts of a unigram model by dynamic programming over a shared trie.

A text's tokens are those of its pre-tokens (runs without white space, with the public
word mark in front), each cut into vocabulary pieces so that the sum of the pieces'
scores is largest. The best score of a prefix does not depend on what follows, so the
distinct pre-tokens of a batch go into one trie and the forward scores are computed once
per trie node; the node where a pre-token ends stores its token count. Nodes are visited
in sorted order, which is the trie's depth-first order: only the scores on the path from
the root are in memory, and a prefix shared with the word before is not computed again.

The vocabulary is that of a public tokenizer file; as it has no unigram scores, a piece
of rank r scores ``-log(r + 1)``, the shape of Zipf's law. Another table of scores is a
parameter. A character without a piece counts one token per byte at the lowest score
each (byte fallback). Ties go to the cut with fewer tokens.

Each task counts its own documents: nothing is shuffled, and a task keeps the counts of
at most ``KNOWN`` pre-tokens.

Defined results: null and empty texts have no tokens; repeated rows give repeated
results; a null id is kept; an empty table gives no rows. Only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rivermark.llm.common import table, text_of
from rivermark.registry import query

MARK = "▁"
#: Pre-tokens whose counts a task keeps before it starts afresh.
KNOWN = 1_000_000
CHUNK = 4_000_000


def zipf_scores(path: str) -> dict[str, float]:
    """Scores of the pieces of a sentencepiece file, from their ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    )
    return {piece: -math.log(rank + 1.0) for rank, piece in enumerate(pieces, 1)}


class Counter:
    """Token counts of pre-tokens under one table of scores."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.floor = min(scores.values(), default=-1.0) - 1.0
        self.known: dict[str, int] = {}

    def _learn(self, words: list[str]) -> None:
        scores, longest, floor, known = self.scores, self.longest, self.floor, self.known
        best, tokens, last = [0.0], [0], ""
        for word in sorted(words):
            marked = MARK + word
            # Depth of the node shared with the word before.
            depth, most = 0, min(len(marked), len(last))
            while depth < most and marked[depth] == last[depth]:
                depth += 1
            del best[depth + 1 :], tokens[depth + 1 :]
            for end in range(depth + 1, len(marked) + 1):
                size = len(marked[end - 1].encode())
                top, count = best[end - 1] + size * floor, tokens[end - 1] + size
                for begin in range(max(0, end - longest), end):
                    own = scores.get(marked[begin:end])
                    if own is not None:
                        value = best[begin] + own
                        if value > top or (value == top and tokens[begin] + 1 < count):
                            top, count = value, tokens[begin] + 1
                best.append(top)
                tokens.append(count)
            known[word] = tokens[-1]
            last = marked

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and pre-tokens of each text."""
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        sizes = np.zeros(len(texts), np.int64)
        if not len(flat):
            return sizes, sizes.copy()
        flat = flat.dictionary_encode()
        words = flat.dictionary.to_pylist()
        new = [w for w in words if w and w not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known, new = {}, [w for w in words if w]
        self._learn(new)
        each = np.array([self.known[w] if w else 0 for w in words], np.int64)
        at = flat.indices.to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        upto = np.concatenate([[0], np.cumsum(each[at])])
        words_upto = np.concatenate([[0], np.cumsum(each[at] > 0)])
        return np.diff(upto[offsets]), np.diff(words_upto[offsets])


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, scores: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens and n_pre_tokens of every row."""

    def counter() -> Counter:
        if scores is not None:
            return Counter(scores)
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(zipf_scores(path))
        return _COUNTERS[path]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter()
        for batch in batches:
            sizes = np.append(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), 0)
            begin, held = 0, 0
            for i in range(batch.num_rows + 1):
                if i > begin and (i == batch.num_rows or held + sizes[i] > CHUNK):
                    part = batch.slice(begin, i - begin)
                    tokens, words = own.count(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens), pa.array(words)], ["doc_id", "n_tokens", "n_pre_tokens"])
                    begin, held = i, 0
                held += sizes[i]

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pre_tokens long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), default_vocabulary())
