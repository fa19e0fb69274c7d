"""Documents into sequences of fixed length by bounded-space online best-fit.

Every document becomes its token ids and one end id. Documents longer than a sequence
are cut into full pieces, the last piece may be shorter. Pieces are placed as they come:
each goes into the open sequence with the least room that still holds it. Room is kept
as a bitset whose bit ``f`` says that some open sequence has ``f`` free places, so the
search is one shift and the lowest set bit. At most ``open_bins`` sequences are open; when
a new one is needed beyond that, the fullest is closed first.

A placed piece needs no later change, so rows leave the task at once and a task holds
``open_bins`` pairs of numbers whatever it reads. Each input split packs its own
sequences and nothing is shuffled; a split that is run again gives the same rows. The
price is at most the unfilled sequences each split still has open at its end.

Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. A token never
spans two pre-tokens, so each task encodes every different pre-token once and keeps the
ids (at most ``CACHE`` of them). Texts with characters whose normalisation depends on
their neighbours, and texts that could hold a special token, are encoded whole.

Defined results: null and empty texts give one piece with only the end id; rows that
repeat a document are packed once each; a null id stays null; an empty table gives no
rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermark.llm.common import table, text_of
from rivermark.registry import query

LENGTH, END_ID, OPEN_BINS = 4096, 1, 4096
#: Different pre-tokens whose ids a task keeps; beyond that it starts afresh.
CACHE = 800_000
#: Characters of text that are encoded at one time.
CHUNK = 4_000_000
#: Fixed values of the tokenizer file: what it calls one pre-token.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: White space, printable ASCII and precomposed letters whose lower case is one letter.
PLAIN = r"^[\t\n\r\x20-~\x{C0}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17F}]*$"

OUT = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class OpenSequences:
    """The open sequences of one task, by free places."""

    def __init__(self, length: int, limit: int, first: int = 0):
        self.length, self.limit, self.next = length, limit, first
        self.free, self.by_free, self.count = 0, {}, 0

    def _take(self, free: int) -> int:
        same = self.by_free[free]
        sequence = same.pop()
        if not same:
            self.free ^= 1 << free
        self.count -= 1
        return sequence

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset of a piece of ``size`` places."""
        fits = self.free >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.count == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            sequence, free = self.next, self.length
            self.next += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(sequence)
            self.free |= 1 << left
            self.count += 1
        return sequence, self.length - free


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of many texts at once, the same as the tokenizer's own."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer.from_file(path)
        # Pre-tokens arrive normalised, split and in the byte alphabet.
        self.pieces.normalizer, self.pieces.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.letters, self.known = _byte_letters(), {}
        self.pre_tokens = regex.compile(PRE_TOKENS).findall

    def _pieces(self, pieces: list[str], batch: int = 4000) -> None:
        """Learn the ids of pre-tokens."""
        for at in range(0, len(pieces), batch):
            part = pieces[at : at + batch]
            line = " ".join(w.encode().decode("latin-1").translate(self.letters) for w in part)
            got = self.pieces.encode(line, add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            ends = (np.searchsorted(np.array(got.word_ids), np.arange(1, len(part) + 1)) * 4).tolist()
            begin = 0
            for w, end in zip(part, ends):
                self.known[w] = ids[begin:end]
                begin = end

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words without white space; each is one or a few pre-tokens."""
        split = [(w,) if w in self.known else self.pre_tokens(w) for w in words]
        new = list({p for parts in split for p in parts if p not in self.known})
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            split = [self.pre_tokens(w) for w in words]
            new = list({p for parts in split for p in parts})
        self._pieces(new)
        known = self.known
        return [known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts]) for parts in split]

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        flat = lists.flatten().dictionary_encode()
        ids = self._words(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(sizes) - sizes
        every = np.frombuffer(b"".join(ids), "<u4")
        index = flat.indices.to_numpy(zero_copy_only=False)
        lens = sizes[index]
        ends = np.cumsum(lens)
        # Token j of occurrence i stands at begins[word i] + j.
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[index] - (ends - lens), lens)
        cut = np.concatenate([[0], ends])[lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py()]
        return np.split(every[at], cut)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        plain = pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring(texts, "<|")))
        out = iter(self._plain(texts.filter(plain)) if pc.any(plain).as_py() else [])
        rest = texts.filter(pc.invert(plain)).to_pylist()
        odd = iter([np.array(self.whole.encode(x, add_special_tokens=False).ids, np.uint32) for x in rest])
        return [next(out if p else odd) for p in plain.to_pylist()]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process, so ids it knows serve its later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about CHUNK characters; a longer text is a run of its own."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > CHUNK:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS
) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit) and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        bins = OpenSequences(length, open_bins, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for part in _slices(batch):
                columns = [[] for _ in range(7)]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text"))):
                    ids = np.concatenate([ids, end])
                    for piece, start in enumerate(range(0, len(ids), length)):
                        own = ids[start : start + length]
                        sequence, offset = bins.place(len(own))
                        row = (doc_id, piece, start, len(own), own.astype("<u4").tobytes(), sequence, offset)
                        for column, value in zip(columns, row):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, OUT)


def digest(pieces: DataFrame) -> DataFrame:
    """The piece rows with a checksum in place of the ids."""
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark, sf_dir):
    return digest(pack(table(spark, sf_dir, "documents"), default_tokenizer()))
