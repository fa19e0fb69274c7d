import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rivermark.llm import packing
from tests.llm.conftest import ODD


def check(docs, length, open_bins=packing.OPEN_BINS):
    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    rows = packing.digest(packing.pack(docs, path, length=length, open_bins=open_bins)).collect()
    want = []
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), length)):
            own = ids[start : start + length]
            want.append((r.doc_id, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
    return len(places), sum(r.length for r in rows)


@pytest.mark.parametrize("length,open_bins", [(4096, 4096), (64, 2), (1, 1)])
def test_odd_texts(spark, rows_of, length, open_bins):
    check(rows_of([p for p in ODD if len(p[1] or "") < 10_000]), length, open_bins)


def test_given_documents(spark):
    sequences, tokens = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1), packing.LENGTH)
    assert sequences <= 1.05 * tokens / packing.LENGTH + 1


def test_empty(spark, rows_of):
    assert packing.pack(rows_of([]), packing.default_tokenizer()).count() == 0


def test_best_fit_and_closing():
    bins = packing.OpenSequences(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.OpenSequences(10, 2)
    # Two are open with 4 and 3 free places; the fuller one is closed for the third.
    assert [bins.place(n) for n in (6, 7, 5, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5)]


def test_small_cache(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHE", 3)
    encoder = packing.Encoder(packing.default_tokenizer())
    texts = ["one two three", "it's four 5 five", "", "two one <|startoftext|>", "Ünï-cödé ½ İ"]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [encoder.whole.encode(t, add_special_tokens=False).ids for t in texts]
