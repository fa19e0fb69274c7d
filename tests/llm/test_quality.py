import re

import pytest

from rivermark.llm import quality
from tests.llm.conftest import ODD


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            for k in at:
                covered.update(range(k, k + 8))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def test_counts(spark, rows_of):
    part = "alpha beta gamma delta eps zeta eta theta iota"
    pairs = ODD + [(30, f"{part} x {part} y"), (31, f"{part} {part} {part}"), (32, "a b c d e f g h\na b c d e f g h x a b c d e f g"), (33, "# $ |\n\n \n# $ |")]
    got = quality.verdicts(rows_of(pairs)).collect()
    base = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert sorted(map(base, got)) == sorted(by_hand(t) for _, t in pairs)
    assert not any(r.kept and r.base_failed for r in got)


def em_by_hand(votes):
    prior, rates = quality._start()
    start_prior, start = quality._start()
    names = ("bad", "good")
    for _ in range(quality.ROUNDS):
        good = []
        for v in votes:
            side = [1 - prior, prior]
            for j, k in enumerate(v):
                side = [side[y] * rates[j][y][k] for y in (0, 1)]
            good.append(side[1] / sum(side))
        totals = [sum(1 - g for g in good), sum(good)]
        before = [prior, *[p for r in rates for y in r for p in y]]
        prior = (totals[1] + start_prior) / (len(votes) + 1)
        rates = [[[(sum((g if y else 1 - g) for g, v in zip(good, votes) if v[j] == k) + start[j][y][k]) / (totals[y] + 1)
                   for k in range(3)] for y, _ in enumerate(names)] for j in range(len(rates))]
        if max(abs(a - b) for a, b in zip(before, [prior, *[p for r in rates for y in r for p in y]])) < quality.STILL:
            break
    return prior, rates


def test_fit(spark):
    import random

    r = random.Random(2)
    votes = []
    for _ in range(300):
        bad = r.random() < 0.2
        votes.append(tuple(r.choices((0, 1, 2), ((2, 4, 4) if bad else (2, 0.2, 8)))[0] for _ in quality.RULES))
    frame = spark.createDataFrame(votes, ", ".join(f"v{j} int" for j in range(len(quality.RULES))))
    prior, rates = quality.fit(frame)
    want_prior, want = em_by_hand(votes)
    assert prior == pytest.approx(want_prior, abs=1e-6)
    for a, b in zip(rates, want):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, abs=1e-6)
    assert quality.fit(frame.limit(0)) == quality._start()


def test_good_documents(spark, rows_of):
    prose = " ".join(f"the w{k} of and" for k in range(40))
    docs = rows_of([(1, prose), (2, "short"), (3, None), (None, prose + " end")])
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert quality.good_documents(docs.limit(0)).count() == 0


def test_same_verdict_in_both_forms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in quality.verdicts(docs).filter("kept").collect()}
    assert kept == {r.doc_id for r in quality.good_documents(docs).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    judged = [(labels[i], i in kept) for i in labels]
    assert sum(bool(a) == b for a, b in judged) >= 0.85 * len(judged)
