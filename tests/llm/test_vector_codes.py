import hashlib
import math
import random

import numpy as np
import pytest

from rivermark.llm import vector_codes
from rivermark.llm.vector_codes import Bounds, compress, moves, report


def by_hand(rows, parts=8, entries=16, rounds=6):
    """Codes and errors of (id, label, vector) by comparing every part with every entry in every round."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    whole = [[math.floor(4096 * x) for x in r[2]] for r in kept]
    width = len(whole[0]) // parts
    split = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[split[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(s[p], books[p])[1] for s in split]
            for e in range(len(books[p])):
                mine = [s[p] for s, o in zip(split, own) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[nearest(s[p], books[p]) for p in range(parts)] for s in split]
    errors = [sum(d for d, _ in row) for row in last]
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    of = {}
    for r, e in zip(kept, errors):
        of[r[1]] = of.get(r[1], 0) + e
    return sorted(str((r[0], "".join(f"{k:02x}" for _, k in row), e, of[r[1]], sha)) for r, row, e in zip(kept, last, errors))


def frame(spark, rows, kind="float"):
    schema = f"vec_id long, label string, embedding array<{kind}>, v string, code string, id int"
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)


def got(df):
    return sorted(str((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in report(compress(df, keep=("label",))).collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_codes_as_by_hand(spark, kind):
    r = random.Random(kind)
    centres = [[r.choice([-1, 0, 0.25, 1]) for _ in range(16)] for _ in range(12)]
    rows = [(i * 7 % 400, r.choice(["a", "b", None, ""]), [float(np.float32(x + r.gauss(0, 0.3))) for x in r.choice(centres)]) for i in range(400)]
    rows += [(400 + i, "tie", [0.0] * 16) for i in range(40)]  # equal vectors
    rows += [(900, "a", None), (901, "a", [None] + [1.0] * 15), (902, "b", [math.nan] * 16), (903, "b", [math.inf] + [0.0] * 15)]
    rows += [(None, "n", [0.5] * 16), (5, "again", [3.0] * 16), (7, None, [-0.0001] * 16)]
    rows = [x for x in rows if x[0] != 5 or x[1] == "again"]
    assert got(frame(spark, rows, kind).repartition(7)) == by_hand(rows)


def test_few_rows_repeats_and_odd_lengths(spark):
    rows = [(1, "a", [1.0] * 8), (1, "a", [1.0] * 8), (2, None, [2.0] * 8)]
    assert got(frame(spark, rows)) == by_hand(rows)
    coded = compress(frame(spark, [*rows, (3, "a", [1.0] * 16), (4, "a", [])]), keep=("label",))
    assert {(r.vec_id, r.code) for r in coded.rows.collect()} == {(1, "00" * 8), (2, "02" * 8), (3, None), (4, None)}
    assert compress(frame(spark, [(1, "a", [1.0] * 9)])).rows.collect()[0].code is None
    assert compress(frame(spark, [])).rows.count() == 0 and report(compress(frame(spark, []), keep=("label",))).count() == 0
    with pytest.raises(Exception, match="too large"):
        compress(frame(spark, [*rows, (9, "a", [3e9] * 8)])).rows.collect()


def test_bounds_hold_and_spare_scans():
    """Entries as by full scans in every round, with fewer scans than bounds that add up all moves."""
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(4000, 8)) * 4096).astype(np.int64) + (rng.integers(0, 12, 4000)[:, None] * 9000)
    history = [points[:16].copy()]
    net, summed = Bounds(4000), Bounds(4000)
    scans = {"net": 0, "summed": 0}
    for t in range(12):
        books = np.stack(history)
        gone = moves(books)
        step = np.sqrt((np.diff(books, axis=0).astype(float) ** 2).sum(-1))
        drift = np.concatenate([np.cumsum(step[::-1], 0)[::-1], np.zeros((1, 16))]) if t else gone
        assert (gone <= drift + 1e-9).all()
        scans["net"] += net.assign(points, books, gone)
        scans["summed"] += summed.assign(points, books, drift)
        plain = ((points[:, None] - books[-1][None]) ** 2).sum(-1).argmin(1)
        assert (net.own == plain).all() and (summed.own == plain).all()
        sums = np.zeros((16, 8), np.int64)
        np.add.at(sums, plain, points)
        counts = np.bincount(plain, minlength=16)
        history.append(vector_codes.moved(history[-1], sums.ravel().tolist(), counts.tolist()))
    assert scans["net"] < scans["summed"] < 12 * 4000


def test_copies_are_removed(spark):
    import os

    def kept():
        return {f for d, _, _ in os.walk(spark.sparkContext.getCheckpointDir().removeprefix("file:")) for f in d.split("/") if f.startswith(("state-", "codes-"))}

    before = kept()
    assert compress(frame(spark, [(i, "a", [float(i % 5)] * 8) for i in range(50)])).rows.count() == 50
    assert [f.split("-")[0] for f in kept() - before] == ["codes"]  # the result itself
    before = kept()
    with pytest.raises(Exception, match="too large"):
        compress(frame(spark, [(i, "a", [3e9 if i == 40 else 1.0] * 8) for i in range(50)]))
    assert kept() == before
