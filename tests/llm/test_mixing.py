from rivermark.llm import mixing
from tests.llm.conftest import ODD


def test_odd_rows(spark, rows_of):
    docs = rows_of(ODD, source=None)
    got = mixing.mixed(docs, epochs=40.0).collect()
    counts = {}
    for r in got:
        counts[(r.doc_id, r.text)] = counts.get((r.doc_id, r.text), 0) + 1
    assert all(r.mix_rate == 40.0 and 1 <= r.mix_copy <= r.mix_copies for r in got)
    assert 300 < len(got) < 700 and counts[(4, "one")] % 2 == 0
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_weights(spark):
    rows = [(k, "x" * 9, "a" if k % 3 else None) for k in range(6000)] + [(9000 + k, "y" * 9, "b") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs, {"a": 1.0, None: 2.0, "c": 5.0})
    share = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert "b" not in share
    # Means of 3 and 6 thousand copies; five standard deviations.
    assert abs(share["a"] - 3000) < 5 * 3000**0.5 and abs(share[None] - 6000) < 5 * 6000**0.5
    counts = {r.doc_id: r.mix_copies for r in got.collect()}
    zero = sum(k not in counts for k in range(6000) if k % 3)
    assert abs(zero / 4000 - 2.718281828 ** -0.75) < 0.03
    assert mixing.mixed(docs, {}).count() == 0


def test_order_is_global(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'t' as text", "'s' as source").coalesce(1)
    got = [r.doc_id for r in mixing.mixed(docs, epochs=3.0).collect()]
    ups = sum(a < b for a, b in zip(got, got[1:]))
    assert 0.4 < ups / len(got) < 0.6
