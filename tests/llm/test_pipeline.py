

import __spark_entry__ as entry
import corpus_pipeline
from rivermark.llm import mixing, near_dedup, packing
from rivermark.llm.common import staged
from tests.llm.test_dedup import SPACE, near_by_hand


def test_stages_keep_their_promises(spark):
    """Each stage against brute force over what the one before kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    fns = dict(corpus_pipeline.STAGES)
    good = staged(fns["quality_rules"](spark, docs, sf))
    once = staged(fns["exact_dedup"](spark, good, sf))
    first = {}
    for r in good.collect():
        first.setdefault(SPACE.sub(" ", r.text or ""), []).append(r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(min(v) for v in first.values())
    apart = staged(fns["near_dedup"](spark, once, sf))
    want = [i for i, _, _, kept in near_by_hand([(r.doc_id, r.text) for r in once.collect()]) if kept]
    assert sorted(r.doc_id for r in apart.collect()) == sorted(want)
    mix = staged(fns["source_mixing"](spark, apart, sf))
    counts = {r.doc_id: r.mix_copies for r in mixing.replicated(apart).select("doc_id", "mix_copies").collect()}
    assert sorted(r.doc_id for r in mix.collect()) == sorted(i for i, n in counts.items() for _ in range(n))
    assert good.columns == once.columns == apart.columns == mix.columns == names
    packed = fns["best_fit_packing"](spark, mix, sf).collect()
    ends = [r for r in packed if r.piece == 0]
    assert sorted(r.doc_id for r in ends) == sorted(r.doc_id for r in mix.collect())
    assert sum(r.length for r in packed) == sum(r.length for r in corpus_pipeline.run(spark, sf).collect())


def test_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, ""))
    assert docs.count() == 0


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([*[f"op{k}" for k in range(1, 11)], "pipeline"])
    assert near_dedup.SHINGLE == 4 and packing.LENGTH == 4096
