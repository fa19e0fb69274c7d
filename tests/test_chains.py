"""Layers, distances and cycles against plain walks, and on chains too long to peel step by step."""

import random
from collections import deque

from pyspark.sql import functions as F

from rivermark.operators import chains, flow
from rivermark.operators.patterns import cyclic_topology


def plain(edges, seed):
    """Layers by the longest path, or by steps from the seed where there is a cycle; wallets not reached."""
    nodes = {x for e in edges for x in e}
    out = {n: {b for a, b in edges if a == n and b != n} for n in nodes}
    into = {n: sum(n in out[a] for a in nodes) for n in nodes}
    layer, todo, left = dict.fromkeys(nodes, 0), deque(n for n in nodes if not into[n]), dict(into)
    done = 0
    while todo:
        n = todo.popleft()
        done += 1
        for m in out[n]:
            layer[m] = max(layer[m], layer[n] + 1)
            left[m] -= 1
            if not left[m]:
                todo.append(m)
    steps, todo = {seed: 0}, deque([seed])
    while todo:
        n = todo.popleft()
        for m in out[n]:
            if m not in steps:
                steps[m] = steps[n] + 1
                todo.append(m)
    acyclic = done == len(nodes)
    if not acyclic:
        layer = {n: steps.get(n, max(steps.values()) + 1) for n in nodes}
    return layer, acyclic, len(nodes - steps.keys())


def frame(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, from_address string, to_address string")


def graph(r, kind):
    if kind == "chain":
        edges = [(f"c{k}", f"c{k + 1}") for k in range(16)] + [(f"c{k}", f"x{k}") for k in range(0, 16, 2)] + [("y", "c7"), ("c3", "c13"), ("z", "z2")]
    elif kind == "ring":
        edges = [(f"c{k}", f"c{(k + 1) % 6}") for k in range(6)] + [("c3", "t0"), ("t0", "t1"), ("t1", "t2"), ("in", "c5")]
    elif kind == "apart":
        edges = [("s", "a"), ("a", "b")] + [(f"c{k}", f"c{(k + 1) % 5}") for k in range(5)] + [("q", "q")]
    else:
        n = 6
        pick = lambda: f"n{r.randrange(n)}"
        edges = [(pick(), pick()) for _ in range(r.choice([n, 2 * n]))]
        if r.random() < 0.6:
            edges = [(a, b) for a, b in edges if int(a[1:]) < int(b[1:])] or [("n0", "n1")]
    return list(dict.fromkeys(edges))


def test_layers_strays_and_cycles(spark):
    r = random.Random(2)
    graphs = {f"g{k}": graph(r, kind) for k, kind in enumerate(["chain", "ring", "apart"] + ["any"] * 6)}
    rows = [(g, a, b) for g, edges in graphs.items() for a, b in edges]
    starts = {g: edges[0][0] for g, edges in graphs.items()}
    seeds = spark.createDataFrame(list(starts.items()), "trace_id string, address string")
    want = {g: plain(edges, starts[g]) for g, edges in graphs.items()}
    df = frame(spark, rows)
    got = {(x.trace_id, x.address): (x.layer, x.acyclic) for x in flow.flow_layers(df, seeds).collect()}
    assert got == {(g, n): (layer, ok) for g, (layers, ok, _) in want.items() for n, layer in layers.items()}
    strays = {x.trace_id: x.strays for x in flow.flow_strays(df, seeds).collect()}
    assert strays == {g: w[2] for g, w in want.items()}
    loops = {g: not want[g][1] or any(a == b for a, b in edges) for g, edges in graphs.items()}
    found = {x.trace_id: x.has_directed_cycle for x in cyclic_topology(df, ["trace_id"]).collect()}
    assert found == loops


def test_long_peel_chain_takes_few_rounds(spark, monkeypatch):
    """A hundred thousand wallets in a row, each with a side payment."""
    n, rounds = 100_000, []
    chain = spark.range(n).select(F.lit("t").alias("trace_id"), F.col("id").cast("string").alias("from_address"), (F.col("id") + 1).cast("string").alias("to_address"))
    sides = spark.range(n).select(F.lit("t").alias("trace_id"), F.col("id").cast("string").alias("from_address"), F.concat(F.lit("x"), "id").alias("to_address"))
    doubled, whole = chains._doubled, chains.contracted
    monkeypatch.setattr(chains, "_doubled", lambda *a: rounds.append(1) or doubled(*a))
    monkeypatch.setattr(chains, "contracted", lambda *a, **k: rounds.append(1) or whole(*a, **k))
    seeds = spark.createDataFrame([("t", "0")], "trace_id string, address string")
    edges = chain.unionByName(sides)
    top = flow.flow_layers(edges, seeds).agg(F.max("layer"), F.count(F.lit(1)), F.sum("layer"), F.min("acyclic")).first()
    assert tuple(top) == (n, 2 * n + 1, 2 * (n * (n + 1) // 2), True)
    assert len(rounds) <= 25
