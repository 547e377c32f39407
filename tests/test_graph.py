"""Graphs in rounds of joins against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from docketloom.operators import graph
from docketloom.plans import graph_queries


def ways(edges):
    """All (src, dst) with a way of one step or more."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for root in after:
        todo, seen = list(after[root]), set()
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += after.get(n, ())
        out |= {(root, n) for n in seen}
    return out


def make(seed, n, m):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


GRAPHS = [make(1, 30, 36) + [(100 + i, 101 + i) for i in range(9)] + [(105, 102), (109, 109)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] * 2, make(2, 40, 90)]


@pytest.mark.parametrize("edges", GRAPHS)
def test_components_and_closures(spark, edges):
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long")
    reach = ways(edges)
    nodes = {n for e in edges for n in e}
    want = {a: min({a} | {b for b in nodes if (a, b) in reach and (b, a) in reach}) for a in nodes}
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    assert {(r.src, r.dst) for r in graph.reachable(df).collect()} == reach
    roots = spark.createDataFrame([(0,), (3,), (99,)], "root long")
    rows = graph.closure(df, roots, None).collect()
    assert {(r.root, r.node) for r in rows} == {(a, b) for a, b in reach if a in (0, 3)} | {(0, 0), (3, 3), (99, 99)} and len(rows) == len({(r.root, r.node) for r in rows})
    types = spark.createDataFrame([(n, "abc"[n % 3]) for n in nodes], "key long, type string")
    assert {r.key: r.types for r in graph.chain_types(df, types).collect()} == {a: sorted({"abc"[b % 3] for b in nodes if b == a or (a, b) in reach}) for a in nodes}


def test_depths_are_least(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (4, 1), (4, 5)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "root long")
    assert {r.node: r.depth for r in graph.closure(df, roots, 2).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r.node: r.depth for r in graph.closure(df, roots, None).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}


def test_dense_graphs_end(spark):
    """Twenty layers of five nodes have 5^20 ways, but few pairs."""
    edges = [(layer * 5 + a, layer * 5 + 5 + b) for layer in range(20) for a in range(5) for b in range(5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert graph.closure(df, spark.createDataFrame([(0,)], "root long"), None).count() == 101
    assert graph.cycles(df).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.components(none).count() == graph.cycles(none).count() == graph.reachable(none).count() == 0


def test_numbers():
    nodes = [f"n{i}" for i in range(3000)]
    edges = [(f"n{i + 1}", f"n{i}") for i in range(0, 2998, 2)] + [("n5", "unknown"), ("n1", "n0")]
    got = graph.number(nodes, edges)
    assert got["n1"] == 1 and got["n0"] == 2 and got["n3"] == 3 and len(got) == 3000


def test_instructions_have_no_number(spark):
    nodes = spark.createDataFrame([(1, "a", 0, "liability"), (1, "i", 1, "instruction_only"), (1, "b", 2, None), (2, "c", 0, "x")], "graph long, key string, pos int, type string")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "i", "b")], "graph long, before string, after string")
    assert {(r.graph, r.key): r.number for r in graph.numbered(nodes, edges).collect()} == {(1, "b"): 1, (1, "a"): 2, (2, "c"): 1}


@pytest.mark.parametrize("edges", GRAPHS)
def test_chain_types_by_parts(spark, edges):
    """Any parts give the same types: of four nodes, one for all, one a node; rows of a part come in many batches."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        reach, nodes = ways(edges), {n for e in edges for n in e}
        keys = [n for n in nodes if n % 5] + [1000]
        rows = [(n, "abcd"[n % 4] if n % 7 else None) for n in keys] + [(None, "a"), (1000, "z"), (1000, "z")]
        kinds = {}
        for key, kind in rows:
            kinds.setdefault(key, set()).add(kind)
        want = {a: sorted({k for b in keys if b == a or (a, b) in reach for k in kinds[b] if k}) for a in keys}
        df = spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long")
        types = spark.createDataFrame(rows, "key long, type string")
        for part in (lambda n: F.shiftright(n, 2), lambda n: F.lit(None).cast("int"), lambda n: n):
            got = graph.chain_types(df, types, part).collect()
            assert {r.key: r.types for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_only_edges_between_orders_go_through_rounds(spark, tmp_path, monkeypatch):
    orders = [(o, o % 3) for o in range(60)]
    lines = [(o, i, "AR"[o % 2], "OF"[i % 2]) for o in range(60) for i in range(1, 1 + o % 8)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spread, walked = graph.spread, []
    monkeypatch.setattr(graph, "spread", lambda edges, *a: walked.append(edges.count()) or spread(edges, *a))
    got = {r.key: r.types for r in graph_queries.line_chain_types(spark, str(tmp_path)).collect()}
    edges = [tuple(r) for r in graph_queries.line_edges(spark, str(tmp_path)).collect()]
    reach, kind = ways(edges), {o * 8 + i: a + b for o, i, a, b in lines}
    assert got == {n: ",".join(sorted({kind[m] for m in kind if m == n or (n, m) in reach})) for n in kind}
    assert 0 < sum(walked) <= sum(a // 8 != b // 8 for a, b in edges) < len(edges) / 4


@pytest.mark.parametrize("edges", GRAPHS)
def test_components_by_parts(spark, edges):
    """Any parts give the same components, also of cycles over several parts; rows of a part come in many batches."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        reach, nodes = ways(edges), {n for e in edges for n in e}
        want = {a: min({a} | {b for b in nodes if (a, b) in reach and (b, a) in reach}) for a in nodes}
        df = spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long")
        for part in (lambda n: F.shiftright(n, 2), lambda n: n % 3, lambda n: F.lit(None).cast("int"), lambda n: n):
            got = graph.components(df, part).collect()
            assert {r.node: r.component for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_only_edges_between_orders_are_coloured(spark, tmp_path, monkeypatch):
    orders = [(o, o % 3) for o in range(60)]
    lines = [(o, i) for o in range(60) for i in range(1, 1 + o % 8)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    coloured, seen = graph.least_both_ways, []
    monkeypatch.setattr(graph, "least_both_ways", lambda edges: seen.append(edges.count()) or coloured(edges))
    got = {r.node: r.component for r in graph_queries.line_components(spark, str(tmp_path)).collect()}
    edges = [tuple(r) for r in graph_queries.line_edges(spark, str(tmp_path)).collect()]
    reach, nodes = ways(edges), {n for e in edges for n in e}
    assert got == {a: min({a} | {b for b in nodes if (a, b) in reach and (b, a) in reach}) for a in nodes}
    assert sum(seen) <= sum(a // 8 != b // 8 for a, b in edges) < len(edges) / 4 and any(n != c for n, c in got.items())
