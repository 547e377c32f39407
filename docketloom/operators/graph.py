"""Reference and charge graphs: closures, components and cycles in rounds of joins, validation, numbering.

Every round joins what the round before found to the edges and writes it to the shared folder. Nodes
and edges are never gathered. Null ends make no edge; repeated edges count once.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import dealt, large, shared_dir, stage, written


def known_edges(edges: DataFrame) -> DataFrame:
    """src, dst once each, without nulls, as a table of its own."""
    return stage(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


# A doubling of strides may join so many rows, or so many times the edges.
STRIDE_ROWS, STRIDE_SHARE = 1_000_000, 4


def strides(edges: DataFrame) -> tuple[DataFrame, int | None]:
    """src, dst, d: pairs of different nodes with the least number of steps between them, and how many steps are in it at most; None where all ways are.

    Pairs of exactly the steps so far are joined to all pairs, so steps double; each new pair comes from the middles of its shortest ways
    only. A doubling whose rows, counted before it, would outgrow the edges is left out, so the table stays linear in them.
    """
    spark, folder, steps = edges.sparkSession, shared_dir(edges.sparkSession, "strides"), 1
    pairs = written(edges.select("src", "dst", F.lit(1).alias("d")).where("src is not null and dst is not null and src <> dst").distinct(), f"{folder}/1")
    paths, most = [f"{folder}/1"], max(STRIDE_ROWS, STRIDE_SHARE * pairs.count())
    while True:
        tips = pairs.where(F.col("d") == steps).select("src", F.col("dst").alias("mid"))
        ways = tips.groupBy("mid").agg(F.count("*").alias("n")).join(pairs.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("m")), "mid")
        rows = ways.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
        if not rows:
            return pairs, None
        if rows > most:
            return pairs, steps
        reached = tips.join(pairs.select(F.col("src").alias("mid"), "dst", "d"), "mid").where("src <> dst").groupBy("src", "dst").agg((F.min("d") + steps).alias("d"))
        steps *= 2
        written(reached.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti"), f"{folder}/{steps}")
        paths.append(f"{folder}/{steps}")
        pairs = spark.read.schema(pairs.schema).parquet(*paths)


def spread(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """node, label, depth: every label carried along the edges, with the least number of steps it takes (at most ``most``).

    ``seeds``: node, label. Each round joins only the pairs that came in the last step to the edges and leaves out those known, so a pair
    travels once, however many ways lead to it; rounds end when there is nothing new. Without ``most`` a round goes as far as ``strides``.
    """
    spark, folder, at = edges.sparkSession, shared_dir(edges.sparkSession, "spread"), 0
    e, far = strides(edges) if most is None else (known_edges(edges).withColumn("d", F.lit(1)), 1)
    new = written(seeds.select("node", "label", F.lit(0).alias("depth")).where("node is not null").distinct(), f"{folder}/0")
    paths = [f"{folder}/0"]
    while most is None or at < most:
        tips = new.where(F.col("depth") == at)
        if tips.isEmpty():
            break
        known = spark.read.schema(new.schema).parquet(*paths)
        reached = tips.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "label").agg((F.min("d") + at).alias("depth"))
        fresh = reached.alias("r").join(known.alias("k"), (F.col("r.node") == F.col("k.node")) & F.col("r.label").eqNullSafe(F.col("k.label")), "left_anti")
        new = written(fresh, f"{folder}/{len(paths)}")
        paths.append(f"{folder}/{len(paths)}")
        if far is None:
            break
        at += far
    return spark.read.schema(new.schema).parquet(*paths)


def closure(edges: DataFrame, roots: DataFrame, depth: int | None = 2) -> DataFrame:
    """root, node, depth: nodes reached from each root within ``depth`` steps (None: any number). ``edges``: src, dst; ``roots``: root."""
    return spread(edges, roots.select(F.col("root").alias("node"), F.col("root").alias("label")), depth).select(F.col("label").alias("root"), "node", "depth")


def reachable(edges: DataFrame) -> DataFrame:
    """src, dst: all pairs with a way of one step or more."""
    return spread(edges, edges.select(F.col("dst").alias("node"), F.col("src").alias("label")).where("label is not null")).select(F.col("label").alias("src"), F.col("node").alias("dst"))


def least_both_ways(edges: DataFrame) -> DataFrame:
    """node, least, back: of all nodes with a way to a node, and itself, the first by hash; and of those that it has a way to. Both go round together, and only colours that changed travel on."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    ways = stage(edges.select("src", "dst", F.lit(0).alias("way")).union(turned(edges).select("src", "dst", F.lit(1))), "ways")
    state = ends.select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n")).alias("least"), F.lit(True).alias("changed"))
    # two folders in turn: a round overwrites what the round before last found, so that disk doesn't grow with rounds
    folder, rounds = shared_dir(edges.sparkSession, "colours"), 0
    state = written(state, f"{folder}/0")
    while not state.where("changed").isEmpty():
        rounds += 1
        offers = state.where("changed").withColumnRenamed("node", "src").join(ways, ["src", "way"]).groupBy(F.col("dst").alias("node"), "way").agg(F.min("least").alias("offer"))
        both = state.join(offers, ["node", "way"], "left")
        state = written(both.select("node", "way", F.least("least", "offer").alias("least"), F.coalesce(F.col("offer") < F.col("least"), F.lit(False)).alias("changed")), f"{folder}/{rounds % 2}")
    return state.groupBy("node").agg(F.max(F.when(F.col("way") == 0, F.col("least"))).alias("least"), F.max(F.when(F.col("way") == 1, F.col("least"))).alias("back"))


def components(edges: DataFrame, part: Callable[[Column], Column] | None = None) -> DataFrame:
    """node, component: strongly connected components, each named by its least node; a node on no cycle is its own.

    Forward and backward colouring: a node whose first ancestor and first descendant are the same lies in that node's component; edges
    between nodes that differ in either are in none and go. First is by hash, so what is left halves from round to round, as in quicksort.

    With ``part``, a function of a node's column that puts few nodes together of which many edges stay together, components are found inside the parts first, all of a
    part at once. A cycle over several parts goes through nodes that edges from other parts lead to, so only these, where they lead on to other parts, are coloured.
    """
    if part is not None:
        return _parted_components(edges, part)
    all_edges = known_edges(edges)
    live = stage(all_edges.where("src <> dst"), "live")
    spark, folder, paths = edges.sparkSession, shared_dir(edges.sparkSession, "components"), []
    while not live.isEmpty():
        coloured = stage(least_both_ways(live), "coloured")
        paths.append(f"{folder}/{len(paths)}")
        written(coloured.where("least = back").select("node", F.col("least.n").alias("head")), paths[-1])
        open_ = coloured.where("least <> back").select("node", F.struct("least", "back").alias("c"))
        left = live.join(open_.select(F.col("node").alias("src"), F.col("c").alias("c_src")), "src").join(open_.select(F.col("node").alias("dst"), F.col("c").alias("c_dst")), "dst")
        live = stage(left.where("c_src = c_dst").select("src", "dst"), "live")
    nodes = all_edges.select(F.col("src").alias("node")).union(all_edges.select("dst")).distinct()
    if not paths:
        return nodes.withColumn("component", F.col("node"))
    heads = spark.read.parquet(*paths)
    names = heads.groupBy("head").agg(F.min("node").alias("component"))
    found = heads.join(names, "head").select("node", "component")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those from a node that none leads to, or to a node that leads nowhere, as no cycle has them; again and again, as long as half of them go."""
    n = edges.count()
    while n:
        left = edges.join(large(edges.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(large(edges.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi")
        edges, before = stage(left.select("src", "dst"), "trimmed"), n
        n = edges.count()
        if 2 * n > before:
            break
    return edges


def _parted_components(edges: DataFrame, part: Callable[[Column], Column]) -> DataFrame:
    """Of a cycle over several parts each node is reached by one of its entries ``ins`` of its own part, and reaches a node of another part, ``outs``, that lies in one component with that entry."""
    edges, key = stage(edges.select("src", "dst"), "edges"), edges.schema["src"].dataType
    kind, place = key.simpleString(), lambda c: F.xxhash64(part(F.col(c)))
    ways = edges.where("src is not null and dst is not null").select("src", F.col("dst").cast(key).alias("dst")).withColumns({"p": place("src"), "q": place("dst")})
    row = lambda p, kind, a, b: F.struct(F.col(p).alias("part"), F.lit(kind).alias("kind"), F.col(a).alias("a"), b.cast(key).alias("b"))
    across = F.array(row("p", OUT, "src", F.col("dst")), row("q", ENTRY, "dst", F.lit(None)))
    told = ways.select(F.explode(F.when(F.col("p") == F.col("q"), F.array(row("p", INNER, "src", F.col("dst")))).otherwise(across)).alias("r")).select("r.*")
    found = dealt(told, "part", rows=2 * edges.count()).sortWithinPartitions("part").mapInArrow(_whole_parts(_inside_components), f"node {kind}, component {kind}, ins array<{kind}>, outs array<{kind}>")
    known = stage(found, "inside")
    open_ = known.where("size(ins) > 0 and size(outs) > 0")
    entries = open_.where("array_contains(ins, node)")
    steps = entries.select(F.explode("ins").alias("src"), F.col("node").alias("dst")).where("src <> dst")  # of one part
    steps = stage(entries.select(F.col("node").alias("src"), F.explode("outs").alias("dst")).union(steps), "steps")
    heads = components(_trimmed(steps)).withColumnRenamed("component", "c")
    heads = stage(heads.join(heads.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c"), "c"), "heads")
    if heads.isEmpty():
        return known.select("node", "component")
    heads = large(heads)
    ins = open_.select("node", F.explode("ins").alias("head")).join(heads.withColumnRenamed("node", "head"), "head").select("node", "c").distinct()
    outs = open_.select("node", F.explode("outs").alias("head")).join(heads.withColumnRenamed("node", "head"), "head").select("node", "c").distinct()
    crossing = stage(ins.join(large(outs), ["node", "c"]), "crossing")
    names = crossing.join(large(crossing.groupBy("c").agg(F.min("node").alias("name"))), "c").select("node", "name")
    return known.join(large(names), "node", "left").select("node", F.coalesce("name", "component").alias("component"))


def inside(edges: DataFrame) -> DataFrame:
    """The edges that lie on some cycle: both ends in one component."""
    parts = stage(components(edges), "parts")
    ends = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    ends = ends.join(parts.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    return ends.where("a = b").select("src", "dst")


def cycles(edges: DataFrame) -> DataFrame:
    """path: each simple cycle once, from its least node. Only edges inside a component are walked; there are as many rows as cycles, which dense components have many of."""
    spark, folder, paths = edges.sparkSession, shared_dir(edges.sparkSession, "cycles"), []
    e = stage(inside(edges), "inside")
    walk = stage(e.where("src <= dst").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src").alias("path")), "walk")
    while not walk.isEmpty():
        paths.append(f"{folder}/{len(paths)}")
        written(walk.where("node = start").select(F.concat_ws(" -> ", F.array_append("path", F.col("start"))).alias("path")), paths[-1])
        on = walk.where("node > start").withColumn("path", F.array_append("path", F.col("node")))
        walk = stage(on.join(e, F.col("node") == F.col("src")).where("dst >= start and (dst = start or not array_contains(path, dst))").select("start", F.col("dst").alias("node"), "path"), "walk")
    return spark.read.schema("path string").parquet(*paths) if paths else spark.createDataFrame([], "path string")


def carried(edges: np.ndarray, pairs: np.ndarray, n_nodes: int, n_labels: int) -> np.ndarray:
    """(node, label) pairs of every label taken along the edges, each once, in order. ``edges``: rows of src, dst; ``pairs``: rows of node, label; all are numbers from 0. Only new pairs go on."""
    dst = edges[np.argsort(edges[:, 0], kind="stable"), 1]
    starts = np.concatenate([[0], np.cumsum(np.bincount(edges[:, 0], minlength=n_nodes))])
    known = new = np.unique(pairs[:, 0] * n_labels + pairs[:, 1])
    while len(new):
        node, label = np.divmod(new, n_labels)
        n = starts[node + 1] - starts[node]
        at = np.arange(n.sum()) + np.repeat(starts[node] - np.cumsum(n) + n, n)
        reached = np.unique(dst[at] * n_labels + np.repeat(label, n))
        new = reached[known[np.minimum(np.searchsorted(known, reached), len(known) - 1)] != reached]
        known = np.sort(np.concatenate([known, new]), kind="stable")
    return np.stack(np.divmod(known, n_labels), axis=1)


# What a row of a part says: a node and one of its types, an edge inside the part, an edge out of it, a node that an edge from another part leads to.
NODE, INNER, OUT, ENTRY = range(4)


def _sets(pairs: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """For each of ``n`` nodes the list of its labels' values; ``pairs`` are in order of nodes."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(n + 1)), pa.int32()), values.take(pa.array(pairs[:, 1])))


def _inside(rows: pa.Table) -> pa.RecordBatch:
    """key, given, entry, types, outs for the nodes of whole parts: what each reaches without leaving its part."""
    ends = pa.concat_arrays([*rows["a"].chunks, *rows["b"].chunks]).dictionary_encode()
    codes, keys = pc.fill_null(ends.indices, -1).to_numpy().astype(np.int64), ends.dictionary
    a, b, kind = codes[: len(rows)], codes[len(rows) :], rows["kind"].to_numpy()
    types = rows["type"].combine_chunks().dictionary_encode()
    label, n_types = pc.fill_null(types.indices, -1).to_numpy().astype(np.int64), len(types.dictionary)
    inner, out, typed = kind == INNER, kind == OUT, label >= 0
    # types and the nodes led to outside are labels alike, types first; both go against the edges
    own = np.concatenate([np.stack([a[typed], label[typed]], axis=1), np.stack([a[out], n_types + b[out]], axis=1)])
    got = carried(np.stack([b[inner], a[inner]], axis=1), own, len(keys), n_types + len(keys))
    of_type = got[:, 1] < n_types
    marks = [np.bincount(a[kind == k], minlength=len(keys)) > 0 for k in (NODE, ENTRY)]
    here = np.flatnonzero(np.bincount(np.concatenate([a, b[inner]]), minlength=len(keys)))  # the far ends of edges out are nodes of other parts
    columns = [keys, pa.array(marks[0]), pa.array(marks[1]), _sets(got[of_type], len(keys), types.dictionary), _sets(got[~of_type] - [0, n_types], len(keys), keys)]
    return pa.RecordBatch.from_arrays(columns, ["key", "given", "entry", "types", "outs"]).take(pa.array(here))


def _inside_components(rows: pa.Table) -> pa.RecordBatch:
    """node, component, ins, outs for the nodes of whole parts: the component without leaving the part; the nodes that edges from other parts lead to and that lead to it inside the part; and the
    nodes of other parts that it leads to. Both are empty where one is."""
    ends = pa.concat_arrays([*rows["a"].chunks, *rows["b"].chunks]).dictionary_encode()
    codes, keys = pc.fill_null(ends.indices, -1).to_numpy().astype(np.int64), ends.dictionary
    a, b, kind = codes[: len(rows)], codes[len(rows) :], rows["kind"].to_numpy()
    inner, out, entry, n = kind == INNER, kind == OUT, kind == ENTRY, len(keys)
    here = np.unique(np.concatenate([a, b[inner]]))
    ways = np.stack([a[inner], b[inner]], axis=1)
    order = pc.sort_indices(keys).to_numpy().astype(np.int64)  # places by key, so that the least node is the first
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    reach = carried(ways[:, ::-1], np.stack([here, rank[here]], axis=1), n, n)  # each node and those it leads to, itself among them
    to = order[reach[:, 1]]
    mutual = reach[np.isin(reach[:, 0] * n + to, to * n + reach[:, 0])]
    first = np.full(n, n)
    np.minimum.at(first, mutual[:, 0], mutual[:, 1])
    ins = carried(ways, np.stack([a[entry], a[entry]], axis=1), n, n)
    outs = carried(ways[:, ::-1], np.stack([a[out], b[out]], axis=1), n, n)
    both = np.intersect1d(ins[:, 0], outs[:, 0])
    ins, outs = (x[np.isin(x[:, 0], both)] for x in (ins, outs))
    columns = [keys, keys.take(pa.array(order[np.minimum(first, n - 1)])), _sets(ins, n, keys), _sets(outs, n, keys)]
    return pa.RecordBatch.from_arrays(columns, ["node", "component", "ins", "outs"]).take(pa.array(here))


def _whole_parts(inside: Callable[[pa.Table], pa.RecordBatch]):
    """``inside`` of rows in order of parts: those of a batch's last part wait for the next batch, repeated ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows:
                end = pc.index(held["part"], held["part"][-1]).as_py()
                if end:
                    yield inside(held.slice(0, end))
                    held = held.slice(end)
                else:
                    held = held.group_by(held.column_names, use_threads=False).aggregate([])
        if held is not None and held.num_rows:
            yield inside(held)

    return run


def inside_parts(edges: DataFrame, nodes: DataFrame, part: Callable[[Column], Column]) -> DataFrame:
    """key, given, entry, types, outs: for each node the types and the nodes of other parts that it leads to by edges of its own part, whether ``nodes`` has it, and whether an edge
    from another part leads to it. A part's distinct rows are in one task, so parts must be small; which nodes share one is free, it decides the time only."""
    place = lambda c: F.xxhash64(part(F.col(c)))
    key, label = nodes.schema["key"].dataType, nodes.schema["type"].dataType
    ways = edges.where("src is not null and dst is not null").select(F.col("src").cast(key).alias("src"), F.col("dst").cast(key).alias("dst")).withColumns({"p": place("src"), "q": place("dst")})
    row = lambda p, kind, a, b: F.struct(F.col(p).alias("part"), F.lit(kind).alias("kind"), F.col(a).alias("a"), b.cast(key).alias("b"))
    across = F.array(row("p", OUT, "src", F.col("dst")), row("q", ENTRY, "dst", F.lit(None)))
    told = ways.select(F.explode(F.when(F.col("p") == F.col("q"), F.array(row("p", INNER, "src", F.col("dst")))).otherwise(across)).alias("r")).select("r.*", F.lit(None).cast(label).alias("type"))
    own = nodes.where("key is not null").select(place("key").alias("part"), F.lit(NODE).alias("kind"), F.col("key").alias("a"), F.lit(None).cast(key).alias("b"), "type")
    kinds = {n: k.simpleString() for n, k in (("key", key), ("type", label))}
    schema = f"key {kinds['key']}, given boolean, entry boolean, types array<{kinds['type']}>, outs array<{kinds['key']}>"
    return stage(dealt(own.union(told), "part", rows=2 * nodes.count()).sortWithinPartitions("part").mapInArrow(_whole_parts(_inside), schema), "inside")


def chain_types(edges: DataFrame, nodes: DataFrame, part: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, types: the sorted types of all nodes on the chains from each node, of any length. ``nodes``: key, type. Types travel against the edges, each once to a node.

    With ``part``, a function of a node's column that puts few nodes together of which many edges stay together, chains are walked inside the parts first, all of a part
    at once; only nodes that edges between parts lead to go through rounds, and what they found is joined to the nodes that lead to them.
    """
    if part is None:
        found = spread(turned(edges), nodes.select(F.col("key").alias("node"), F.col("type").alias("label")))
        return found.join(nodes.select(F.col("key").alias("node")).distinct(), "node", "left_semi").groupBy(F.col("node").alias("key")).agg(F.array_sort(F.collect_set("label")).alias("types"))
    known = inside_parts(edges, nodes, part)
    entries = known.where("entry")
    ahead = stage(chain_types(entries.select(F.col("key").alias("src"), F.explode("outs").alias("dst")), entries.select("key", F.explode_outer("types").alias("type"))), "ahead")
    near = known.where("given and size(outs) = 0").select("key", F.array_sort("types").alias("types"))
    far = known.where("given and size(outs) > 0").select("key", "types", F.explode("outs").alias("out")).join(large(ahead.select(F.col("key").alias("out"), F.col("types").alias("more"))), "out")
    both = far.groupBy("key").agg(F.flatten(F.collect_set(F.array_union("types", "more"))).alias("types"))
    return near.union(both.select("key", F.array_sort(F.array_distinct("types")).alias("types")))


YES_NO = ["liability", "defense", "predicate", "causation", "exemplary_predicate"]
TYPES = [*YES_NO, "damages", "exemplary", "fees", "instruction_only"]


def validate(nodes: DataFrame, predicates: DataFrame, others: DataFrame, parts: DataFrame) -> DataFrame:
    """node, finding: one row for each broken rule.

    nodes: key, part, type, per_party, sourced, and notes if there are any; predicates: node, source, answer, scope,
    and unanimous if any is; others: node, target, kind ('alternative' or 'blocks'); parts: part.
    Notes with 'justified:' allow a liability without damages and an orphan defense.
    """

    def found(rows: DataFrame, key: str, message: Column) -> DataFrame:
        return rows.select(F.col(key).alias("node"), message.alias("finding"))

    known = nodes.select(F.col("key").alias("k"), F.col("type").alias("k_type"), F.col("per_party").alias("k_per_party"))
    p = predicates.join(known, F.col("source") == F.col("k"), "left")
    o = others.join(known, F.col("target") == F.col("k"), "left").join(nodes.select(F.col("key").alias("n"), F.col("type").alias("n_type")), F.col("node") == F.col("n"), "left")
    s = F.lit
    given = lambda df, name, value: df if name in df.columns else df.withColumn(name, value)
    notes = given(nodes, "notes", F.lit("")).withColumn("justified", F.contains(F.lower(F.coalesce("notes", F.lit(""))), F.lit("justified:")))
    typed = notes.select(F.col("key").alias("node"), "type", "justified").distinct()
    p_typed = given(p, "unanimous", F.lit(False)).join(typed, "node")  # of the predicated node: type; of its source: k_type
    alternatives = others.where("kind = 'alternative'")
    ways = predicates.select(F.col("node").alias("src"), F.col("source").alias("dst")).union(alternatives.select("node", "target")).distinct()
    ways = ways.join(nodes.select(F.col("key").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("key").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    rings = cycles(ways).withColumn("node", F.split("path", " -> ")[0])
    liable = spread(turned(ways), nodes.where("type = 'liability'").select(F.col("key").alias("node"), F.lit(True).alias("label"))).select("node")
    fed = p_typed.where("type in ('damages', 'exemplary_predicate', 'fees')").select(F.col("source").alias("node")).union(alternatives.select(F.col("target").alias("node")))
    used = predicates.select(F.col("source").alias("node")).union(others.where("kind = 'blocks'").select("node"))
    unanimous = p_typed.where("k_type = 'exemplary_predicate' and unanimous").select("node")
    on_liability = p_typed.where("k_type = 'liability'").select("node")
    conditional = p.where("answer = 'No' and k is not null").join(predicates.select(F.col("node").alias("source")), "source", "left_semi").join(alternatives.select("node"), "node", "left_anti")
    without = lambda kind, rows: typed.where(F.col("type") == kind).join(rows, "node", "left_anti")
    checks = [
        found(nodes.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key", s("duplicate key")),
        found(nodes.where(~F.col("type").isin(TYPES)), "key", F.concat(s("unknown type "), "type")),
        found(nodes.join(parts, "part", "left_anti"), "key", F.concat(s("part not declared "), "part")),
        found(nodes.where("not sourced and type <> 'instruction_only'"), "key", s("no source")),
        found(p.where("k is null"), "node", F.concat(s("predicated on unknown "), "source")),
        found(p.where(F.col("k").isNotNull() & ~F.col("k_type").isin(YES_NO)), "node", F.concat(s("predicated on a node without yes or no "), "source")),
        found(p.where("k is not null and scope in ('any_party', 'same_party') and not k_per_party"), "node", F.concat(s("scope needs a per-party source "), "source")),
        found(p.where("answer not in ('Yes', 'No')"), "node", F.concat(s("bad answer "), "answer")),
        found(o.where("k is null"), "node", F.concat("kind", s(" unknown "), "target")),
        found(o.where("kind = 'alternative' and k_type <> 'liability'"), "node", F.concat(s("alternative to a node that isn't liability "), "target")),
        found(o.where("kind = 'blocks' and k_type <> 'damages'"), "node", F.concat(s("blocks a node that isn't damages "), "target")),
        found(o.where("kind = 'blocks' and n_type <> 'defense'"), "node", s("only a defense blocks")),
        found(rings, "node", F.concat(s("cycle "), "path")),
        found(without("damages", liable), "node", s("damages without liability in its chain")),
        found(without("liability", fed).where("not justified"), "node", s("liability without damages")),
        found(without("exemplary", unanimous), "node", s("exemplary without a unanimous exemplary predicate")),
        found(without("exemplary_predicate", on_liability), "node", s("exemplary predicate without liability")),
        found(without("defense", used).where("not justified"), "node", s("defense that blocks and predicates nothing")),
        found(conditional, "node", F.concat(s("unreachable if not asked "), "source")),
    ]
    return reduce(DataFrame.unionByName, checks)


def number(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """Stable topological numbers of one small graph: always the earliest declared ready node. Edges: (before, after); those with an end that isn't declared don't count."""
    place = {n: i for i, n in enumerate(nodes)}
    after: dict[str, set[str]] = {n: set() for n in nodes}
    waits = dict.fromkeys(nodes, 0)
    for a, b in edges:
        if a in place and b in place and b not in after[a]:
            after[a].add(b)
            waits[b] += 1
    ready = [i for n, i in place.items() if not waits[n]]
    out: dict[str, int] = {}
    while ready:
        n = nodes[heapq.heappop(ready)]
        out[n] = len(out) + 1
        for b in after[n]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, place[b])
    if len(out) < len(place):
        raise ValueError(f"cycle among {sorted(set(nodes) - out.keys())}")
    return out


def crosscheck(expected: DataFrame, parsed: DataFrame) -> DataFrame:
    """node, status, unexpected: parsed routing triples must be among the expected ones; a node without any is missing."""
    e = expected.groupBy("node").agg(F.array_sort(F.collect_set("route")).alias("want"))
    p = parsed.groupBy("node").agg(F.array_sort(F.collect_set("route")).alias("got"))
    both = e.join(p, "node", "left")
    extra = F.array_except(F.coalesce("got", F.array().cast("array<string>")), "want")
    status = F.when(F.col("got").isNull(), "missing").when(F.size(extra) == 0, "matched").otherwise("mismatch")
    return both.select("node", status.alias("status"), extra.alias("unexpected"))


def numbered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, key, number: ``number`` for every graph of a table at once. nodes: graph, key, pos, and type if there is one: instructions have no number;
    edges: graph, before, after. A graph is small and one task's work."""
    asked = nodes.where("type is null or type <> 'instruction_only'") if "type" in nodes.columns else nodes

    def one(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        got = number(list(n.sort_values("pos")["key"]), list(zip(e["before"], e["after"], strict=True)))
        return pd.DataFrame({"graph": [key[0]] * len(got), "key": list(got), "number": list(got.values())})

    return asked.select("graph", "key", "pos").groupBy("graph").cogroup(edges.select(F.col("graph").alias("_graph"), "before", "after").groupBy("_graph")).applyInPandas(one, "graph long, key string, number int")
