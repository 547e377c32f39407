import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketloom.llm import exact_dedup
from docketloom.llm.common import shared_dir
from tests.llm import samples


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("extra", [False, True])
def test_against_groups(spark, keep, extra):
    docs = samples.table(spark, extra)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    best = max if keep == "largest" else min
    want = []
    for text, ids in groups.items():
        k = best((i for i in ids if i is not None), default=None)
        want += [(i, k, len(ids), i == k, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = exact_dedup.deduplicate(docs, keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "with_digest", lambda docs: docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2(F.substring("text", 1, 1), 256))))
    docs = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "ac"), (4, "x")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.deduplicate(docs).collect()}
    assert got == {(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1)}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_runs_filters_and_lookup(spark, keep):
    path = shared_dir(spark, "t")
    hashed = F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")
    twice = spark.range(1000).select(F.col("id").alias("doc_id"), hashed).unionByName(spark.range(1000).select((F.col("id") + 2000).alias("doc_id"), hashed))
    runs = exact_dedup.ingest(twice, path, keep, limit=100, ranges=7)
    assert runs.select("run").distinct().count() >= 10 and {r.range for r in runs.select("range").collect()} == set(range(7))
    index = exact_dedup.compact(runs, path, keep)
    assert index.count() == 1000 and index.where("n = 2").count() == 1000 and index.where("filter is not null").count() == 7
    for part in index.select("range", "digest").toPandas().groupby("range"):
        assert part[1].digest.is_monotonic_increasing
    new = spark.range(900, 1100).select((F.col("id") + 5000).alias("doc_id"), hashed)
    want = {i: i + 2000 * (keep == "largest") for i in range(900, 1000)}
    assert {r.doc_id - 5000: r.keep_id for r in exact_dedup.lookup(index, new, ranges=7).collect()} == want


def test_merge_probes_the_filter(monkeypatch):
    """Digests that the other piece's filter rules out are never searched there; equal ones keep the better identifier, null the worst."""
    piece = lambda ids: exact_dedup.Piece.sorted(np.array([hashlib.sha256(k.encode()).digest() for k in ids], "S32"), *(np.array(x) for x in zip(*((v is not None, v or 0, 1) for v in ids.values()), strict=True)))
    a, b = piece({"x": 5, "y": None, "z": 9, "w": None}), piece({"x": 3, "y": 4, "q": 1, "w": None})
    probed = []
    monkeypatch.setattr(exact_dedup, "may_hold", lambda f, d, of=exact_dedup.may_hold: probed.append(len(d)) or of(f, d))
    for keep, x in (("largest", 5), ("smallest", 3)):
        m = exact_dedup.merge(a, b, keep)
        got = {d.ljust(32, b"\0"): (i if h else None, n) for d, h, i, n in zip(m.digests.tolist(), m.has, m.ids, m.ns, strict=True)}
        assert got == {hashlib.sha256(k.encode()).digest(): v for k, v in {"x": (x, 2), "y": (4, 2), "z": (9, 1), "q": (1, 1), "w": (None, 2)}.items()}
    assert probed == [4, 4]


def test_empty_table(spark):
    assert exact_dedup.deduplicate(samples.empty(spark)).count() == 0
