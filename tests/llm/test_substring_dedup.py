import hashlib
import random
import re

import pyarrow as pa
import pytest

from docketloom.llm import queries, substring_dedup
from tests.llm import samples


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = [float("inf") if d is None else d for d, _ in rows]
    first = {}
    for r, words in zip(rank, split, strict=True):
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(r, first.get(w, r))
    out = []
    for (d, _), r, words in zip(rows, rank, split, strict=True):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < r:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_texts(spark, extra):
    docs = samples.table(spark, extra)
    assert got(substring_dedup.remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_documents(spark):
    assert got(queries.op5_substring_dedup(spark, samples.SF)) == brute([(r.doc_id, r.text) for r in samples.documents(spark).collect()], 50)


@pytest.mark.parametrize("window,k", [(50, 14), (12, 4)])
def test_shared_passages(spark, window, k):
    """Passages cut, edited and repeated at random, in documents of random order; some ids tie."""
    rng = random.Random(window)
    pool = [[f"w{rng.randrange(60)}" for _ in range(400)] for _ in range(4)]
    rows = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            i = rng.randrange(len(p))
            words += p[i : i + rng.randrange(10, 200)] + [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 4))]
        rows.append((rng.randrange(50), " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(substring_dedup.remove_repeats(frame, window, k)) == brute(rows, window)


def test_only_verified_spans_go():
    """A span whose words are not those at its source stays, whatever its hash said."""
    text = " ".join(f"w{i}" for i in range(9))
    digest = lambda words: hashlib.sha256(words.encode()).digest()
    spans = [{"start": 0, "end": 2, "digest": digest("w0 w1")}, {"start": 4, "end": 7, "digest": digest("w4 w5 x")}]
    batch = pa.RecordBatch.from_pylist([{"uid": 1, "spans": spans, "text": text}])
    (out,) = substring_dedup._cut(True)([batch])
    assert out.to_pylist() == [{"uid": 1, "n_removed": 2, "kept_sha256": hashlib.sha256(text[6:].encode()).hexdigest(), "kept_text": text[6:]}]
    asked = pa.RecordBatch.from_pylist([{"uid": 5, "wanted_spans": [{"start": 1, "n": 2}, {"start": 8, "n": 2}], "text": text}])
    (found,) = substring_dedup._digests([asked])
    assert [(r["src_start"], r["digest"]) for r in found.to_pylist()] == [(1, digest("w1 w2")), (8, None)]


def test_paths_join_over_single_edges_only(spark):
    rows = [(1, 7, i, 10 * i, (3, 2, 10 * i), out, into) for i, out, into in [(0, True, False), (1, True, True), (2, False, True), (3, True, True), (5, True, True), (6, True, True)]]
    back = spark.createDataFrame(rows, "uid long, rank long, i int, at long, src struct<rank:long,uid:long,at:long>, one_out boolean, one_in boolean")
    got = sorted((r.start, r.end, r.src.at) for r in substring_dedup.compact(back, 14).collect())
    assert got == [(0, 34, 0), (30, 44, 30), (50, 74, 50)]


def test_long_texts(spark):
    """Texts of megabytes, of which a part stands in a smaller document."""
    words = [f"w{i * 7919 % 100_003}" for i in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["a", "b", *words[150_000:350_000], "c"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame).collect()}
    assert out == {1: (400_000, 0), 2: (200_003, 200_000)}


def test_kept_text(spark):
    passage = samples.sentence(60, 5)
    rows = [(1, passage + " first own words"), (2, "second own words " + passage + " tail")]
    out = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), full=True).collect()}
    assert out == {1: None, 2: "second own words tail"}


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(samples.empty(spark)).count() == 0
