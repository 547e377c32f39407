import random
import re

import numpy as np
import pytest

from docketloom.llm import ngram_join, queries
from docketloom.llm.components import components
from tests.llm import samples


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Sorted (doc_id, n_shingles, component_id); doc_ids None sort by their string."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    owners = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)
    shared = {}
    for o in owners.values():
        for a in range(len(o)):
            for b in range(a + 1, len(o)):
                shared[o[a], o[b]] = shared.get((o[a], o[b]), 0) + 1
    for (a, b), both in shared.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_texts(spark, extra):
    docs = samples.table(spark, extra)
    assert got(ngram_join.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_documents(spark):
    assert got(queries.op2_ngram_join(spark, samples.SF)) == brute([(r.doc_id, r.text) for r in samples.documents(spark).collect()])


@pytest.mark.parametrize("limit", [2, 32])
def test_edited_copies(spark, limit):
    """Families of edited copies around the threshold, with a passage that all share; groups exceed the limit."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 12, 40, 90, 300]))]
        for _ in range(14):
            words = base[:]
            for _ in range(rng.randrange(0, 1 + len(base) // 14)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                words = words[: max(1, int(len(words) * rng.uniform(0.7, 1)))]
            if family % 2:
                words += passage
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(ngram_join.near_duplicates(frame, group_limit=limit, buckets=3)) == brute(rows)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """2,000 edited copies of one text and its original: the components of all pairs, from far fewer pairs."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = [(0, " ".join(base))]
    for i in range(1, 2001):
        words = base[:]
        for _ in range(rng.randrange(0, 7)):
            at = rng.randrange(len(words))
            words[at : at + 1] = [] if rng.random() < 0.3 else [f"e{rng.randrange(10**7)}"]
        if rng.random() < 0.05:
            words = words[: rng.randrange(20, 90)]
        if rng.random() < 0.1:
            words += [f"t{rng.randrange(12)}" for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(words)))
    sets = [shingle_set(t) for _, t in rows]
    known = {}
    for x in sets:
        for y in x:
            known.setdefault(y, len(known))
    held = np.zeros((len(sets), len(known)), np.float32)
    for i, x in enumerate(sets):
        held[i, [known[y] for y in x]] = 1
    both, size = held @ held.T, np.array([len(x) for x in sets])
    links = 100 * both >= 75 * (size[:, None] + size[None] - both)
    label = np.arange(len(sets))
    while True:
        least = np.where(links, label[None], len(sets)).min(axis=1)
        if (least == label).all():
            break
        label = least
    counts, plain = {}, ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, name: counts.setdefault(name, plain(df, name)) if name not in counts else plain(df, name))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame).collect()} == dict(enumerate(label.tolist()))
    assert len(set(label.tolist())) > 100 and counts["met"].count() < 200_000  # of 2,001,000 pairs


def test_bounds():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, len(a) // 8 + 1))
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 8 + 1)), dtype=np.uint64)])
        differ = len(np.setxor1d(a, b))
        assert ngram_join.hamming(ngram_join.bits_of(a), ngram_join.bits_of(b)) <= differ
        if len(b) and 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b)):
            none = np.empty(0, np.uint64)
            bands = [{j for j in (ngram_join.band_of(len(s)), ngram_join.band_of(len(s)) + 1) if j == ngram_join.band_of(len(s)) or 4 * len(s) >= 3 * 4 ** (j - 1)} for s in (a, b)]
            assert any(np.intersect1d(ngram_join.sketch_keys(a, none, j), ngram_join.sketch_keys(b, none, j)).size for j in bands[0] & bands[1])


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    labels = {r.node: r.label for r in components(links).collect()}
    assert labels == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_empty_table(spark):
    assert ngram_join.near_duplicates(samples.empty(spark)).count() == 0


def test_python_gets_small_batches(spark, monkeypatch):
    """Texts of 15 MB in one part, and pairs of sets, reach Python some megabytes at a time; the session's own bounds come back."""

    def counted(run):
        def held(batches):
            def bounded():
                for batch in batches:
                    if batch.nbytes > 10 << 20:
                        raise ValueError(f"{batch.nbytes} bytes at once")
                    yield batch

            yield from run(bounded())

        return held

    monkeypatch.setattr(ngram_join, "tidy", counted)
    own = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    words = "concat_ws(' ', transform(sequence(1, 1000), i -> concat('w', hash(id % 750, i) % 1000000)))"
    docs = spark.range(1500).coalesce(1).selectExpr("id as doc_id", f"{words} as text")
    rows = ngram_join.near_duplicates(docs)
    assert {k: spark.conf.get(k) for k in own} == own
    assert rows.where("component_id = doc_id % 750 and n_shingles > 900").count() == 1500
