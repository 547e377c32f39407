import hashlib
import math
from collections import Counter

import pytest

from docketloom.llm import mixing
from tests.llm import samples


def poisson_inverse(u, mean):
    k, p = 0, math.exp(-mean)
    c = p
    while c <= u:
        k += 1
        p *= mean / k
        c += p
        if k > mean + 10 * math.sqrt(mean) + 30:
            break
    return k


def number(seed, doc_id, j):
    return int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2**52


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("epochs", [0.5, 3.0])
def test_counts(spark, extra, epochs):
    docs = samples.table(spark, extra)
    rows = docs.collect()
    n = Counter(r.source for r in rows)
    w = {s: k**0.7 for s, k in n.items()}
    want = Counter()
    for r in rows:
        mean = epochs * len(rows) * w[r.source] / sum(w.values()) / n[r.source]
        want[r.doc_id] += poisson_inverse(number(29, r.doc_id, 1), mean)
    got = mixing.mix(docs, epochs=epochs)
    assert got.columns == [*docs.columns, "copy", "mix_key"]
    assert Counter(r.doc_id for r in got.collect()) == Counter({k: v for k, v in want.items() if v})


def test_given_weights_and_large_means(spark):
    docs = spark.createDataFrame([(i, "t", "en", "a" if i < 5 else "b", 1) for i in range(1000)], samples.SCHEMA)
    got = Counter(r.source for r in mixing.mix(docs, {"a": 3.0, "b": 1.0}, epochs=4.0).collect())
    assert abs(got["a"] - 3000) < 300 and abs(got["b"] - 1000) < 150
    assert set(Counter(r.source for r in mixing.mix(docs, {"a": 1.0}).collect())) == {"a"}


def test_empty_table(spark):
    assert mixing.mix(samples.empty(spark)).count() == 0
