"""Routing read back; chunks by tokens."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docketloom.operators import resolve, routing, segment


def test_instructions():
    text = """QUESTION NO. 12 Did he fail?
    If you answered “Yes” to Question No. 1
    or you unanimously answered "No" to Question No. 2 regarding any party, then answer the following question. Otherwise, do not answer it.
    QUESTION NO. 13 How much?  GRANTED: If your unanimous answer to question 2 is no, then answer question 7.
    If so, see below. If you answered 'Yes' to Question No. 3, then answer the following questions. If it rained, then answer Question No. 5.
    If you answered “Yes” to Question No. 4 QUESTION NO. 3 x, then answer Question No. 9. If you answered “Yes” to Question No. 4, then answer the following question."""
    got = [(t, k, c) for _, t, k, c in routing.instructions(text)]
    assert got == [(2, "following", [(1, "Yes", False), (2, "No", True)]), (7, "numbered", [(2, "No", True)]), (None, "group", [(3, "Yes", False)]), (None, "lost", [(4, "Yes", False)])]
    assert routing.instructions("") == []


def test_round_trip_on_random_maps(spark):
    r = random.Random(5)
    nodes, predicates, others, want = [], [], [], {}
    for doc in range(25):
        n = r.randrange(2, 9)
        keys = [doc * 100 + i for i in range(n)]
        nodes += [(doc, k, r.choice(["AND", "OR"]), i + 1) for i, k in enumerate(keys)]
        for i in range(1, n):
            for s in sorted(r.sample(range(i), r.randrange(0, min(i, 3) + 1))):
                predicates.append((doc, keys[i], keys[s], r.choice(["Yes", "No"]), r.choice(["all", "any_party", "same_party"]), r.random() < 0.3, len(predicates)))
                want.setdefault((doc, i + 1), set()).add((s + 1, predicates[-1][3], predicates[-1][5]))
            if r.random() < 0.3:
                s, kind = r.randrange(i), r.choice(["blocks", "alternative"])
                others.append((doc, keys[s], keys[i], kind, len(others)) if kind == "blocks" else (doc, keys[i], keys[s], kind, len(others)))
                want.setdefault((doc, i + 1), set()).add((s + 1, "No", False))
    n = spark.createDataFrame(nodes, "doc_id long, key long, logic string, number int")
    p = spark.createDataFrame(predicates, "doc_id long, node long, source long, answer string, scope string, unanimous boolean, pos int")
    o = spark.createDataFrame(others, "doc_id long, node long, target long, kind string, pos int")
    numbers = n.select("key", "number")
    said = {x.node: x.sentence for x in resolve.routing_sentences(n, p, o, numbers).collect()}
    docs = [(d, "\n".join(f"{said.get(k, '')}\nQUESTION NO. {i} What?" for doc, k, _, i in nodes if doc == d)) for d in range(25)]
    found = routing.routes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(x.doc_id, x.target): {tuple(c) for c in x.conditions} for x in found.collect()} == want
    checked = routing.checked(found, routing.expected(p, o, n.select("doc_id", "key", "number"))).collect()
    assert len(checked) == len(want) and {x.status for x in checked} == {"matched"}


def test_statuses(spark):
    text = "If you answered “No” to Question No. 1, then answer Question No. 2. If you answered it, then answer Question No. 3. If you answered “Yes” to Question No. 1, then answer Question No. 9."
    found = routing.routes(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    want = spark.createDataFrame([(1, 2, [(1, "Yes", False)]), (1, 3, [(1, "Yes", False)]), (1, 4, [(1, "Yes", False)])], f"doc_id long, target int, want {routing.ROUTE}")
    got = {x.target: (x.status, len(x.unexpected)) for x in routing.checked(found, want).collect()}
    assert got == {2: ("mismatch", 1), 3: ("unparsed", 0), 9: ("unmapped", 0), 4: ("missing", 0)}


@pytest.mark.parametrize("seed", range(4))
def test_chunks_are_the_text(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word", " ", ". ", "\n", "\n\n", ", ", "; ", "é", "日本", "x" * 30, "!", "“a” "]) for _ in range(3000))
    for budget in (1, 2, 7, 50, 10_000):
        spans = segment.token_chunks(text, budget)
        assert "".join(text[a:b] for a, b in spans) == text and all(a < b for a, b in spans)
        assert all(len(segment.TOKEN.findall(text[a:b])) <= budget for a, b in spans)


def test_chunks_end_at_the_strongest_boundary():
    text = "One two. Three four, five six.\n\nSeven eight nine ten. Eleven"
    assert [text[a:b] for a, b in segment.token_chunks(text, 12)] == ["One two. Three four, five six.\n\n", "Seven eight nine ten. Eleven"]
    assert segment.token_chunks("", 5) == [] and segment.token_chunks("ab", 0) == [(0, 2)]
    assert segment.token_chunks("abcdef", 2, lambda t: range(0, len(t))) == [(0, 2), (2, 4), (4, 6)]


def test_packing_takes_linear_time(spark):
    began = time.time()
    text = "a line of words\n\n" * 260_000  # over 4 MB
    assert "\n\n".join(segment.paragraph_chunks(text, 800)) == text.rstrip("\n")
    parts = segment.paragraph_chunks(text, 20)
    assert len(parts) > 100_000 and segment.part_starts(text, parts)[-1] > 4_000_000
    assert segment.token_chunks(text, 100)[-1][1] == len(text) and segment.batch_numbers(["k"] * 500_000, 250, 64_000)[-1] == 1999
    assert time.time() - began < 60
    df = spark.createDataFrame([("a\n\nb", ["a", "b"]), (None, None)], "t string, k array<string>")
    got = df.select(segment.chunks(F.col("t"), 3).alias("c"), segment.offsets(F.col("t"), F.col("k")).alias("o"), segment.batches(F.col("k"), 1).alias("b")).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], [0, 3], [0, 1]), (None, None, None)]
