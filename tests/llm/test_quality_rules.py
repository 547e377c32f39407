import re
from collections import Counter

import numpy as np
import pytest

from docketloom.llm import quality_rules, queries
from tests.llm import samples


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if seen[r] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def check(docs, out):
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    assert not any(r.kept and r.base_failed for r in got)
    return got


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_texts(spark, extra):
    docs = samples.table(spark, extra)
    more = spark.createDataFrame([(90, "a a a a a b a a a"), (91, "x y z x y z\nx y z\nx y z\n \n"), (92, "a b"), (93, "a b c a b c")], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    check(docs, quality_rules.judge(docs, labels))


def test_documents_and_verdict(spark):
    sf = "/root/testdata/sf0.01"
    got = check(samples.documents(spark, sf), queries.op7_quality_rules(spark, sf))
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r.kept for r in got if quality.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in got if quality.get(r.doc_id) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_learned_rules_are_thresholds():
    rows = [(100, 5, 0.4 if i % 4 == 0 else 0.01 * (i % 7), 0, 0, 1, 0, 0, 0, 0, 9, 0 if i % 4 == 0 else 1) for i in range(600)]
    rules = quality_rules.learn(rows)
    assert len(rules) == 1 and rules[0][0].feature == "symbol_ratio" and rules[0][0].above


def test_the_list_decides_on_small_data(spark):
    """On sf0.01 the learned rules, not the base rule alone, tell bad rows from good ones."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stats = quality_rules.statistics(samples.documents(spark, sf))
    rows = quality_rules.labelled_sample(stats, labels)
    rules = quality_rules.learn(rows)
    assert rules and len(rows) < labels.count()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    passed = [(r.kept, quality[r.doc_id]) for r in quality_rules.judge(samples.documents(spark, sf), labels).collect() if r.doc_id in quality and not r.base_failed]
    bad = [kept for kept, q in passed if q == 0]
    assert len(bad) >= 20 and sum(bad) <= 0.1 * len(bad) and all(kept for kept, q in passed if q == 1)


def test_the_verdict_is_the_first_rule_that_holds(spark):
    """The learned list as a column against the list read row by row."""
    rng = np.random.default_rng(2)
    names = quality_rules.FEATURES
    rows = [tuple(float(v) for v in rng.integers(0, 5, len(names))) for _ in range(300)]
    rules = [tuple(quality_rules.Condition(names[int(rng.integers(len(names)))], bool(rng.integers(2)), float(rng.integers(5))) for _ in range(2)) for _ in range(3)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names])
    got = {r.i: r.v for r in frame.select("i", quality_rules.verdict(rules).alias("v")).collect()}

    def keeps(row):
        x = dict(zip(names, row, strict=True))
        return not any(all(x[c.feature] > c.threshold if c.above else x[c.feature] <= c.threshold for c in rule) for rule in rules)

    assert got == {i: keeps(r) for i, r in enumerate(rows)}


def test_search_goes_on_after_a_rule_that_fails():
    """Words of a middling length are bad where rules grow and good where they are judged; upper case marks other bad rows."""
    rows = [(100, 5, 0.0, 0, 0, 1, 0.0, 0, 0.0, 0, 9, 1) for _ in range(300)]
    rows += [(100, 7, 0.0, 0, 0, 1, 0.0, 0, 0.0, 0, 9, 0) for i in range(90)]
    for i in range(90):  # every third of the bad rows is judged on: there the first mark has as many good rows
        rows.append((100, 7 if i % 3 == 2 else 5, 0.0, 0, 0, 1, 0.0, 0, 0.0, 0, 9, 1))
    rows += [(100, 5, 0.0, 0, 0, 1, 0.8, 0, 0.0, 0, 9, 0) for _ in range(30)]
    rules = quality_rules.learn(rows)
    assert [c.feature for rule in rules for c in rule] == ["upper_ratio"]


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(samples.empty(spark), labels).count() == 0
