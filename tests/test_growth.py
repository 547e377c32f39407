"""What grows with the input: joins that must not pass through the driver or pair equal rows, and halves rounded as the SQL does."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from docketloom.operators import dedup, resolve
from docketloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_routing_joins_are_not_broadcast_and_texts_are_read_once(spark):
    text = plan(catalogue.QUERIES["routing_roundtrip"](spark, SF))
    assert "BroadcastExchange" not in text and text.count("MapInArrow") == 1


def test_a_contained_cite_meets_one_row(spark):
    r = random.Random(4)
    digits = lambda n: "".join(r.choice("12f") for _ in range(n))
    listed = [(i, digits(r.randrange(12))) for i in range(200)] + [(900, None), (901, "9991f")] + [(1000 + i, "9992f") for i in range(50)]
    cites = [(i, digits(r.randrange(2, 9))) for i in range(300)] + [(500, None), (501, "9992f")]
    got = resolve.contained_cite(spark.createDataFrame(cites, "cite_id long, key string"), spark.createDataFrame(listed, "list_id long, listed string"))
    want = {c: min(hits) for c, k in cites if k and len(k) >= 4 and (hits := [i for i, t in listed if t and k in t])}
    assert {x.cite_id: x.list_id for x in got.collect()} == want and want[501] == 1000
    join = plan(got).index("SortMergeJoin")
    assert "min(list_id" in plan(got)[join:]  # the first listed cite of a run is known before the join


def test_an_archive_with_many_equal_slugs_of_one_day(spark):
    r, day = random.Random(5), dt.date(2020, 3, 1)
    cites = [(i, day + dt.timedelta(r.randrange(3)), r.choice([["ab", "cd"], ["ab", "x"], [], None, ["ab", "ab"]])) for i in range(200)] + [(777, None, ["ab", "cd"])]
    entries = [(i, day + dt.timedelta(r.randrange(5) - 1), r.choice(["Order", "reordered", "an OPINION"]), r.choice(["AB-v-cd", "ab-x", "zz", None])) for i in range(300)]
    df = spark.createDataFrame(cites, "cite_id long, date date, tokens array<string>")
    es = spark.createDataFrame(entries, "entry_id long, filed date, description string, slug string")
    want = {}
    for c, d, tokens in cites:
        found = [(-m - (f == d), e) for e, f, k, s in entries if d and tokens and s and abs((f - d).days) <= 1 and k != "reordered" and (m := sum(t in s.lower() for t in tokens)) >= 2]
        if found:
            want[c] = (min(found)[1], -min(found)[0])
    got = resolve.archive_match(df, es)
    assert {x.cite_id: (x.entry_id, x.score) for x in got.collect()} == want and want
    many = resolve.archive_match(spark.range(40_000).select(F.col("id").alias("cite_id"), F.lit(day).alias("date"), F.array(F.lit("ab"), F.lit("cd")).alias("tokens")),
                                 spark.range(40_000).select(F.col("id").alias("entry_id"), F.lit(day).alias("filed"), F.lit("Order").alias("description"), F.lit("AB-v-CD").alias("slug")))
    assert many.groupBy("entry_id", "score").count().collect() == [(0, 3, 40_000)]  # 1,600,000,000 pairs of rows, one of texts


def test_halves_go_to_the_even_offset(spark, tmp_path):
    spark.sql("select 1L as user_id, 5L as event_id, 38.5D as value").write.parquet(str(tmp_path / "events.parquet"))  # 38.5 * 37 = 1424.5
    spark.sql("select 1L as o_custkey, 1L as o_orderkey, 1424D as o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    assert [tuple(x) for x in catalogue.QUERIES["offsets_in_spans"](spark, str(tmp_path)).collect()] == [(5, 1, 1)]


def test_an_address_that_many_candidates_list_meets_one_a_court(spark):
    from docketloom.operators import ladder

    cites = spark.range(20_000).selectExpr("id as cite_id", "concat(id div 20000, 'f3d2') as key", "if(id % 2 = 0, 'a', null) as court")
    listed = spark.range(20_000).selectExpr("id as cand_id", "array(concat(id div 20000, 'f3d2')) as keys", "if(id % 2 = 0, 'b', null) as court", "id % 5 = 4 as published", "id as text_id")
    hits, _ = ladder.by_address(cites, listed)  # 400,000,000 pairs of rows
    assert {tuple(x) for x in hits.groupBy("match_id").count().collect()} == {(9, 10_000), (4, 10_000)}
    assert re.search(r"Aggregate\(keys?=\[c_key", plan(hits).partition("SortMergeJoin")[2])


def test_names_of_alike_candidates_are_held_once(spark):
    from docketloom.operators import ladder

    cites = spark.createDataFrame([(1, ["acme", "zeta"], "a"), (2, ["acme"], None)], "cite_id long, tokens array<string>, court string")
    held = spark.range(30_000).selectExpr("id as cand_id", "if(id % 2 = 0, array('zeta', 'acme'), array('acme', 'zeta')) as tokens", "if(id % 3 = 0, null, 'a') as court", "id % 7 = 6 as published", "id as text_id")
    got = ladder.name_queries(cites, held, True)
    assert {(tuple(x.q), x.q_court, x.cand_id) for x in got.collect()} == {(("acme", "zeta"), "a", 6), (("acme",), None, 6)}
    scans = [f for f in got.inputFiles() if "held-names" in f]
    assert scans and spark.read.parquet(*scans).count() == 4


def test_copies_of_a_bag_are_members_of_its_class(spark):
    words = spark.range(3000).selectExpr("id", "explode(if(id % 3 = 0, array('a', 'b', 'c'), if(id % 3 = 1, array('a', 'b', 'd'), array('x')))) as token", "1L as n")
    got = [tuple(x) for x in dedup.containment_classes(words).collect()]
    assert sorted(x for x in got if not x[3]) == [(0, 1, 2 / 3, False), (1, 0, 2 / 3, False)]  # of 4,998,000 pairs of rows
    assert {x for x in got if x[3]} == {(i, i % 3, 1.0, True) for i in range(3, 3000)} and len(got) == 2999


def test_rounds_of_colours_leave_two_tables(spark, tmp_path, monkeypatch):
    from docketloom.operators import graph

    monkeypatch.setattr(graph, "shared_dir", lambda _, name: f"{tmp_path}/{name}-x")
    edges = spark.createDataFrame([(i, (i + 1) % 9) for i in range(9)], "src long, dst long")
    assert {(x.least.n, x.back.n) for x in graph.least_both_ways(edges).collect()} == {(x, x) for x in range(9)} & {(m, m) for m in [spark.range(9).orderBy(F.xxhash64("id")).first()[0]]}
    assert len(list(tmp_path.glob("colours-x/*"))) == 2  # of six rounds or more


def test_chunk_places_hold_one_text_at_a_time(spark):
    from docketloom.operators import segment

    texts = [(1, "ab\n\n cd \nefgh\né" * 9), (2, None), (3, ""), (4, "x" * 50), (5, " \n a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = [(d, i, s, len(p)) for d, t in texts if t for ps in [segment.paragraph_chunks(t, 12, "\n")] for i, (s, p) in enumerate(zip(segment.part_starts(t, ps), ps, strict=True))]
    assert sorted(map(tuple, segment.chunk_places(docs, 12, "\n").collect())) == want
    text = plan(catalogue.QUERIES["chunk_offsets"](spark, SF))
    assert "MapInArrow" in text and "EvalPython" not in text  # no column of all chunks of a batch


def test_patterns_that_begin_with_a_letter_find_the_same(spark):
    from docketloom.operators import gates

    for pattern, firsts in ((gates.SHEET, "rlatdpq"), (gates.SEARCH_PAGE, "catps"), (gates.DECIDED, "iswjopcamrd")):
        body = pattern.removeprefix("(?i)")[1:-1]
        depth, ways, word = 0, [], ""
        for ch in body:
            depth += (ch == "(") - (ch == ")")
            if ch == "|" and not depth:
                ways, word = [*ways, word], ""
            else:
                word += ch
        heads = [w for way in [*ways, word] for w in (way[1:].split(")")[0].split("|") if way.startswith("(") else [way])]
        assert {h[0].lower() for h in heads} <= set(firsts)
    texts = spark.createDataFrame([("Query  Reports, docket text; LEAD attorney",), ("party information, CALENDARS",), ("x " * 1500 + "IT IS so ordered",), ("",), (None,)], "t string")
    t = F.col("t")
    got = [tuple(x) for x in texts.select(gates.docket_sheet(t), gates.case_search_page(t), gates.archive_acceptable(t, F.lit(True), F.lit(True))).collect()]
    assert got == [(True, False, False), (False, True, False), (False, False, True), (False, False, False), (False, False, False)]


def test_steps_double_from_round_to_round(spark, tmp_path, monkeypatch):
    from docketloom.operators import graph

    monkeypatch.setattr(graph, "shared_dir", lambda _, name: f"{tmp_path}/{name}-{len(list(tmp_path.glob('*')))}")
    r = random.Random(7)
    pairs = [(i, i + 1) for i in range(40)] + [(50 + r.randrange(12), 50 + r.randrange(12)) for _ in range(20)] + [(60, 60), (None, 1), (1, None)]
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    want = set()
    for root in (0, 7, 50, 51):
        seen, front = {root: 0}, [root]
        while front:
            front = [b for a in front for b in after.get(a, ()) if b is not None and seen.setdefault(b, seen[a] + 1) == seen[a] + 1]
        want |= {(root, n, d) for n, d in seen.items()}
    edges, roots = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(0,), (7,), (50,), (51,)], "root long")
    assert {tuple(x) for x in graph.closure(edges, roots, None).collect()} == want
    assert len(list(tmp_path.glob("*/*"))) <= 9  # one table a step before: 42
    monkeypatch.setattr(graph, "STRIDE_ROWS", 0)  # doublings that outgrow the edges are left out
    monkeypatch.setattr(graph, "STRIDE_SHARE", 1.3)
    assert graph.strides(edges)[1] == 2
    assert {tuple(x) for x in graph.closure(edges, roots, None).collect()} == want


def test_dear_work_is_dealt_out(spark, monkeypatch):
    from docketloom.operators import staging

    for name in ("style_issues", "bare_sentences", "proposition_review", "citation_propositions", "quote_best_ratio", "style_runs"):
        assert "REPARTITION_BY_NUM" in plan(catalogue.QUERIES[name](spark, SF)), name  # one row group was one task
    monkeypatch.setattr(staging, "PART_ROWS", 100)
    runs = catalogue.QUERIES["style_runs"](spark, SF)
    assert plan(runs).count("Exchange") == 1 and runs.rdd.getNumPartitions() == 61  # 6,000 lines


def test_style_checks_are_compiled(spark):
    from docketloom.functions import style

    text = spark.createDataFrame([("12-345-67, 123-45-6, 316-17, 316-175, 1234-5",), (None,)], "t string").select(style.issues(F.col("t")).alias("x"))
    assert [[tuple(i) for i in r.x] if r.x is not None else None for r in text.collect()] == [[("truncated_page_range", "123-45"), ("truncated_page_range", "316-17")], None]
    assert "lambda" not in plan(text)


def test_words_are_not_gathered_to_be_counted(spark):
    from docketloom.operators import gates

    texts = [("see the rule of law applied xsee",), ("see also generally the rule law",), ("see the rule LAW applied",), ("a_b cd (ef (gh)) see",), ("ab seen cD",), ("",), (None,)]
    got = spark.createDataFrame(texts, "t string").select(gates.bare_proposition(F.col("t")), gates.citation_sentence(F.col("t")))
    assert [tuple(x) for x in got.collect()] == [(False, False), (True, False), (False, False), (True, True), (True, False), (True, True), (True, True)]
    assert "lambda" not in plan(got)


def test_sentences_do_not_travel(spark):
    from docketloom.operators import gates

    rows = spark.createDataFrame([(1, "A", "Word  of law " * 30), (2, "b", "word of\tlaw " * 30), (3, "B", "short one"), (4, " b", "Short\n one"), (5, "c", None)], "id long, name string, proposition string")
    got = {x.id: x.reasons for x in gates.proposition_review(rows).collect()}
    assert got == {1: ["shared with another authority"], 2: ["starts mid-sentence", "shared with another authority"], 3: ["very short"] + ["starts mid-sentence"], 4: ["very short"], 5: ["not extracted"]}
    assert "sha2" in plan(gates.proposition_review(rows))


def test_candidates_after_the_chosen_are_left_as_they_are(spark):
    assert "lambda" not in plan(catalogue.QUERIES["citation_propositions"](spark, SF))


def test_few_windows_take_the_close_bound(monkeypatch):
    from docketloom.operators import quotes

    r, calls = random.Random(9), []
    hay = "".join(r.choice("etaoin shrdlu") for _ in range(2000))
    needle = hay[700:730] + "xx" + hay[732:760]
    close = quotes.Windows.bound
    monkeypatch.setattr(quotes.Windows, "bound", lambda self, *p: calls.append(p) or close(self, *p))
    ratio, at, width = quotes.best_span(needle, hay)
    assert (at, width) == (700, 60) and ratio > 0.95 and len(calls) < 100  # 278 coarse places and 30 fine ones before
