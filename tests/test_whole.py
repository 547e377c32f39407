"""Operators over whole inputs, against brute force on small tables."""

import itertools
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docketloom.functions import normalize
from docketloom.operators import dedup, graph, match, quotes
from docketloom.plans import catalogue, text_queries

SF = "/root/testdata/sf0.001"


def test_identity_gate_reads_the_whole_text(spark):
    x = "x " * 3500
    rows = [
        (1, x + "12 F.3d 345", True), (2, "x " * 200 + "the y der", True), (3, x + "the y the", False), (4, "the 12 der 345", False), (5, x + "12" + " y" * 31 + " 345", False),
        (6, x + "112 F.3d 345", False), (7, x + "345 and 12", False), (8, x + "No. 05 - 24-00053 -CV.", True), (9, x + "05-24-00054-CV", False), (10, None, False), (11, x + "12" + " y" * 26 + " 345", True),
    ]
    df = spark.createDataFrame(rows, "id long, text string, want boolean")
    gate = match.identity_gate(F.col("text"), F.lit("12"), F.lit("345"), F.array(F.lit("The"), F.lit("der"), F.lit("the"), F.lit("x")), F.lit("05-24-00053-CV"))
    assert {r.id: r.ok for r in df.select("id", gate.alias("ok")).collect()} == {r[0]: r[2] for r in rows}
    none = match.identity_gate(F.col("text"), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("array<string>"), F.lit(None).cast("string"))
    assert {r.ok for r in df.select(none.alias("ok")).collect()} == {False}


def test_nearest_by_definition(spark):
    r = random.Random(9)
    rows = [(i, r.choice("AB"), r.choice([None, 1, 2, 3]), r.sample("abcdef", r.randrange(4))) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, area string, address int, tokens array<string>")
    for most in (1, 3):
        got = {}
        for x in match.nearest(df, most).collect():
            got.setdefault(x.cite_id, []).append((not x.exact, -x.shared, x.cand_id))
        for i, area, address, t in rows:
            want = sorted((not (address is not None and address == b), -len(set(t) & set(u)), j) for j, other, b, u in rows if other == area and j != i)
            assert sorted(got[i])[:most] == want[:most]
            firsts = lambda found: min((j for miss, _, j in found if not miss), default=None)
            assert firsts(got[i]) == firsts(want)


@pytest.mark.parametrize("least", [0.3, 0.62, 1.0])
def test_containment_of_every_bag(spark, least):
    words = "a b c d e f".split()
    bags = {i: Counter(words[(i * k + k * k) % 6] for k in range(1, 2 + i % 5)) for i in range(60)}
    rows = [(i, t, n) for i, bag in bags.items() for t, n in bag.items()]
    df = spark.createDataFrame(rows, "id long, token string, n long")
    got = {(r.a, r.b): r.containment for r in dedup.token_containment(df, df, least).collect()}
    want = {(a, b): c for a, b in itertools.permutations(bags, 2) if (c := (bags[a] & bags[b]).total() / bags[a].total()) >= least}
    assert got == want


def test_containment_with_tokens_of_one_side(spark):
    left = spark.createDataFrame([(1, "x", 3), (1, "y", 5), (2, "x", 5), (2, "y", 3)], "id long, token string, n long")
    right = spark.createDataFrame([(9, "y", 7)], "id long, token string, n long")
    assert [tuple(r) for r in dedup.token_containment(left, right).collect()] == [(1, 9, 0.625)]


def test_token_containment_query_has_every_part(spark):
    parts = {r.p_partkey: Counter((r.p_name + " " + r.p_type).lower().split()) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    want = {(a, b): c for a, b in itertools.permutations(parts, 2) if (c := (parts[a] & parts[b]).total() / parts[a].total()) >= 0.62}
    got = catalogue.QUERIES["token_containment"](spark, SF).collect()
    classes = dict.fromkeys(parts) | {i: i for i in parts} | {r.a: r.b for r in got if r.member}
    assert all(classes[i] == min(j for j in parts if parts[j] == parts[i]) for i in parts)
    shown = {(r.a, r.b): r.containment for r in got if not r.member}
    assert {(a, b): 1.0 if classes[a] == classes[b] else shown.get((classes[a], classes[b])) for a, b in want} == want
    assert {k for k in want if k[0] == classes[k[0]] and k[1] == classes[k[1]]} == shown.keys() and len(got) == len(shown) + sum(classes[i] != i for i in parts)


def parts_of(spark):
    return spark.read.parquet(f"{SF}/part.parquet").collect()


def test_every_part_gets_its_best_match(spark):
    tokens = {r.p_partkey: (f"{r.p_name} {r.p_type}", set((r.p_name + " " + r.p_type).lower().split())) for r in parts_of(spark)}
    want = {}
    for a, (_, t) in tokens.items():
        scores = [(-len(t & u) / min(len(t), len(u)), -len(name), b) for b, (name, u) in tokens.items() if b != a]
        if -min(scores)[0] >= 0.7:
            want[a] = (min(scores)[2], -min(scores)[0])
    got = catalogue.QUERIES["toa_best_match"](spark, SF).collect()
    assert {r.left_id: (r.right_id, r.score) for r in got} == want and len(got) == len(want)


def test_best_match_of_two_tables(spark):
    row = "id long, name string, tokens array<string>"
    left = spark.createDataFrame([(1, "a b", ["a", "b"]), (2, "q", ["q"]), (3, "a b", ["a", "b"])], row)
    right = spark.createDataFrame([(1, "a b", ["a", "b"]), (7, "a b c", ["a", "b", "c"]), (5, "a b d", ["a", "b", "d"])], row)
    assert {(r.left_id, r.right_id) for r in match.best_overlap(left, right).collect()} == {(1, 5), (3, 5)}
    assert {(r.left_id, r.right_id) for r in match.best_overlap(right, right, others=True).collect()} == {(1, 5), (7, 1), (5, 1)}


@pytest.mark.parametrize("name", ["pick_candidate", "rank_candidates"])
def test_every_part_gets_its_candidates(spark, name):
    parts, want = parts_of(spark), set()
    for c in parts:
        found = []
        for s in parts:
            if s.p_partkey != c.p_partkey and s.p_brand == c.p_brand:
                t = set(c.p_type.split(" "))
                found.append((s.p_size != c.p_size, len(t & set(s.p_type.split(" "))), len(t), s.p_partkey))
        if name == "rank_candidates":
            want |= {(c.p_partkey, x[3], i + 1) for i, x in enumerate(sorted(found, key=lambda x: (x[0], -x[1], x[3]))[:3])}
        elif fits := [x for x in found if not x[0] or (x[1] >= min(x[2], 2) and 2 * x[1] >= x[2])]:
            best = min(fits, key=lambda x: (x[0], 0 if not x[0] else -x[1], x[3]))
            want.add((c.p_partkey, best[3], not best[0]))
    got = catalogue.QUERIES[name](spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_long_cycles(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)] + [(3, 3), (5, 20), (2, 0)], "src long, dst long")
    ring = " -> ".join(map(str, [*range(12), 0]))
    assert sorted(r.path for r in graph.cycles(edges).collect()) == sorted([ring, "3 -> 3", "0 -> 1 -> 2 -> 0"])


def test_validation_has_all_checks(spark):
    kinds = {"l1": "liability", "l2": "liability", "l3": "liability", "d1": "damages", "d2": "damages", "x1": "exemplary", "x2": "exemplary", "xp": "exemplary_predicate", "xq": "exemplary_predicate", "f1": "defense", "f2": "defense", "f3": "defense", "c1": "predicate", "c2": "predicate", "u1": "predicate", "u2": "predicate"}
    notes = {"l3": "Justified: by the tort", "f3": "justified: so pleaded"}
    nodes = spark.createDataFrame([(k, "p", t, False, True, notes.get(k)) for k, t in kinds.items()], "key string, part string, type string, per_party boolean, sourced boolean, notes string")
    rows = [("d1", "c1", "Yes", False), ("c1", "c2", "Yes", False), ("c2", "c1", "Yes", False), ("c2", "l1", "Yes", False), ("d2", "f2", "Yes", False), ("x1", "xp", "Yes", True), ("x2", "xp", "Yes", False), ("xp", "l1", "Yes", False), ("xq", "f2", "Yes", False), ("u1", "c1", "No", False), ("u2", "l1", "No", False)]
    predicates = spark.createDataFrame([(n, s, a, "any", u) for n, s, a, u in rows], "node string, source string, answer string, scope string, unanimous boolean")
    others = spark.createDataFrame([("u2", "l3", "alternative")], "node string, target string, kind string").where("false")
    parts = spark.createDataFrame([("p",)], "part string")
    got = sorted((r.node, r.finding) for r in graph.validate(nodes, predicates, others, parts).collect())
    assert got == sorted([
        ("c1", "cycle c1 -> c2 -> c1"), ("d2", "damages without liability in its chain"), ("l2", "liability without damages"),
        ("x2", "exemplary without a unanimous exemplary predicate"), ("xq", "exemplary predicate without liability"),
        ("f1", "defense that blocks and predicates nothing"), ("u1", "unreachable if not asked c1"),
    ])


def test_altered_passages_are_graded(spark):
    passage = "the court may correct only clerical errors in the judgment, after its plenary power has ended"
    around = "zzz yyy xxx www " * 6
    docs = {
        1: passage,  # exact: not for this step
        2: passage.replace("only", "some"),
        3: passage.replace("judgment,", "judgment;"),
        4: re.sub(r"\b(\w)\w", r"\1q", passage),  # no whole word is left
        5: "0123456789 " * 20,
    }
    rows = [(i, f"{around}{t} {around}") for i, t in docs.items()]
    frame = spark.createDataFrame([(i, 7, passage, t) for i, t in rows], "doc_id long, item_id long, quote string, text string")
    pairs = quotes.attributed(frame, normalize.haystack, normalize.needle)
    got = {r.doc_id: r for r in pairs.select("*", quotes.grade(F.col("ratio"), F.col("word_ratio"), F.lit(False)).alias("g")).collect()}
    assert {i: r.g for i, r in got.items()} == {2: "CLOSE", 3: "VERBATIM", 4: "CLOSE", 5: "FABRICATED"}
    for i, text in rows:
        if i in got:
            assert got[i].ratio == pytest.approx(plain_span(passage, text)[0])


def plain_span(needle, hay):
    """The search by its definition, every window compared."""
    n, windows = len(needle), []
    ratio = lambda at, width: SequenceMatcher(None, needle, hay[at : at + width], autojunk=False).ratio()
    if len(hay) <= n:
        return ratio(0, n), 0, len(hay)
    apart, best, start, width = max(1, n // 8), 0.0, 0, n
    for at in range(0, len(hay) - n + 1, apart):
        windows.append((ratio(at, n), at))
        if windows[-1][0] > 0.98:
            break
    best = max(r for r, _ in windows)
    start = next(at for r, at in windows if r == best) if best else 0
    fine = [(ratio(at, w), at, w) for at in range(max(0, start - apart), min(len(hay) - 1, start + apart) + 1) for w in (n, n + max(2, n // 10))]
    top = max(r for r, _, _ in fine)
    return next(f for f in fine if f[0] == top) if top > best else (best, start, width)


def test_best_span_is_that_of_all_windows():
    rng = random.Random(6)
    for k in range(150):
        hay = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 200)))
        at = rng.randrange(len(hay))
        needle = "".join(c if rng.random() < 0.8 else rng.choice("abcd") for c in hay[at : at + rng.randrange(1, 40)])
        got = quotes.best_span(needle, hay)
        assert got[0] == pytest.approx(plain_span(needle, hay)[0]) and got[1:] == plain_span(needle, hay)[1:], (needle, hay)
    assert quotes.best_span("", "a") == (0.0, 0, 0) and quotes.best_span("a", "") == (0.0, 0, 0)


def test_short_quotations_stand_anywhere(spark):
    """Of any number and length, inside words too; rows that repeat are found each."""
    docs = [(1, "the quick brown fox"), (2, "a quill"), (3, ""), (4, None), (2, "a quill"), (None, "xqux")]
    items = [(i, q) for i, q in enumerate(["qu", "q", "uick bro", "fox", "l", "zzz", "", "the quick brown fox"])] + [(100 + i, f"none{i}") for i in range(1500)]
    got = quotes.exact(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), normalize.duplicate_fold).collect()
    want = [(d, i, t.index(q)) for d, t in docs if t for i, q in items if q and q in t]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_word_diff():
    assert quotes.word_diff("a b c", "x a b c y") is None and quotes.word_diff("", "a") is None
    assert quotes.word_diff("the court may correct only clerical errors", "so the court can correct errors, we held") == [
        ("brief", "the", False), ("brief", "court", False), ("brief", "may", True), ("brief", "correct", False), ("brief", "only", True), ("brief", "clerical", True), ("brief", "errors", False),
        ("opinion", "the", False), ("opinion", "court", False), ("opinion", "can", True), ("opinion", "correct", False), ("opinion", "errors,", False),
    ]


def test_clean_alterations(spark):
    hay = "the court may correct only clerical errors in the judgment after its plenary power has ended"
    rows = [(1, "the court [can] correct only clerical errors"), (2, "the court may correct ... in the judgment after"), (3, "the court may correct all clerical errors"), (4, "[t]he judge may correct only clerical")]
    got = spark.createDataFrame(rows, "id long, q string").select("id", quotes.clean_alterations(F.col("q"), F.lit(hay)).alias("c")).collect()
    assert {r.id: r.c for r in got} == {1: True, 2: True, 3: False, 4: False}


def test_word_ratio():
    assert quotes.word_ratio("a b, c 1", "a b c") == 1.0 and quotes.word_ratio("a b c d", "a x c d") == 0.75 and quotes.word_ratio("1 2", "a") == 0.0


def test_passages_meet_the_documents_that_alter_them(spark, tmp_path):
    """All documents against all passages: pairs with three words in a row in common, or all words of a shorter passage, but not the whole passage."""
    passages = {1: "the court may correct only clerical errors in the judgment, after its plenary power has ended", 2: "a party who fails to object waives the error", 3: "res judicata", 4: "", 5: None, 6: "none of these words stands anywhere"}
    around = "zzz yyy xxx www " * 5
    said = {
        1: f"{around}{passages[1]} {around}", 2: f"{around}{passages[1].replace('only', 'some')}{around}", 3: f"{around}The Court may amend; a party who fails, to object forfeits. {around}",
        4: f"{around}res, judicata {around}", 5: around, 6: None, 7: "judicata res", None: "waives the error",
    }
    words = lambda t: re.sub(r"[^\w\s]", "", (t or "").lower()).split()
    runs = lambda t, k: {tuple(words(t)[i : i + k]) for i in range(len(words(t)) - k + 1)}
    want = {}
    for i, p in passages.items():
        k = min(3, len(words(p)))
        for d, t in said.items():
            if k and runs(p, k) & runs(t, k) and p.lower() not in (t or "").lower():
                want[d, i] = round(plain_span(p, " ".join((t or "").lower().split()))[0], 2)
    assert set(want) == {(2, 1), (3, 1), (3, 2), (4, 3), (None, 2)}
    spark.createDataFrame(list(said.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(passages.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in text_queries.quote_best_ratio(spark, str(tmp_path)).collect()]
    assert sorted(((d, i, s) for d, i, s, _ in got), key=str) == sorted(((d, i, s) for (d, i), s in want.items()), key=str)
    assert {(d, i): r for d, i, _, r in got}[2, 1] == "CLOSE"


def test_matched_characters_are_those_of_the_blocks():
    r = random.Random(5)
    for n, letters in [(0, "a"), (1, "ab"), (12, "ab"), (40, "abc "), (150, "etaoin shrdlu")] * 40:
        a, b = ("".join(r.choice(letters) for _ in range(r.randrange(n + 1))) for _ in range(2))
        b = r.choice([b, a[: len(a) // 2] + b, b + a[len(a) // 3 :], a])
        assert quotes.matched(a, b) == sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
