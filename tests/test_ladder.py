"""The ladder against plain loops."""

import random
from datetime import date, timedelta

from docketloom.operators import ladder

CITE = "cite_id long, key string, family string, tokens array<string>, court string, year int, database boolean, decided date"
CANDIDATE = "cand_id long, name string, keys array<string>, families array<string>, tokens array<string>, court string, year int, published boolean, text_id long"
WORDS = ["acme", "zeta", "roe", "doe", "state", "bank"]


def plain(cite, cache, lookups, candidates, entries):
    """(tier, match, identity, notes) by the rules, one candidate after the other."""
    notes, tokens, elsewhere = [], set(cite["tokens"] or []), False
    if cite["key"] and cite["key"] in cache:
        return 1, cache[cite["key"]], None, notes
    notes.append("cache: not in the cache")
    known = sorted((x for x in lookups if x["key"] == cite["key"] and cite["key"]), key=lambda x: (x["status"] != 200, x["pos"]))
    by_id = {c["cand_id"]: c for c in candidates}
    if not known:
        notes.append("lookup: address not looked up")
    elif known[0]["status"] != 200:
        notes.append("lookup: " + {300: "ambiguous address", 400: "reporter not recognized: a typo?"}.get(known[0]["status"], "address not known"))
    else:
        tried = [by_id[i] for i in known[0]["clusters"] if i in by_id and by_id[i]["text_id"] is not None]
        for c in tried:
            have = set(c["tokens"])
            if not tokens or not have or tokens & have:
                same = bool(tokens & have) and len(known[0]["clusters"]) == 1 and all(any(w == h or (len(w) > 2 and h.startswith(w)) or (len(h) > 2 and w.startswith(h)) for h in have) for w in tokens)
                return 2, c["cand_id"], True if same else None, notes + (["lookup: the record could not be compared by name"] if not tokens or not have else [])
        elsewhere = bool(tried)
        notes.append(f"lookup: the address belongs to a case captioned {tried[0]['name']}" if tried else "lookup: known address without a text")
    fits = lambda c: cite["court"] is None or c["court"] is None or cite["court"] == c["court"]
    order = lambda c: (not c["published"], c["cand_id"])
    texts = [c for c in candidates if c["text_id"] is not None]
    listed = sorted((c for c in texts if cite["key"] and cite["key"] in c["keys"] and fits(c)), key=order)
    if listed:
        return 3, listed[0]["cand_id"], None, notes
    notes.append("address: no candidate lists the address")
    need = max(min(len(tokens), 2), -(-len(tokens) // 2))
    for tier, name in ((4, "name in court"), (5, "name anywhere")):
        near = sorted((c for c in texts if tokens and len(tokens & set(c["tokens"])) >= need and (tier == 5 or fits(c))), key=lambda c: (-len(tokens & set(c["tokens"])), *order(c)))
        if not near:
            notes.append(f"{name}: " + ("no candidate shares enough of the name" if tokens else "no name to search by"))
            continue
        c = near[0]
        kind = "no_data" if not cite["key"] or not cite["family"] or not c["keys"] else "on_record" if cite["key"] in c["keys"] else "contradicted" if cite["family"] in c["families"] else "not_on_record"
        if kind == "not_on_record" and not cite["database"] and abs(c["year"] - cite["year"]) > 1:
            notes.append(f"{name}: a decision of {c['year']} shares the name")
            continue
        bad = kind == "contradicted" or (kind != "on_record" and elsewhere)
        said = f"{name}: address contradicted by the record of {c['name']}" if bad else f"{name}: address not on the record" if kind == "not_on_record" else None
        return tier, c["cand_id"], False if bad else None, notes + ([said] if said else [])
    scored = [(sum(t in e["slug"].lower() for t in cite["tokens"] or []), e["filed"] == cite["decided"], e) for e in entries if abs((e["filed"] - cite["decided"]).days) <= 1 and "order" in e["description"].lower()]
    scored = sorted((x for x in scored if x[0] >= 2), key=lambda x: (-(x[0] + x[1]), x[2]["entry_id"]))
    if scored:
        return 6, scored[0][2]["entry_id"], False if elsewhere else None, notes
    return None, None, None, [*notes, "archive: no ruling of that day"]


def test_against_loops(spark):
    r = random.Random(11)
    key = lambda: r.choice([None, "", *(f"{i}f3d{j}" for i in range(4) for j in range(5))])
    some = lambda: r.sample(WORDS, r.randrange(4))
    day = lambda: date(2020, 1, 1) + timedelta(days=r.randrange(6))
    cites = [{"cite_id": i, "key": key(), "family": r.choice(["f", "us"]), "tokens": r.choice([None, some(), some(), some()]), "court": r.choice([None, "a", "b"]), "year": r.randrange(2000, 2006), "database": r.random() < 0.2, "decided": day()} for i in range(300)]
    candidates = [{"cand_id": i, "name": f"case {i}", "keys": [k for k in [key()] if k], "families": r.choice([["f"], ["us"], []]), "tokens": some(), "court": r.choice([None, "a", "b", "c"]), "year": r.randrange(2000, 2006), "published": r.random() < 0.5, "text_id": r.choice([None, i, i])} for i in range(25)]
    lookups = [{"key": key(), "status": r.choice([200, 200, 300, 400, 404]), "pos": i, "clusters": r.sample(range(30), r.randrange(3))} for i in range(12)]
    cache = {f"3f3d{j}": 1000 + j for j in range(2)}
    entries = [{"entry_id": i, "filed": day(), "description": r.choice(["Order", "letter"]), "slug": "-".join(some())} for i in range(40)]
    rows = lambda xs, schema: spark.createDataFrame([tuple(x.values()) for x in xs], schema)
    out = ladder.resolve(
        rows(cites, CITE), spark.createDataFrame(list(cache.items()), "key string, text_id long"), rows(lookups, "key string, status int, pos long, clusters array<long>"), rows(candidates, CANDIDATE),
        rows(entries, "entry_id long, filed date, description string, slug string"),
    )
    got = {x.cite_id: (x.tier, x.match_id, x.identity, x.notes) for x in out.collect()}
    want = {c["cite_id"]: plain(c, cache, lookups, candidates, entries) for c in cites}
    assert {w[0] for w in want.values()} == {1, 2, 3, 4, 5, 6, None}
    assert got == want


def test_nothing_to_resolve_with(spark):
    none = spark.createDataFrame([], CANDIDATE)
    cites = spark.createDataFrame([(1, None, None, None, None, None, None, None)], CITE)
    out = ladder.resolve(cites, spark.createDataFrame([], "key string, text_id long"), spark.createDataFrame([], "key string, status int, pos long, clusters array<long>"), none, spark.createDataFrame([], "entry_id long, filed date, description string, slug string"))
    rows = out.collect()
    assert [(r.cite_id, r.tier) for r in rows] == [(1, None)] and len(rows[0].notes) == 6
