"""Resolution of cites tier by tier: what one tier accepts leaves, the rest goes on with a note of why it was refused.

Each tier is a function from the cites still open to (accepted, notes): joins on keys, never a scan of all candidates for a cite. Between tiers
the open cites are written out, so a tier costs what is left, and no plan holds those before it.
Names are searched by queries, the distinct (tokens, court) among the open cites, and a query meets only candidates
that share one of its rarest tokens: as ``need`` tokens must be shared, one of the ``n - need + 1`` rarest is. For names of one token the
best candidate of each token and court is found once, so a name that all have pairs nothing.

Tables. cites: cite_id, key (compact address, null: none), family (of its reporter), tokens (of its name), court (null: any), year, database
(an unpublished database's address), decided (date). cache: key, text_id. lookups: key, status, pos, clusters (cand_ids in order). candidates: cand_id, name, keys, families, tokens,
court, year, published, text_id (null: no text). entries: see ``resolve.archive_match``.
Null or empty keys and names find nothing in the tiers that need them. Ties go to published candidates, then the smaller cand_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import address_check
from .resolve import archive_match, identity, lookup_map, other_decision, subsumed
from .staging import large, shared_dir, stage, written

RESULT = "cite_id long, match_id long, identity boolean, note string"
TIERS = ["cache", "lookup", "address", "name in court", "name anywhere", "archive"]


def need(n: Column) -> Column:
    """How many of a name's tokens another must share: two (the one of a single), and half."""
    return F.greatest(F.least(n, F.lit(2)), F.ceil(n / 2)).cast("int")


def from_cache(open_: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An address that was resolved before."""
    texts = cache.where("key is not null and key <> ''").groupBy("key").agg(F.min("text_id").alias("text_id"))
    hits = open_.join(texts, "key").select("cite_id", F.col("text_id").alias("match_id"), F.lit(None).cast("boolean").alias("identity"), F.lit(None).cast("string").alias("note"))
    return hits, refused(open_, hits, "not in the cache")


def refused(open_: DataFrame, hits: DataFrame, note: str | Column) -> DataFrame:
    note = F.lit(note) if isinstance(note, str) else note
    return open_.join(hits.select("cite_id"), "cite_id", "left_anti").select("cite_id", note.alias("note"), F.lit(False).alias("elsewhere"))


def from_lookup(open_: DataFrame, lookups: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clusters of an address that is known: the first with a text whose caption shares a token with the cited name, or can't be compared.

    An address whose captions all differ belongs to another case, and later tiers know that it is ``elsewhere``.
    """
    known = lookup_map(lookups.select("key", "status", "pos", F.col("clusters").alias("value"))).select(F.col("key").alias("l_key"), "status", F.col("value").alias("clusters"))
    asked = open_.join(known, F.col("key") == F.col("l_key"), "left")
    listed = asked.where("status = 200").select("cite_id", "tokens", F.size("clusters").alias("n"), F.posexplode("clusters").alias("at", "cand_id"))
    captions = candidates.where("text_id is not null").select("cand_id", F.col("name").alias("caption"), F.col("tokens").alias("have"))
    tried = listed.join(captions, "cand_id")
    empty = (F.size("tokens") == 0) | (F.size("have") == 0)
    kind = F.when(empty, "nocompare").when(F.arrays_overlap("tokens", "have"), "match").otherwise("mismatch")
    tried = tried.withColumn("kind", kind)
    relaxed = (F.col("kind") == "match") & (F.col("n") == 1) & subsumed(F.col("tokens"), F.col("have"))
    best = tried.where("kind <> 'mismatch'").groupBy("cite_id").agg(F.min_by(F.struct("cand_id", "kind", relaxed.alias("same")), F.struct("at", "cand_id")).alias("b"))
    hits = best.select("cite_id", F.col("b.cand_id").alias("match_id"), F.when(F.col("b.same"), F.lit(True)).alias("identity"), F.when(F.col("b.kind") == "nocompare", "the record could not be compared by name").alias("note"))
    wrong = tried.where("kind = 'mismatch'").groupBy("cite_id").agg(F.min_by("caption", F.struct("at", "cand_id")).alias("caption"))
    rest = asked.join(hits.select("cite_id"), "cite_id", "left_anti").join(wrong, "cite_id", "left")
    note = (
        F.when(F.col("caption").isNotNull(), F.concat(F.lit("the address belongs to a case captioned "), "caption"))
        .when(F.col("status") == 200, "known address without a text")
        .when(F.col("status") == 300, "ambiguous address")
        .when(F.col("status") == 400, "reporter not recognized: a typo?")
        .when(F.col("status").isNotNull(), "address not known")
        .otherwise("address not looked up")
    )
    return hits, rest.select("cite_id", note.alias("note"), F.col("caption").isNotNull().alias("elsewhere"))


def in_court(cite: Column, candidate: Column) -> Column:
    return cite.isNull() | candidate.isNull() | (cite == candidate)


def by_address(open_: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A candidate of the court that lists the address itself."""
    listed = candidates.where("text_id is not null").select("cand_id", F.explode("keys").alias("c_key"), F.col("court").alias("c_court"), (~F.coalesce("published", F.lit(False))).alias("late"))
    first = listed.groupBy("c_key", "c_court").agg(F.min(F.struct("late", F.col("cand_id").alias("id"))).alias("first"))  # a cite meets one candidate a court, however many list the address
    pairs = open_.where("key <> ''").join(large(first), F.col("key") == F.col("c_key")).where(in_court(F.col("court"), F.col("c_court")))
    best = pairs.groupBy("cite_id").agg(F.min("first").alias("first"))
    hits = best.select("cite_id", F.col("first.id").alias("match_id"), F.lit(None).cast("boolean").alias("identity"), F.lit(None).cast("string").alias("note"))
    return hits, refused(open_, hits, "no candidate lists the address")


def name_queries(open_: DataFrame, candidates: DataFrame, courted: bool) -> DataFrame:
    """tokens, court, cand_id: of each distinct name (and court) the candidate that shares most of it."""
    court = F.col("court") if courted else F.lit(None).cast(open_.schema["court"].dataType)
    queries = open_.where("size(tokens) > 0").select(F.array_sort(F.array_distinct("tokens")).alias("q"), court.alias("q_court")).distinct()
    held = candidates.where("text_id is not null and size(tokens) > 0").select("cand_id", F.array_sort(F.array_distinct("tokens")).alias("have"), F.col("court").alias("c_court"), F.coalesce("published", F.lit(False)).alias("published"))
    held = stage(held.groupBy("have", "c_court", "published").agg(F.min("cand_id").alias("cand_id")), "held-names")  # of candidates that are alike in all that counts, the smallest id
    words = held.select("cand_id", "c_court", "published", "have", F.explode("have").alias("token"))
    # one token: the best of each token and court, once
    single = words.groupBy("token", "c_court").agg(F.min(F.struct(~F.col("published"), F.col("cand_id").alias("id"))).alias("best"))
    one = queries.where("size(q) = 1").join(single, F.col("q")[0] == F.col("token")).where(in_court(F.col("q_court"), F.col("c_court")))
    one = one.groupBy("q", "q_court").agg(F.min("best").alias("best")).select("q", "q_court", F.col("best.id").alias("cand_id"))
    # more: those that share one of the rarest
    counts = words.groupBy("token").agg(F.count("*").alias("times"))
    ranked = queries.where("size(q) > 1").select("q", "q_court", F.explode("q").alias("token")).join(counts, "token", "left")
    ranked = ranked.groupBy("q", "q_court").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "token"))).alias("r"))
    keys = ranked.select("q", "q_court", F.explode(F.slice("r", F.lit(1), F.size("q") - need(F.size("q")) + 1)).alias("k")).select("q", "q_court", F.col("k.token").alias("token"))
    shared = F.size(F.array_intersect("q", "have"))
    pairs = keys.join(words, "token").where(in_court(F.col("q_court"), F.col("c_court"))).withColumn("shared", shared).where(F.col("shared") >= need(F.size("q")))
    many = pairs.groupBy("q", "q_court").agg(F.min(F.struct((-F.col("shared")).alias("less"), ~F.col("published"), F.col("cand_id").alias("id"))).alias("best")).select("q", "q_court", F.col("best.id").alias("cand_id"))
    return one.union(many)


def by_name(open_: DataFrame, candidates: DataFrame, courted: bool) -> tuple[DataFrame, DataFrame]:
    """The candidate that shares most of the name, unless year and address show another decision; identity fails where the address contradicts."""
    found = stage(name_queries(open_, candidates, courted), "name-queries")
    court = F.col("court") if courted else F.lit(None).cast(open_.schema["court"].dataType)
    asked = open_.withColumn("q", F.array_sort(F.array_distinct("tokens"))).withColumn("w_court", court)
    # the records of the few names' candidates first, so that cites meet them with their names in one join
    records = found.join(large(candidates.select("cand_id", "name", "keys", "families", F.col("tokens").alias("have"), F.col("year").alias("filed"))), "cand_id")
    told = asked.join(records, ["q"]).where(F.col("w_court").eqNullSafe(F.col("q_court")))
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    told = told.withColumn("address", address_check(filled("key"), filled("family"), F.col("keys"), F.col("families")))
    told = told.withColumn("other", other_decision(F.col("address"), F.coalesce("database", F.lit(False)), F.col("year"), F.col("filed")))
    judged = identity(F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.lit(0), F.col("tokens"), F.col("have"), F.col("address"), F.col("elsewhere"))
    note = F.when(judged["contradicted"], F.concat(F.lit("address contradicted by the record of "), "name")).when(F.col("address") == "not_on_record", "address not on the record")
    hits = told.where("not other").select("cite_id", F.col("cand_id").alias("match_id"), judged["ok"].alias("identity"), note.alias("note"))
    wrong = told.where("other").groupBy("cite_id").agg(F.first(F.concat(F.lit("a decision of "), F.col("filed").cast("string"), F.lit(" shares the name"))).alias("why"))
    rest = open_.join(hits.select("cite_id"), "cite_id", "left_anti").join(wrong, "cite_id", "left")
    default = F.when(F.size("tokens") == 0, "no name to search by").otherwise("no candidate shares enough of the name")
    return hits, rest.select("cite_id", F.coalesce("why", default).alias("note"), F.lit(False).alias("elsewhere"))


def from_archive(open_: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A docket's ruling of the day; it doesn't settle identity where the address belongs elsewhere."""
    hits = archive_match(open_.select("cite_id", F.col("decided").alias("date"), "tokens"), entries).join(open_.select("cite_id", "elsewhere"), "cite_id")
    hits = hits.select("cite_id", F.col("entry_id").alias("match_id"), F.when(F.col("elsewhere"), F.lit(False)).alias("identity"), F.lit(None).cast("string").alias("note"))
    return hits, refused(open_, hits, "no ruling of that day")


def resolve(cites: DataFrame, cache: DataFrame, lookups: DataFrame, candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """cite_id, tier (1 to 6; null: unresolved), match_id, identity, notes: one row a cite, with what each tier said in order."""
    spark, folder = cites.sparkSession, shared_dir(cites.sparkSession, "ladder")
    steps: list[Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = [
        lambda c: from_cache(c, cache),
        lambda c: from_lookup(c, lookups, candidates),
        lambda c: by_address(c, candidates),
        lambda c: by_name(c, candidates, True),
        lambda c: by_name(c, candidates, False),
        lambda c: from_archive(c, entries),
    ]
    open_ = stage(cites.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))).withColumn("elsewhere", F.lit(False)), "open-cites")
    said, accepted = [], []
    for tier, step in enumerate(steps, 1):
        hits, notes = step(open_)
        hits = written(hits.select("cite_id", F.lit(tier).alias("tier"), F.col("match_id").cast("long").alias("match_id"), "identity", "note"), f"{folder}/hits{tier}")
        notes = written(notes.select("cite_id", F.lit(tier).alias("tier"), "note", F.col("elsewhere").alias("_else")), f"{folder}/notes{tier}")
        accepted.append(hits)
        said += [notes.select("cite_id", "tier", "note"), hits.where("note is not null").select("cite_id", "tier", "note")]
        open_ = stage(open_.join(notes.select("cite_id", "_else"), "cite_id").withColumn("elsewhere", F.col("elsewhere") | F.col("_else")).drop("_else"), "open-cites")
    texts = reduce(DataFrame.union, said).groupBy("cite_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tier", "note"))), lambda x: F.concat(F.element_at(F.array(*map(F.lit, TIERS)), x["tier"]), F.lit(": "), x["note"])).alias("notes"))
    found = reduce(DataFrame.union, accepted).select("cite_id", "tier", "match_id", "identity")
    out = cites.select("cite_id").join(found, "cite_id", "left").join(texts, "cite_id", "left")
    return out.select("cite_id", "tier", "match_id", "identity", F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))
