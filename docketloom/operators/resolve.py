"""Resolution of citations against lookups, candidates and archives, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import large

BIN = 512


def lookup_map(entries: DataFrame) -> DataFrame:
    """One entry for each key of ``entries`` (key, status, pos, value): the first with status 200, else the first. Of equal places the greatest status and value, so that the order of rows decides nothing."""
    order = F.struct(F.coalesce(F.col("status") == 200, F.lit(False)), F.bitwise_not("pos"), "status", "value")  # the greatest of them: bits turned round turn the order round
    return entries.where("key is not null and key <> ''").groupBy("key").agg(F.max_by(F.struct("status", "pos", "value"), order).alias("e")).select("key", "e.*")


def contained_cite(cites: DataFrame, listed: DataFrame, width: int = 4) -> DataFrame:
    """cite_id, list_id: the first listed cite (by list_id) that contains a cite's compact key of ``width`` characters or more.

    Keys: (cite_id, key) and (list_id, listed). Listed cites are short: each gives its runs of the lengths that keys have, the first listed cite of
    a run is found before anything is joined, and a key meets but one row, however many listed cites hold it.
    """
    cites = cites.where(F.length("key") >= width)
    sizes = cites.agg(F.array_sort(F.collect_set(F.length("key"))).alias("sizes"))  # one row, of a few numbers
    ends = F.transform("sizes", lambda n: F.when(F.length("listed") >= n, F.transform(F.sequence(F.lit(1), F.length("listed") - n + 1), lambda i: F.substring("listed", i, n))))
    runs = F.array_distinct(F.flatten(F.filter(ends, lambda r: r.isNotNull())))
    pieces = listed.crossJoin(F.broadcast(sizes)).select("list_id", F.explode(runs).alias("key"))
    first = pieces.groupBy("key").agg(F.min("list_id").alias("list_id"))
    return cites.join(large(first), "key").select("cite_id", "list_id")


def choose_candidate(candidates: DataFrame, most: int = 3) -> DataFrame:
    """cite_id, cand_id of the best ranked ``most``: the first whose text has the pincite, else the first with a text. Columns: cite_id, cand_id, rank, has_text, has_pincite."""
    walked = candidates.where(F.col("rank") <= most).where("has_text")
    order = F.struct(~F.coalesce(F.col("has_pincite"), F.lit(False)), "rank", "cand_id")
    return walked.groupBy("cite_id").agg(F.min_by("cand_id", order).alias("cand_id"))


def other_decision(address: Column, database: Column, cited: Column, filed: Column, years: int = 1) -> Column:
    """Whether a candidate that shares the name is another decision: its record lacks the printed address of a published reporter and its year is further off."""
    return F.coalesce((address == "not_on_record") & ~database & (F.abs(cited - filed) > years), F.lit(False))


def subsumed(want: Column, have: Column, least: int = 3) -> Column:
    """Every wanted token equals one of the others or, with ``least`` letters or more, begins one or is begun by one."""
    near = lambda a, b: (a == b) | ((F.length(a) >= least) & F.startswith(b, a)) | ((F.length(b) >= least) & F.startswith(a, b))
    return (F.size(want) > 0) & (F.size(have) > 0) & F.forall(want, lambda w: F.exists(have, lambda h: near(w, h)))


def identity(gate: Column, caption: Column, clusters: Column, want: Column, have: Column, address: Column, elsewhere: Column) -> Column:
    """(ok, contradicted): the gate's answer, false when the address is known to belong elsewhere, true when one cluster matches in caption and tokens."""
    contradicted = F.coalesce((address == "contradicted") | (address.isin("not_on_record", "no_data") & elsewhere), F.lit(False))
    relaxed = F.coalesce((caption == "match") & (clusters == 1) & subsumed(want, have), F.lit(False))
    return F.struct(F.when(contradicted, F.lit(False)).when(relaxed, F.lit(True)).otherwise(gate).alias("ok"), contradicted.alias("contradicted"))


RULING = r"(?i)\b(ORDER|OPINION|MEMORANDUM|RULING)\b"


def archive_match(cites: DataFrame, entries: DataFrame, least: int = 2) -> DataFrame:
    """cite_id, entry_id, score: the docket entry of a day before to a day after the decision that reads like a ruling and holds most name tokens in its slug.

    cites: cite_id, date, tokens; entries: entry_id, filed, description, slug. Days are the join keys; an exact day counts one more; ties go to the smaller id.
    Equal names of one day are looked up once, and of equal slugs of one day only the first can win, so what is compared grows with different texts, not with rows.
    """
    names = cites.select("date", "tokens").where("date is not null and tokens is not null").distinct()
    days = names.select("date", "tokens", F.explode(F.array(F.date_sub("date", 1), F.col("date"), F.date_add("date", 1))).alias("filed"))
    rulings = entries.where(F.col("description").rlike(RULING)).groupBy("filed", F.lower("slug").alias("slug")).agg(F.min("entry_id").alias("entry_id"))
    matched = F.size(F.filter("tokens", lambda t: F.contains("slug", t)))
    scored = days.join(large(rulings), "filed").withColumn("m", matched).where(F.col("m") >= least).withColumn("score", F.col("m") + (F.col("filed") == F.col("date")).cast("int"))
    best = scored.groupBy("date", "tokens").agg(F.max_by(F.struct("entry_id", "score"), F.struct("score", -F.col("entry_id"))).alias("b"))
    return cites.join(large(best), ["date", "tokens"]).select("cite_id", "b.entry_id", "b.score")


def later_history(cited: Column, citing: Column) -> Column:
    """Two shared party tokens, or one where the cited name has but one."""
    return (F.size(cited) > 0) & (F.size(F.array_intersect(cited, citing)) >= F.least(F.greatest(F.size(cited), F.lit(1)), F.lit(2)))


def in_spans(points: DataFrame, spans: DataFrame, by: str, bin_size: int = BIN) -> DataFrame:
    """``points`` (by, at, ...) with each span (by, start, end, ...) that holds them: start <= at < end. Spans are dealt to the bins they cross."""
    crossed = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / bin_size))))
    binned = points.withColumn("_bin", F.floor(F.col("at") / bin_size))
    return binned.join(crossed, [by, "_bin"]).where("start <= at and at < end").drop("_bin")


def with_parent(rows: DataFrame, by: str) -> DataFrame:
    """Rows (by, start, parent_start) with ``parent``, the id of the row that begins at parent_start; null for rows of their own."""
    parents = rows.groupBy(F.col(by), F.col("start").alias("parent_start")).agg(F.min("id").alias("parent"))
    return rows.join(parents, [by, "parent_start"], "left")


def claim_sections(claims: DataFrame, wanted: DataFrame, index: DataFrame) -> DataFrame:
    """claim_id, section_id, found: the sections a claim maps to and those asked for besides, each once, and whether the index has them."""
    asked = claims.select("claim_id", F.explode("sections").alias("section_id")).unionByName(wanted.select("claim_id", "section_id"))
    return asked.where("section_id is not null").distinct().join(index.select("section_id").distinct().withColumn("found", F.lit(True)), "section_id", "left").select("claim_id", "section_id", F.coalesce("found", F.lit(False)).alias("found"))


def authorities(rows: DataFrame) -> DataFrame:
    """Instances (at, cluster_id, cite, name) by authority: the cluster, else the normalized cite, else each on its own. Array ``instances`` in order."""
    key = F.coalesce(F.nullif(F.col("cluster_id").cast("string"), F.lit("")), F.concat(F.lit("cite:"), F.nullif(F.col("cite"), F.lit(""))), F.concat(F.lit("at:"), F.col("at").cast("string")))
    return rows.withColumn("key", key).groupBy("key").agg(F.min_by("name", "at").alias("name"), F.array_sort(F.collect_list("at")).alias("instances"))


def treatment_summary(graded: DataFrame) -> DataFrame:
    """Authorities (key, status, classification, instances) to one row an instance: key, at, part ('flagged', 'not_checked' or 'clean'), classification ('none' if null)."""
    cls = F.coalesce(F.nullif("classification", F.lit("")), F.lit("none"))
    part = F.when(cls.isin("negative", "caution"), "flagged").when(F.col("status") == "not_checked", "not_checked").otherwise("clean")
    return graded.select("key", F.explode("instances").alias("at"), part.alias("part"), cls.alias("classification"))


def top_signals(signals: DataFrame, by: str, most: int = 4) -> DataFrame:
    """The first ``most`` signals of each authority: strong ones first, then by court weight, then as they came (``pos``)."""
    w = Window.partitionBy(by).orderBy(F.col("strong").desc(), F.desc("weight"), "pos")
    return signals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


# Ranks of the parts of a decision; other kinds have rank 3.
PART_RANKS = {
    "010combined": 0, "015unamimous": 1, "020lead": 1, "025plurality": 2, "080onthemerits": 2, "030concurrence": 4, "035concurrenceinpart": 4,
    "040dissent": 5, "050addendum": 6, "060remittitur": 7, "070rehearing": 7, "090onmotiontostrike": 8,
}


def controlling(parts: DataFrame, by: str) -> DataFrame:
    """Of each decision's parts (by, id, kind, length) the one of the least rank, then the longest, then the smallest id: an aggregate, as a decision may have many."""
    ranks = F.create_map(*[F.lit(x) for kv in PART_RANKS.items() for x in kv])
    rank = F.coalesce(F.try_element_at(ranks, F.lower(F.coalesce("kind", F.lit("")))), F.lit(3))
    return parts.groupBy(by).agg(F.min_by("id", F.struct(rank, -F.col("length"), F.col("id"))).alias("id"))


def body_only_names(rows: DataFrame) -> DataFrame:
    """key, name: rows (at, name, url, caption) once for each case: by the last part of the url, else by the name's letters and digits. The caption of the first names it."""
    slug = F.element_at(F.split(F.regexp_replace(F.coalesce("url", F.lit("")), "/+$", ""), "/"), -1)
    key = F.coalesce(F.nullif(slug, F.lit("")), F.regexp_replace(F.lower("name"), "[^a-z0-9]", ""))
    shown = F.coalesce(F.nullif(F.trim("caption"), F.lit("")), F.trim("name"))
    return rows.select(key.alias("key"), "at", shown.alias("name")).groupBy("key").agg(F.min_by("name", "at").alias("name"))


def series_drafts(index: DataFrame, most: int = 40) -> DataFrame:
    """series, title, sections: of each series of instructions the first title and its first ``most`` sections. index: section_id, title, pos."""
    digits = F.regexp_extract("section_id", r"^(?:VF-)?(\d{3,4})", 1)
    series = F.when(digits != "", F.concat(F.substring(digits, F.lit(1), F.length(digits) - 2), F.lit("00")))
    rows = index.where(~F.startswith("section_id", F.lit("VF-"))).withColumn("series", series).where("series is not null")
    first = Window.partitionBy("series").orderBy("pos")
    kept = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    return kept.groupBy("series").agg(F.min_by("title", "pos").alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "section_id"))), lambda x: x["section_id"]).alias("sections"))


def observed_profile(values: DataFrame, by: list[str]) -> DataFrame:
    """For each key the most frequent value that isn't null, the smallest of equals, and its votes. values: by, value."""
    votes = values.where("value is not null").groupBy(*by, "value").agg(F.count("*").alias("votes"))
    best = votes.groupBy(*by).agg(F.max(F.struct("votes")).alias("top"))
    return votes.join(best, by).where("votes = top.votes").groupBy(*by).agg(F.min("value").alias("value"), F.min("votes").alias("votes"))


def ledger_records(messages: DataFrame) -> DataFrame:
    """Validation messages (level, message) as ledger records: the question is what stands before the first colon."""
    return messages.select(F.lit("routing-validate").alias("source"), F.substring_index("message", ":", 1).alias("question"), F.lit("ROUTING").alias("category"), F.when(F.col("level") == "error", "critical").otherwise("review").alias("severity"), F.col("message").alias("finding"))


def routing_sentences(nodes: DataFrame, predicates: DataFrame, others: DataFrame, numbers: DataFrame) -> DataFrame:
    """node, sentence: when a numbered question is to be answered. A blocker, or the node's own logic, joins conditions by AND, else OR.

    nodes: key, logic; predicates: node, source, answer, scope, unanimous, pos; others: node, target, kind, pos (a blocker's node blocks its target); numbers: key, number.
    """
    number = large(numbers.select(F.col("key").alias("source"), F.col("number").alias("n")))
    said = lambda n, answer, unanimous, tail: F.concat(F.lit("you "), unanimous, F.lit("answered “"), answer, F.lit("” to Question No. "), n.cast("string"), tail)
    tail = F.when(F.col("scope") == "any_party", " regarding any party").when(F.col("scope") == "same_party", " regarding a party").otherwise("")
    first = predicates.join(number, "source").select("node", F.lit(0).alias("kind"), "pos", said(F.col("n"), F.col("answer"), F.when(F.col("unanimous"), "unanimously ").otherwise(""), tail).alias("text"), (F.col("scope") == "same_party").alias("per_party"))
    no = lambda rows, kind, end: rows.join(number, "source").select("node", F.lit(kind).alias("kind"), "pos", said(F.col("n"), F.lit("No"), F.lit(""), F.lit(end)).alias("text"), F.lit(False).alias("per_party"))
    blocks = no(others.where("kind = 'blocks'").select(F.col("target").alias("node"), F.col("node").alias("source"), "pos"), 1, "")
    alternatives = no(others.where("kind = 'alternative'").select("node", F.col("target").alias("source"), "pos"), 2, " or did not answer it")
    all_ = first.unionByName(blocks).unionByName(alternatives)
    grouped = all_.groupBy("node").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("kind", "pos", "text"))), lambda x: x["text"]).alias("conditions"), F.bool_or("per_party").alias("per_party"), F.bool_or(F.col("kind") == 1).alias("blocked")
    )
    joined = grouped.join(large(nodes.select(F.col("key").alias("node"), "logic")), "node").join(large(numbers.select(F.col("key").alias("node"), "number")), "node")
    joiner = F.when(F.col("blocked") | (F.col("logic") == "AND"), F.array_join("conditions", " and ")).otherwise(F.array_join("conditions", " or "))
    me = F.concat(F.lit("Question No. "), F.col("number").cast("string"))
    return joined.select("node", F.concat(F.lit("If "), joiner, F.lit(", then answer "), me, F.when(F.col("per_party"), " regarding that party").otherwise(""), F.lit(". Otherwise, do not answer "), me, F.lit(".")).alias("sentence"))
