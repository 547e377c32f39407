"""Entity resolution and coverage: fuzzy best-one joins, tiers, as-of and range joins, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the smaller set; 0 without tokens."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def best_overlap(left: DataFrame, right: DataFrame, least: float = 0.7, others: bool = False) -> DataFrame:
    """left_id, right_id, score: the best partner by token overlap; ties go to the longer name, then the smaller id.

    Inputs: (id, name, tokens). Tokens are the join keys, so only pairs that share one are scored; equal names are
    scored once. With ``others`` both sides are one table and a row is no partner of its own: each name then keeps
    its two best rows, so that one is left for each of its ids.
    """
    keyed = lambda df, p: df.select(F.col("name").alias(f"{p}_name"), "tokens").distinct().select(f"{p}_name", F.size("tokens").alias(f"{p}_n"), F.explode("tokens").alias("token"))
    shared = keyed(left, "left").join(keyed(right, "right"), "token").groupBy("left_name", "right_name", "left_n", "right_n").agg(F.count("*").alias("both"))
    scored = shared.withColumn("score", F.col("both") / F.least("left_n", "right_n")).where(F.col("score") >= least)
    kept = 2 if others else 1
    first = right.select(F.col("id").alias("right_id"), F.col("name").alias("right_name")).withColumn("rn", F.row_number().over(Window.partitionBy("right_name").orderBy("right_id"))).where(F.col("rn") <= kept).drop("rn")
    order = [F.desc("score"), F.desc(F.length("right_name")), F.col("right_id")]
    best = scored.join(first, "right_name").withColumn("rn", F.row_number().over(Window.partitionBy("left_name").orderBy(*order))).where(F.col("rn") <= kept)
    rows = left.select(F.col("id").alias("left_id"), F.col("name").alias("left_name")).join(best, "left_name")
    if others:
        rows = rows.where("left_id <> right_id").withColumn("rn", F.row_number().over(Window.partitionBy("left_id").orderBy(*order)))
    return rows.where("rn = 1").select("left_id", "right_id", "score")


def first_tier(tiers: list[DataFrame], key: str) -> DataFrame:
    """Of several results by key, that of the first tier that has one. Tiers carry equal columns."""
    tagged = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    all_ = reduce(DataFrame.unionByName, tagged)
    return all_.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("tier"))).where("rn = 1").drop("rn")


def coverage_gaps(cited: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: side 'body_only' or 'toa_only'."""
    a = cited.select(key).distinct().join(listed.select(key), key, "left_anti").withColumn("side", F.lit("body_only"))
    return a.unionByName(listed.select(key).distinct().join(cited.select(key), key, "left_anti").withColumn("side", F.lit("toa_only")))


def last_before(rows: DataFrame, by: str, at: str, value: Column, when: Column, name: str, order: list[str] | None = None) -> DataFrame:
    """As-of backward: the last ``value`` of rows where ``when`` holds, at or before each row."""
    w = Window.partitionBy(by).orderBy(at, *(order or [])).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(w))


def next_after(rows: DataFrame, by: str, at: str, value: Column, when: Column, name: str, order: list[str] | None = None) -> DataFrame:
    """As-of forward: the first ``value`` of rows where ``when`` holds, after each row."""
    w = Window.partitionBy(by).orderBy(at, *(order or [])).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.first(F.when(when, value), ignorenulls=True).over(w))


def within(left: DataFrame, right: DataFrame, by: str, reach: int) -> DataFrame:
    """Pairs of rows of one ``by`` whose ``pos`` differ by ``reach`` at most: an equi-join on bins, not a range product."""
    bins = left.withColumn("bin", F.explode(F.array(*(F.floor(F.col("pos") / reach) + d for d in (-1, 0, 1)))))
    other = right.withColumn("bin", F.floor(F.col("pos") / reach)).withColumnsRenamed({"pos": "other_pos", "id": "other_id"})
    return bins.join(other, [by, "bin"]).where(F.abs(F.col("pos") - F.col("other_pos")) <= reach).drop("bin")


def nearest(rows: DataFrame, most: int = 1) -> DataFrame:
    """cite_id, cand_id, pos, exact, want, shared: for each row the few others of its area that can be among its ``most`` best, whichever counts first of address, shared tokens and id.

    rows: id, area, address, tokens. Equal names are scored once: areas' distinct names meet by tokens, and each keeps its ``most + 1`` best
    members and partners, as one of them may be the row itself. An address keeps its first ids and its best by name, an area its first ids, for rows that share nothing.
    """
    kept = most + 1
    t = rows.select("id", "area", "address", F.array_sort(F.array_distinct("tokens")).alias("t"))

    def first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
        return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= kept).drop("_rn")

    best = [F.desc("shared"), F.col("cand_id")]
    member = lambda df: df.withColumnRenamed("id", "cand_id")
    # by name
    names = t.select("area", "t").distinct()
    words = names.select("area", "t", F.explode("t").alias("token"))
    met = words.join(words.withColumnRenamed("t", "u"), ["area", "token"]).groupBy("area", "t", "u").agg(F.count("*").alias("shared"))
    members = member(first(t.select("id", "area", "t"), ["area", "t"], [F.col("id")])).withColumnRenamed("t", "u")
    named = first(met.join(members, ["area", "u"]), ["area", "t"], best).select("area", "t", "cand_id")
    # by address
    held = member(first(t, ["area", "address", "t"], [F.col("id")])).withColumnRenamed("t", "u")
    both = t.select("area", "address", "t").distinct().join(held, ["area", "address"]).withColumn("shared", F.size(F.array_intersect("t", "u")))
    alike = first(both, ["area", "address", "t"], best).select("area", "address", "t", "cand_id")
    early = member(first(t, ["area", "address"], [F.col("id")])).select("area", "address", "cand_id")
    fill = member(first(t, ["area"], [F.col("id")])).select("area", "cand_id")
    pairs = [t.join(x, [c for c in x.columns if c != "cand_id"]).select("id", "address", "t", "cand_id") for x in (named, alike, early, fill)]
    pairs = reduce(DataFrame.union, pairs).where("id <> cand_id").dropDuplicates(["id", "cand_id"])
    other = t.select(F.col("id").alias("cand_id"), F.col("address").alias("a"), F.col("t").alias("u"))
    told = pairs.join(other, "cand_id")
    return told.select(F.col("id").alias("cite_id"), "cand_id", F.col("cand_id").alias("pos"), F.coalesce(F.col("address") == F.col("a"), F.lit(False)).alias("exact"), F.size("t").alias("want"), F.size(F.array_intersect("t", "u")).alias("shared"))


def pick(candidates: DataFrame) -> DataFrame:
    """cite_id, cand_id: an exact cite first; else two shared tokens (all of one) over half of the name; else none.

    Input: cite_id, cand_id, pos, exact, want (size of the cited token set), shared.
    """
    fits = F.col("exact") | ((F.col("shared") >= F.least("want", F.lit(2))) & (F.col("want") > 0) & (2 * F.col("shared") >= F.col("want")))
    order = Window.partitionBy("cite_id").orderBy(F.desc("exact"), F.when(F.col("exact"), F.lit(0)).otherwise(-F.col("shared")), "pos")
    return candidates.where(fits).withColumn("rn", F.row_number().over(order)).where("rn = 1").select("cite_id", "cand_id", "exact")


def address_check(cited: Column, family: Column, record: Column, record_families: Column) -> Column:
    """on_record, contradicted (same reporter, other address), not_on_record or no_data."""
    return (
        F.when((cited == "") | (family == "") | (F.size(record) == 0), "no_data")
        .when(F.array_contains(record, cited), "on_record")
        .when(F.array_contains(record_families, family), "contradicted")
        .otherwise("not_on_record")
    )


def together(text: Column, first: Column, second: Column, reach: int = 60) -> Column:
    """Whether two words stand in a text in this order, within ``reach`` characters from the start of one to the end of the other."""
    whole = lambda w: F.concat(F.lit(r"\b\Q"), w, F.lit(r"\E\b"))
    between = F.lit(reach) - F.length(first) - F.length(second)
    pattern = F.concat(F.lit("(?s)"), whole(first), F.lit(".{0,"), F.greatest(between, F.lit(0)).cast("string"), F.lit("}"), whole(second))
    return F.coalesce((first != "") & (second != "") & (between >= 0) & F.contains(text, second) & F.rlike(text, pattern), F.lit(False))


def identity_gate(text: Column, volume: Column, page: Column, tokens: Column, docket: Column, least: int = 200) -> Column:
    """Whether a text of ``least`` characters is a cite's: its volume and page stand within 60 characters, or two of its name's distinct tokens (of three letters or more) occur,
    or its docket number does, however its parts are joined. Any of a cite's parts may be null or empty; such a part proves nothing. All are of the row, none is constant."""
    low = F.regexp_replace(F.lower(text), r"\s+", " ")
    names = F.array_distinct(F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.lower(t)))
    found = F.size(F.filter(names, lambda t: (F.length(t) >= 3) & F.contains(low, t)))
    joined = lambda c: F.regexp_replace(F.lower(c), r"\s*[-–—]\s*", "-")
    number = joined(docket)
    docketed = (F.length(number) >= 6) & F.contains(joined(low), number)
    yes = together(low, F.lower(volume), F.lower(page)) | (found >= 2) | F.coalesce(docketed, F.lit(False))
    return F.coalesce(F.length(text) >= least, F.lit(False)) & F.coalesce(yes, F.lit(False))
