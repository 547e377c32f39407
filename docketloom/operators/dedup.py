"""Repeated lines, doubled text, span and authority deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.arrays import by_row
from .staging import large, stage


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, pos (0-based), line, one row a line."""
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def running_lines(docs: DataFrame, least_length: int = 12, least_count: int = 3) -> DataFrame:
    """doc_id, key, n: normalized lines that repeat inside a document. A document is one row, so its lines are counted inside it, by sorting them."""
    gap = least_count - 1
    keys = F.array_sort(F.filter(F.transform(F.split("text", "\n", -1), N.running_line), lambda k: F.length(k) >= least_length))
    base = docs.select("doc_id", keys.alias("keys")).where(F.size("keys") >= least_count)
    repeated = F.array_distinct(F.filter("keys", lambda k, i: (i >= gap) & (F.col("keys")[F.greatest(i - gap, F.lit(0))] == k)))
    found = base.select("doc_id", "keys", F.explode(repeated).alias("key"))
    return found.select("doc_id", "key", F.size(F.filter("keys", lambda k: k == F.col("key"))).cast("long").alias("n"))


FURNITURE = r"(?i)^(={5,}|<!--.*-->|[\s—-]*\d{1,4}[\s—-]*|[ivxlcdm]{1,7})$"


def strip_furniture(docs: DataFrame, least_length: int = 12, least_count: int = 3) -> DataFrame:
    """doc_id, text, n_dropped: documents without running lines, banners, page marks and bare page numbers.

    A document is one row, so its lines are counted inside the row and nothing is shuffled.
    """
    rows = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("line"), N.running_line(x).alias("key")))
    base = docs.select("doc_id", rows.alias("rows"))
    keys = F.array_sort(F.transform(F.filter("rows", lambda r: F.length(r["key"]) >= least_length), lambda r: r["key"]))
    base = base.withColumn("keys", keys)
    gap = least_count - 1
    repeated = F.array_distinct(F.filter("keys", lambda k, i: (i >= gap) & (F.col("keys")[F.greatest(i - gap, F.lit(0))] == k)))
    base = base.withColumn("repeated", repeated)
    kept = F.filter("rows", lambda r: (F.trim(r["line"]) == "") | ~(F.trim(r["line"]).rlike(FURNITURE) | F.array_contains("repeated", r["key"])))
    return base.select("doc_id", F.array_join(F.transform(kept, lambda r: r["line"]), "\n").alias("text"), (F.size("rows") - F.size(kept)).alias("n_dropped"))


def repeating_zones(zones: DataFrame, share: float = 0.4, floor: int = 3) -> DataFrame:
    """doc, key, n_pages: zone texts on at least ``share`` of the pages that have any (counted as ``floor`` at least)."""
    keyed = zones.select("doc", "page", N.page_number_free(F.col("zone")).alias("key")).where("key <> ''").distinct()
    pages = keyed.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    counts = keyed.groupBy("doc", "key").agg(F.count("*").alias("n_pages"))
    return counts.join(pages, "doc").where(F.col("n_pages") >= F.greatest("pages", F.lit(floor)) * share).select("doc", "key", "n_pages")


def doubled(line: Column) -> Column:
    """Whether a line is the same words twice."""
    return F.transform(F.array(F.split(N.collapse(line), " ")), lambda w: (F.size(w) >= 2) & (F.size(w) % 2 == 0) & (F.slice(w, F.lit(1), F.floor(F.size(w) / 2).cast("int")) == F.slice(w, F.floor(F.size(w) / 2).cast("int") + 1, F.floor(F.size(w) / 2).cast("int"))))[0]


def token_containment(left: DataFrame, right: DataFrame, least: float = 0.62) -> DataFrame:
    """a, b, containment: share of a's token bag in b's, where it is ``least`` or more. Inputs: (id, token, n).

    Equal bags are compared once and their ids joined to the result. Bags are candidates if b has one of a's rarest
    tokens, as many as a can't all miss: rarer ones are taken until more than 1 - ``least`` of a is among them.
    """
    def bags(df: DataFrame) -> DataFrame:
        return df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "n"))).alias("bag"))

    def tokens(df: DataFrame) -> DataFrame:
        return df.select("bag", F.sha2(F.to_json("bag"), 256).alias("key")).distinct().select("key", F.inline("bag"))

    ids = [bags(df).select("id", "bag", F.sha2(F.to_json("bag"), 256).alias("key")) for df in (left, right)]
    a, b = map(tokens, ids)
    size = Window.partitionBy("key")
    common = b.groupBy("token").agg(F.count("*").alias("bags"))
    rare = a.join(common, "token").withColumn("before", F.coalesce(F.sum("n").over(size.orderBy("bags", "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = a.groupBy("key").agg(F.sum("n").alias("size"))
    missing = total.join(a.join(common, "token", "left_anti").groupBy("key").agg(F.sum("n").alias("lost")), "key", "left").select("key", "size", F.coalesce("lost", F.lit(0)).alias("lost"))
    keys = rare.join(missing, "key").where(F.col("before") + F.col("lost") <= F.col("size") * (1 - least) + 1e-9)
    near = keys.select(F.col("key").alias("a_key"), "token").join(b.select(F.col("key").alias("b_key"), "token"), "token").select("a_key", "b_key").distinct()
    both = near.join(a.select(F.col("key").alias("a_key"), "token", F.col("n").alias("a_n")), "a_key").join(b.select(F.col("key").alias("b_key"), "token", F.col("n").alias("b_n")), ["b_key", "token"])
    share = both.groupBy("a_key", "b_key").agg(F.sum(F.least("a_n", "b_n")).alias("both")).join(total.withColumnRenamed("key", "a_key"), "a_key")
    share = share.select("a_key", "b_key", (F.col("both") / F.col("size")).alias("containment")).where(F.col("containment") >= least)
    pairs = share.join(ids[0].select(F.col("id").alias("a"), F.col("key").alias("a_key")), "a_key").join(ids[1].select(F.col("id").alias("b"), F.col("key").alias("b_key")), "b_key")
    return pairs.where("a <> b").select("a", "b", "containment")


def containment_classes(rows: DataFrame, least: float = 0.62) -> DataFrame:
    """a, b, containment, member: ``token_containment`` between classes of equal bags, each named by its least id; and every other id of a class once, as a member
    of it (contained in it whole). Rows: (id, token, n). Copies add a row each, not pairs."""
    bags = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "n"))).alias("bag"))
    members = stage(bags.select("id", F.sha2(F.to_json("bag"), 256).alias("key"), "bag"), "bags")
    classes = stage(members.groupBy("key").agg(F.min("id").alias("class"), F.min_by("bag", "id").alias("bag")), "classes")
    tokens = classes.select(F.col("class").alias("id"), F.inline("bag"))
    pairs = token_containment(tokens, tokens, least).withColumn("member", F.lit(False))
    copies = members.select("id", "key").join(large(classes.select("key", "class")), "key").where("id <> class")
    return pairs.union(copies.select("id", "class", F.lit(1.0), F.lit(True)))


def merge_spans(spans: DataFrame, within: int = 8) -> DataFrame:
    """Spans (doc_id, name, start) without those that start within ``within`` of the last kept one of that name."""
    ordered = spans.groupBy("doc_id", F.lower("name").alias("name")).agg(F.array_sort(F.collect_list("start")).alias("starts"))
    return ordered.select("doc_id", "name", F.explode(by_row(lambda starts: spaced(starts, within), "array<bigint>", F.col("starts"))).alias("start"))


def spaced(starts: list[int], within: int) -> list[int]:
    """Of rising numbers those that are further than ``within`` from the last one taken."""
    out: list[int] = []
    for s in starts:
        if not out or s - out[-1] > within:
            out.append(int(s))
    return out


def first_of(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; the window keeps one row a key before the shuffle is over (group limit)."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def collapse_authorities(rows: DataFrame) -> DataFrame:
    """Per key: the longest name, the first proposition that isn't bare, the first position, the number of instances."""
    return rows.groupBy("key").agg(
        F.max_by("name", F.struct(F.length("name"), -F.col("pos"))).alias("name"),
        F.min_by("proposition", F.when(F.col("proposition").isNotNull() & (F.col("proposition") != ""), F.col("pos"))).alias("proposition"),
        F.min("pos").alias("pos"),
        F.count("*").alias("n"),
    )


def fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


RANGE = 1 << 20


def placed(rows: DataFrame, bucket: Column, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` numbered from 1 in an order whose leading part ``bucket`` is: sums run inside the buckets, and over one number for each bucket. Neither depends on how rows are dealt to tasks."""
    dealt = rows.withColumn("_bucket", bucket)
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inner = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return inner.join(before, "_bucket").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_bucket", "_at", "_before")
