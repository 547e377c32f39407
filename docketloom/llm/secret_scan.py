"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a document is addressed by the SHA-256 of its text. The ledger, a Parquet
table, holds the findings of each (blob, rule version) scanned so far. A scan computes which
pairs are unseen, reads one text for each such blob (equal texts combine on the map side),
applies the unseen rules, appends the findings and joins the ledger back to all paths.

Offsets are code points: the pieces between matches and the matches themselves add up to them.
Edge cases: a null text is the empty blob; a blob without findings is recorded too, so it isn't
scanned again; null and repeated doc_ids keep a row each; texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_sums
from .common import shared_dir

# The patterns of the base kinds.
KEYWORD = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` of a match must have ``least`` characters; a changed rule gets a new version."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = [
    Rule("assign", ASSIGN, group=2, least=12, base=True),
    Rule("access", ACCESS, base=True),
    Rule("hex", HEX, base=True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]

SPAN = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Start and end of the leftmost non-overlapping matches, without those too short."""
    none = F.array().cast(SPAN)
    before = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def placed(x: Column) -> Column:
        """Ends of the hits are running sums of what lies before and in them."""
        ends = running_sums(F.transform(x["hits"], lambda h, i: F.get(x["before"], i) + F.length(h)))
        fits = lambda h: F.length(F.regexp_extract(h, rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)
        found = F.zip_with(x["hits"], ends, lambda h, e: F.when(fits(h), F.struct((e - F.length(h)).cast("int").alias("start"), e.cast("int").alias("end"))))
        return F.filter(found, lambda s: s.isNotNull())

    return F.when(text.rlike(rule.pattern), let(F.struct(hits.alias("hits"), before.alias("before")), placed)).otherwise(none)


LEDGER = f"blob string, rule string, spans {SPAN}"


def scan(docs: DataFrame, ledger: str, rules: list[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``docs`` (doc_id, text); return doc_id and, for each rule, its spans."""
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    seen = spark.read.schema(LEDGER).parquet(ledger)
    versions = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    names = F.array(*(F.lit(r.name) for r in rules))
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    if seen.isEmpty():
        unseen = blobs.withColumn("todo", names)
    else:
        pairs = versions.select("blob").distinct().select("blob", F.explode(names).alias("rule"))
        todo = pairs.join(seen.select("blob", "rule"), ["blob", "rule"], "left_anti").groupBy("blob").agg(F.collect_set("rule").alias("todo"))
        unseen = blobs.join(todo, "blob")
    found = F.array(*(F.when(F.array_contains("todo", r.name), F.struct(F.lit(r.name).alias("rule"), spans(F.col("text"), r).alias("spans"))) for r in rules))
    new = unseen.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("blob", "x.rule", "x.spans")
    new.write.mode("append").option("compression", "zstd").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule").isin([r.name for r in rules]))
    by_kind = [F.first(F.when(F.col("rule") == r.name, F.col("spans")), ignorenulls=True).alias(r.kind) for r in rules]
    return versions.select("doc_id", "blob").join(known.groupBy("blob").agg(*by_kind), "blob")


def listed(rules: list[Rule]) -> Column:
    """kind:start:end of the rules' spans by start, then by the order of kinds, comma-joined."""

    def tagged(k: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    ordered = F.array_sort(F.concat(*(tagged(k, r.kind) for k, r in enumerate(rules))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Counts, the digest of the base spans and all spans of each document."""
    base = [r for r in rules if r.base]
    counts = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in base]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(rules).alias("spans"))


def scan_documents(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """A first scan with a ledger of its own."""
    return report(scan(docs, shared_dir(docs.sparkSession, "secret-ledger"), rules), rules)
