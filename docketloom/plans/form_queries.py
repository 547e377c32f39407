"""Normal forms, reports, ledgers and state over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as A
from ..functions import normalize as N
from ..operators import graph as R
from ..operators import ledger as G
from .registry import query, table, texts

ODD = "concat(substr(text, 1, 60), ' “[T]he [sic] rule… of... law” — O0 1 rnodern *12 [345] it''s', doc_id)"
DUCK_ODD = "substr(text, 1, 60) || ' “[T]he [sic] rule… of... law” — O0 1 rnodern *12 [345] it''s' || doc_id"


@query(f"""WITH d AS (SELECT doc_id, translate({DUCK_ODD}, '“”„‘’‚`´—–−‒', '\"\"\"''''''''''----') AS f FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents))
    SELECT doc_id, trim(regexp_replace(lower(f), '[^a-z0-9]+', ' ', 'g'), ' ') AS alnum, regexp_replace(regexp_replace(f, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS folded FROM d""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded and letters-and-digits forms of texts with typographic marks."""
    rows = texts(spark, sf_dir).select("doc_id", N.fold(F.expr(ODD.replace("it''s", "it\\'s"))).alias("f"))
    return rows.select("doc_id", F.trim(F.regexp_replace(F.lower("f"), "[^a-z0-9]+", " ")).alias("alnum"), N.collapse(F.col("f")).alias("folded"))


@query("SELECT p_partkey, p_type || ' Corp. & Ltd.' AS name, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_type || ' Corp. & Ltd.'), '\\bcorp\\b', 'corporation', 'g'), '\\bltd\\b', 'limited', 'g'), '\\s+', ' ', 'g')) AS expanded FROM part")
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations of a name written out by a dictionary."""
    name = F.concat("p_type", F.lit(" Corp. & Ltd."))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), N.collapse(N.expand(F.lower(name), {"corp": "corporation", "ltd": "limited"})).alias("expanded"))


LEAD = "CASE doc_id % 5 WHEN 0 THEN 'See, e.g., ' WHEN 1 THEN '*12 ' WHEN 2 THEN 'IV. ' WHEN 3 THEN 'But see ' ELSE '' END"


@query(f"""WITH d AS (SELECT doc_id, regexp_replace({LEAD} || 'Xa' || substr(text, 1, 30), '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)),
    a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(s, '(?i)^(see|see also|cf\\.|accord|but see|see, e\\.g\\.,)\\s+', ''), '^\\[?\\*?\\d{{1,4}}\\]?\\s+', ''), '(?i)^[IVX]+\\.\\s+', '') AS s FROM d) SELECT doc_id, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS sentence FROM a""")
def sentence_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("doc_id", F.expr(f"concat({LEAD}, 'Xa', substr(text, 1, 30))").alias("s"))
    return rows.select("doc_id", A.without_lead(F.col("s")).alias("sentence"))


LEDGER = "event_id AS id, 'q' || user_id AS question, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' ELSE 'review' END AS severity, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS disposition"
SPARK_LEDGER = ["event_id as id", "concat('q', user_id) as question", "case event_id % 4 when 0 then 'critical' when 1 then 'major' when 2 then 'minor' else 'review' end as severity", "case event_id % 3 when 0 then 'pending' when 1 then 'accepted' else 'rejected' end as disposition"]


@query(f"""SELECT id, row_number() OVER (PARTITION BY severity ORDER BY question, id) + CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END::BIGINT * 1000000000 AS place FROM (SELECT {LEDGER} FROM events) WHERE disposition IN ('pending', 'accepted') AND severity <> 'minor'""")
def ledger_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by status and severity, in the order of severity, then question."""
    rows = table(spark, sf_dir, "events").selectExpr(*SPARK_LEDGER)
    listed = G.listed(rows, status=["pending", "accepted"], severity=["critical", "major", "review"])
    w = Window.partitionBy("severity").orderBy("question", "id")
    return listed.select("id", (F.row_number().over(w) + G.severity_rank(F.col("severity")) * 1_000_000_000).cast("long").alias("place"))


@query(f"SELECT count(*) FILTER (disposition = 'pending') AS n_open, count(*) FILTER (disposition = 'pending' AND severity = 'critical') AS n_critical, CASE WHEN bool_or(disposition = 'pending' AND severity = 'critical') THEN 2 ELSE 0 END::INT AS code, count(*) FILTER (disposition = 'pending') = 0 AS may_render FROM (SELECT {LEDGER} FROM events)")
def ledger_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a report may be rendered, and the code that a run ends with."""
    return G.gate(table(spark, sf_dir, "events").selectExpr(*SPARK_LEDGER))


@query("""WITH q AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN (SELECT min(p_type) FROM part) WHEN 1 THEN 'STEEL' ELSE 'none of it' END AS want FROM supplier), t AS (SELECT DISTINCT p_type AS term FROM part)
    SELECT s_suppkey, term, 'exact' AS kind FROM q JOIN t ON lower(term) = lower(want) UNION ALL SELECT s_suppkey, term, 'contains' FROM q JOIN t ON contains(lower(term), lower(want)) WHERE lower(want) NOT IN (SELECT lower(term) FROM t)""")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined terms by name, else those that contain the query."""
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("term")).distinct()
    least = part.agg(F.min("term").alias("least"))
    asked = table(spark, sf_dir, "supplier").join(F.broadcast(least)).selectExpr("s_suppkey as asked", "case s_suppkey % 3 when 0 then least when 1 then 'STEEL' else 'none of it' end as want")
    return G.terms(asked, part).select(F.col("asked").alias("s_suppkey"), "term", "kind")


@query("""SELECT o_custkey AS authority, CASE WHEN bool_or(o_orderkey % 11 = 0) THEN 'done' WHEN count(*) < 3 THEN 'not_checked' WHEN bool_and(o_orderstatus = 'F') THEN 'done' ELSE 'listed' END AS status,
    CASE WHEN bool_or(o_orderkey % 11 = 0) THEN 'negative' WHEN count(*) < 3 THEN 'not_checked' WHEN bool_and(o_orderstatus = 'F') THEN 'none' END AS classification FROM orders GROUP BY 1""")
def treatment_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An authority's state from its scans: a negative one ends it, too few are no check, all done without one is clean."""
    scans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("authority"), (F.col("o_orderstatus") == "F").alias("scanned"), (F.col("o_orderkey") % 11 == 0).alias("negative"))
    return G.treatment_states(scans, least=3)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS size FROM documents")
def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory of contents: size in bytes and SHA-256."""
    return G.inventory(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content")))


@query()
def node_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable topological numbers of each region's nations, the earliest declared ready node first; edges go from later to earlier ones whose keys add to a multiple of three."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("graph"), F.concat(F.lit("q"), "n_nationkey").alias("key"), F.col("n_nationkey").cast("long").alias("pos"))
    b = n.select("graph", F.col("key").alias("after"), F.col("pos").alias("pos_b"))
    edges = n.select("graph", F.col("key").alias("before"), "pos").join(b, "graph").where("pos > pos_b and (pos + pos_b) % 3 = 0").select("graph", "before", "after")
    return R.numbered(n, edges)


@query("""SELECT l_returnflag AS verdict, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS percent FROM lineitem GROUP BY 1""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("verdict"))
    return G.counts(rows, "verdict")


@query("""SELECT l_orderkey AS citation, bool_and(l_returnflag <> 'R') AS all_verbatim, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS any_fabricated, count(*) AS n FROM lineitem GROUP BY 1""")
def quote_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a citation's quotations: whether all are verbatim, and whether one is a confirmed fabrication."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as citation", "if(l_returnflag = 'R', 'FABRICATED', 'VERBATIM') as result", "l_linestatus = 'F' as confirmed")
    return G.quote_outcomes(rows, "citation")


@query()
def section_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty sections to look at by hand, the same ones each time."""
    return G.sample(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), 50, seed=3)
