"""Application sentences, contrary signals, aliases and jurisdictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import application as A
from .registry import query, table

SENTENCE = """CASE event_id % 12 WHEN 0 THEN 'Plaintiff has not shown any harm' WHEN 1 THEN 'A Plaintiff must be dismissed' WHEN 2 THEN 'Thus the claim fails here' WHEN 3 THEN 'Here, the court held that the claim fails' WHEN 4 THEN 'Because it lacks standing, any party is barred'
    WHEN 5 THEN 'Because no duty was pleaded, the claim is barred' WHEN 6 THEN 'The rule is as a matter of law settled' WHEN 7 THEN 'The Motion should be denied' WHEN 8 THEN 'the motion standard is settled' WHEN 9 THEN 'Acme waived it' WHEN 10 THEN 'the Defendant in Smith waived it' ELSE '' END
    || CASE WHEN event_id % 5 = 0 THEN ' and reliance on it is misplaced' ELSE '' END"""


@query("""SELECT event_id, event_id % 12 IN (0, 2, 5, 7, 9) AND event_id % 7 <> 0 AS fired, event_id % 5 = 0 AND event_id % 7 <> 0 AS characterization, event_id % 7 = 0 AND (event_id % 12 <> 11 OR event_id % 5 = 0) AS exempt FROM events""")
def application_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences on the case at hand (parties, roles, papers, conclusions) against rules and cited cases; every seventh stands in a parenthetical."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(SENTENCE).alias("s"), F.expr("if(event_id % 7 = 0, 'parenthetical', 'host')").alias("kind"))
    return rows.select("event_id", A.application(F.col("s"), F.col("kind"), F.array(F.lit("Acme"))).alias("a")).select("event_id", "a.*")


BEFORE = """CASE event_id % 8 WHEN 0 THEN 'It is so. But see ' WHEN 1 THEN 'It is so; contra, ' WHEN 2 THEN 'the rule (but cf. ' WHEN 3 THEN 'distinguishing ' WHEN 4 THEN 'It distinguished them. See ' WHEN 5 THEN 'we see ' WHEN 6 THEN '' ELSE 'rejected' || repeat(' x', 40) || ' ' END"""


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'But see' WHEN 1 THEN 'contra' WHEN 2 THEN 'but cf.' WHEN 3 THEN 'distinguishing' ELSE '' END AS signal FROM events")
def adverse_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(BEFORE).alias("b"))
    return rows.select("event_id", A.adverse_signal(F.concat("b", F.lit("5 U.S. 6")), F.length("b")).alias("signal"))


@query("""WITH c AS (SELECT l_orderkey AS doc_id, n_nationkey, l_linenumber AS pos, CASE n_nationkey % 6 WHEN 0 THEN 'US-NY' WHEN 1 THEN 'US-TX' ELSE 'US-FED' END AS code FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 30),
    v AS (SELECT doc_id, code, count(*) AS n, min(pos) AS pos FROM c GROUP BY ALL) SELECT doc_id, first(code ORDER BY n DESC, pos, code) AS jurisdiction FROM v GROUP BY doc_id HAVING count(*) = 1 OR max(n) > 0""")
def document_jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jurisdiction of most courts that an order's lines name; courts that no list knows have no vote."""
    courts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("cast(l_suppkey % 30 as int)").alias("court"), F.col("l_linenumber").alias("pos"))
    known = table(spark, sf_dir, "nation").selectExpr("n_nationkey as court", "case n_nationkey % 6 when 0 then 'US-NY' when 1 then 'US-TX' when 2 then 'US-WA' else 'US-2C' end as code")
    return A.jurisdictions(courts, known)


DEFINED = """concat('Acme (the "Acme', o_custkey % 3, '") and others (collectively, “ACME', o_custkey % 3, '”) under a (hereinafter, "Note ', o_orderkey % 2, '") or ("One Two Three Four Five") ')"""


@query("""WITH a AS (SELECT DISTINCT o_custkey AS doc_id, 'acme' || (o_custkey % 3) AS alias FROM orders UNION SELECT o_custkey, 'note ' || (o_orderkey % 2) FROM orders) SELECT doc_id, alias FROM a""")
def party_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat_ws("", F.collect_list(F.expr(DEFINED))).alias("text"))
    return A.aliases(rows).select("doc_id", F.lower("alias").alias("alias"))


CAPTION = """concat('SUPREME COURT\\n\\nACME', c_custkey % 7, ' CORP. and The Widget', c_custkey % 5, ' Works, Inc., Plaintiffs,\\nv.\\nJohn Doe', c_custkey, ', Defendant.\\n\\nThe sale (the "Buyer', c_custkey % 3, '") and its note (the "Defendant") went to ACME', c_custkey % 7, ' (the "ACME', c_custkey % 7, '").')"""


@query("""WITH a AS (SELECT DISTINCT o_custkey AS c, 'w' || (o_orderkey % 5) AS t FROM orders UNION SELECT o_custkey, 'b' || (o_orderkey % 40) FROM orders),
    n AS (SELECT c_custkey AS c, 0 AS pos, 'ACME' || (c_custkey % 7) AS name, '' AS t FROM customer UNION ALL SELECT c_custkey, 1, 'Widget' || (c_custkey % 5) || ' Works', 'w' || (c_custkey % 5) FROM customer
        UNION ALL SELECT c_custkey, 2, 'John Doe' || c_custkey, '' FROM customer UNION ALL SELECT c_custkey, 3, 'Buyer' || (c_custkey % 3), 'b' || (c_custkey % 3) FROM customer)
    SELECT c AS doc_id, pos, name, EXISTS (SELECT 1 FROM a WHERE a.c = n.c AND a.t = n.t) AS downweighted FROM n""")
def party_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties and aliases of a caption for each customer, against the cases that its orders cite."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(CAPTION).alias("text"))
    cited = F.explode(F.array(F.expr("concat('In re Widget', o_orderkey % 5, ' Works Holdings')"), F.expr("concat('Buyer', o_orderkey % 40, ' v. State')")))
    return A.roster(docs, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), cited.alias("name")))
