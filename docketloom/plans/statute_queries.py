"""Quotations of statutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statutes as S
from .registry import query, table

BEFORE, AFTER = "o_orderkey % 900", "o_custkey % 900"
LEFT = "'Tex. Civ. Prac. & Rem. Code § ' || (o_orderkey % 90 + 10) || '.001'"
RIGHT = "'Texas Tax Code Sec. ' || (o_custkey % 90 + 10) || '.01'"
OWN = "CASE o_orderkey % 4 WHEN 0 THEN ' Tex. Prop. Code § 5.' || (o_orderkey % 7) WHEN 1 THEN ' Tex. Tax Code § ' || (o_custkey % 90 + 10) || '.01' ELSE '' END"
QUOTE = "CASE WHEN o_orderkey % 5 = 0 THEN 'No mark stands here at all' ELSE 'It says “a passage long enough to count ' || o_orderkey || '”' END"


@query(f"""WITH o AS (SELECT o_orderkey AS cite_id, {BEFORE} AS b, {AFTER} AS a, (o_orderkey % 90 + 10) || '.001' AS l, (o_custkey % 90 + 10) || '.01' AS r, length({LEFT}) AS nl, length({RIGHT}) AS nr, o_orderkey % 4 AS k, '5.' || (o_orderkey % 7) AS p FROM orders WHERE o_orderkey % 5 <> 0),
    x AS (SELECT cite_id, 'CP' AS code, l AS section, b + nl AS distance FROM o WHERE b + nl <= 600 UNION ALL SELECT cite_id, 'TX', r, 1 + a FROM o WHERE 1 + a + nr <= 600 AND k <> 1 UNION ALL SELECT cite_id, 'TX', r, 0 FROM o WHERE k = 1 UNION ALL SELECT cite_id, 'PR', p, 0 FROM o WHERE k = 0)
    SELECT cite_id, code, section, distance, row_number() OVER (PARTITION BY cite_id ORDER BY CASE WHEN distance = 0 THEN -1 ELSE distance END, code) - 1 AS rank FROM x""")
def statute_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a brief with a section before and after its citation, more or less far, and in some propositions."""
    sql = lambda e: F.expr(e)
    head = F.concat(sql(LEFT), F.expr(f"repeat('x', cast({BEFORE} as int))"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cite_id"), F.concat(head, F.lit("C"), F.expr(f"repeat('y', cast({AFTER} as int))"), sql(RIGHT)).alias("text"), F.length(head).alias("start"), F.concat(sql(QUOTE), F.lit(" under"), sql(OWN)).alias("proposition"), F.lit("5 S.W.3d 6 (2015)").alias("cite_text"))
    rows = rows.withColumn("doc_id", F.col("cite_id")).withColumn("start", F.col("start").cast("long"))
    return S.targets(rows, rows).select("cite_id", "code", "section", "distance", "rank")


SECTION = "concat('a person of class ', o_custkey, ' must give notice ', o_orderkey, ' to the owner within ten days of the sale')"


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (1, 4) THEN 0 ELSE 1 END::INT AS matched, 1 AS total, CASE WHEN o_orderkey % 6 >= 3 THEN '2019,2021' ELSE '' END AS later FROM orders""")
def statute_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage of a section for each order, against its text: whole with a changed capital, with another word, with ellipses, one of them with words that aren't there."""
    quote = F.expr("""case o_orderkey % 6 when 1 then concat('must give notice ', o_orderkey + 1, ' to the owner') when 2 then concat('A person of class ', o_custkey, ' must give . . . the owner within ten days')
        when 4 then concat('must give notice ', o_orderkey, '…', 'to whom it may concern') else concat('[M]ust give “notice” ', o_orderkey, ' to the  owner within ten days') end""")
    text = F.concat(F.replace(F.expr(SECTION), F.lit("notice"), F.lit('"notice"')), F.lit(" Acts 2001, ch. 1; Acts 2021, ch. 2; Acts 2019"))
    quote = F.when(F.col("o_orderkey") % 6 == 2, quote).otherwise(F.replace(F.replace(quote, F.lit("give notice"), F.lit("give “notice”")), F.lit("““"), F.lit("“")))
    cite = F.expr("if(o_orderkey % 6 >= 3, 'A v. B (Tex. 2015)', 'A v. B (Tex. 2022)')")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.check(F.array(quote), text, cite).alias("c")).select("o_orderkey", "c.matched", "c.total", F.array_join(F.transform("c.later", lambda y: y.cast("string")), ",").alias("later"))
