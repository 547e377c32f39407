"""Filings: stamps, docket numbers and titles, written out from orders; batch summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filings as L
from .registry import query, table

STAMP = """case o_orderkey % 9 when 0 then concat('RECEIVED NYSCEF: ', date_format(o_orderdate, 'MM/dd/yyyy')) when 1 then concat('Filed ', date_format(o_orderdate, 'MM/dd/yyyy')) when 2 then concat('Filed ', date_format(o_orderdate, 'MM/dd/yy')) when 3 then concat('Document Filed: ', date_format(o_orderdate, 'MM/dd/yyyy'))
    when 4 then concat('FILED: ', date_format(o_orderdate, 'M/d/yyyy')) when 5 then concat('FILED ', date_format(o_orderdate, 'MMMM d, yyyy')) when 6 then concat('Filing Date ', date_format(o_orderdate, 'M/d/yyyy')) when 7 then 'Filed 02/31/2020' else 'no stamp' end"""


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 7 THEN CASE WHEN o_orderkey % 9 = 2 THEN make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) ELSE o_orderdate::DATE END END::VARCHAR AS date,
    CASE o_orderkey % 9 WHEN 0 THEN 'nyscef_received' WHEN 1 THEN 'ecf_filed_4yr' WHEN 2 THEN 'ecf_filed_2yr' WHEN 3 THEN 'pacer_doc_filed' WHEN 4 THEN 'efiletexas_filed' WHEN 5 THEN 'efiletexas_filed_text' WHEN 6 THEN 'generic_filed' END AS source FROM orders""")
def filing_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight stamps but one that the first covers, one day that does not exist, and none."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"concat('Index. ', {STAMP}, ' end')").alias("t"))
    return rows.select("o_orderkey", L.filing_date(F.col("t")).alias("d")).select("o_orderkey", F.col("d.date").cast("string").alias("date"), "d.source")


FILE = """CASE o_orderkey % 7 WHEN 0 THEN '[' || (o_orderkey % 300) || '] x.pdf' WHEN 1 THEN '650123_2020_ACME_v_DOE__ORDER_TO_' || (o_orderkey % 300) || '.pdf' WHEN 2 THEN 'ECF 00' || (o_orderkey % 300 + 1) || ' motion to stay.pdf' WHEN 3 THEN (o_orderkey % 300) || '-2.pdf'
    WHEN 4 THEN 'gov.uscourts.nysd.5.' || (o_orderkey % 300) || '.0.pdf' WHEN 5 THEN 'DC-20-1.pdf' ELSE 'scan.pdf' END"""
WORDS = """CASE o_orderkey % 5 WHEN 0 THEN 'Document ' || (o_custkey % 90) || ' Filed' WHEN 1 THEN 'Doc. No. ' || (o_custkey % 90) ELSE 'text' END || chr(10) || CASE o_orderkey % 8 WHEN 0 THEN 'NOTICE OF  APPEAL.' WHEN 1 THEN 'Affidavit of Service' WHEN 2 THEN 'AMENDED COMPLAINT of Acme LLC' WHEN 3 THEN 'plaintiff''s motion for costs' WHEN 4 THEN 'JUDGMENT and NOTICE OF ENTRY' WHEN 5 THEN 'Affirmation of service. Party served: acme co b. Person served: Roe' ELSE 'letter' END"""


@query(f"""WITH f AS (SELECT o_orderkey, o_custkey, {FILE} AS name FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN o_custkey % 90 WHEN o_orderkey % 7 IN (0, 1, 3, 4) THEN o_orderkey % 300 WHEN o_orderkey % 7 = 2 THEN o_orderkey % 300 + 1 END::INT AS docket,
        CASE o_orderkey % 8 WHEN 0 THEN 'Notice Of Appeal' WHEN 1 THEN 'Affirmation of Service' WHEN 2 THEN 'Amended Complaint Of Acme LLC' WHEN 3 THEN 'Plaintiff''s Motion For Costs' WHEN 4 THEN 'Judgment' WHEN 5 THEN 'Affirmation of Service - Acme CO' ELSE CASE o_orderkey % 7 WHEN 1 THEN 'Order To' WHEN 2 THEN 'Motion To Stay' END END AS title,
        CASE WHEN o_orderkey % 8 = 5 THEN 'high' WHEN o_orderkey % 8 < 5 THEN 'medium' WHEN o_orderkey % 7 = 1 THEN 'low' WHEN o_orderkey % 7 = 2 THEN 'medium' END AS confidence FROM f""")
def filing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docket numbers and titles: the text comes before the file's name."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(FILE).alias("name"), F.expr(WORDS.replace("chr(10)", "'\\n'").replace("''", "\\'")).alias("text"))
    name, text = F.col("name"), F.col("text")
    return rows.select("o_orderkey", L.docket_number(name, text).alias("docket"), L.filing_title(name, text).alias("t")).select("o_orderkey", "docket", "t.title", "t.confidence")


@query("""SELECT o_orderpriority AS batch, count(*) AS n, count(*) FILTER (o_orderkey % 7 = 6) AS unreadable, count(*) FILTER (o_orderkey % 5 < 2) AS with_docket, round(100.0 * count(*) FILTER (o_orderkey % 7 <> 6) / count(*), 1) AS percent FROM orders GROUP BY 1""")
def filing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a batch of filings."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), (F.col("o_orderkey") % 7 == 6).alias("lost"), (F.col("o_orderkey") % 5 < 2).alias("docket"))
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.count_if("lost").alias("unreadable"), F.count_if("docket").alias("with_docket"), F.round(100.0 * F.count_if(~F.col("lost")) / F.count("*"), 1).cast("double").alias("percent"))
