"""Extraction over texts that are written out from structured columns, as the tables hold no citations of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import citations as C
from ..operators import extract as E
from ..operators import scoring as S
from ..sources import sinks
from .registry import query, table, texts

@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE ELSE o_orderdate::DATE + 1 END::VARCHAR AS date, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 90 + 1) END::INT AS docket,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Affidavit of Service' ELSE 'Order' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM orders""")
def filing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps in the text win over dates in the file's name."""
    name = F.expr("concat(date_format(o_orderdate, 'yyyy.MM.dd'), if(o_orderkey % 3 = 0, concat(' [', o_orderkey % 90 + 1, ']'), ''), ' paper.pdf')")
    text = F.expr("concat(if(o_orderkey % 2 = 0, 'no stamp ', concat('FILED: ', date_format(date_add(to_date(o_orderdate), 1), 'M/d/yyyy'), ' ')), if(o_orderkey % 5 = 0, 'Affidavit of Service of an Order', 'Short form order'))")
    got = table(spark, sf_dir, "orders").select("o_orderkey", E.filing(name, text).alias("f"))
    missing = F.size("f.missing")
    return got.select("o_orderkey", F.col("f.date").cast("string").alias("date"), "f.docket", "f.title", F.when(missing == 0, "high").when(missing == 1, "medium").otherwise("low").alias("confidence"))


@query("""WITH p AS (SELECT source AS doc, doc_id AS page, 'PJC ' || (doc_id % 7) || '.1' || chr(10) || replace(text, chr(10), ' ') AS t FROM documents),
    b AS (SELECT doc, regexp_extract(t, '^PJC\\s+(\\d+\\.\\d+)', 1) AS section, page, length(t) + 1 AS n_chars FROM p)
    SELECT doc, section, page AS start_page, n_chars, n_chars < 200 AS short FROM b QUALIFY row_number() OVER (PARTITION BY doc, section ORDER BY n_chars DESC, page) = 1""")
def library_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.concat(F.lit("PJC "), F.col("doc_id") % 7, F.lit(".1\n"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))
    return E.sections(pages)


@query("SELECT o_orderkey AS old, 'name ' || (o_orderkey % 8000) || CASE WHEN o_orderkey % 11 = 0 THEN '?' ELSE '' END AS new, CASE WHEN o_orderkey % 11 = 0 THEN 'illegal character' WHEN count(*) OVER (PARTITION BY 'name ' || (o_orderkey % 8000) || CASE WHEN o_orderkey % 11 = 0 THEN '?' ELSE '' END) > 1 THEN 'conflict' END AS error FROM orders")
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("old"), F.expr("concat('name ', o_orderkey % 8000, if(o_orderkey % 11 = 0, '?', ''))").alias("new"))
    return sinks.rename_plan(plan).select("old", "new", "error")


@query("SELECT p_partkey AS id, coalesce(n.v, o.v) AS v FROM (SELECT p_partkey, p_name AS v FROM part) o LEFT JOIN (SELECT p_partkey AS k, p_type AS v FROM part WHERE p_partkey % 4 = 0) n ON k = p_partkey")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return sinks.upsert(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("v")), part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("v")), "id")


@query("SELECT conv_id AS doc, string_agg('<!-- Page ' || turn || ' -->' || chr(10) || CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN '[no text on this page]' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def paged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.paged_text(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"))


# Each user's events as the sentences of one document: full citations, an id. with a quotation and one without, short and supra forms.
SENTENCE = """CASE event_id % 6 WHEN 2 THEN 'It said "the duty of care extends". Id. at 15. ' WHEN 3 THEN 'That is so. Id. at 16. ' WHEN 4 THEN 'The court agreed. Party' || chr(CAST(65 + event_id % 7 AS INT)) || ', ' || (100 + event_id % 7) || ' F.3d at 17. '
    WHEN 5 THEN 'Look at Party' || chr(CAST(65 + event_id % 7 AS INT)) || ', supra' || CASE WHEN event_id % 2 = 0 THEN '' ELSE ', at 18' END || '. '
    ELSE 'The rule stands. Party' || chr(CAST(65 + event_id % 7 AS INT)) || ' v. Corp, ' || (100 + event_id % 7) || ' F.3d 10, 12 (2d Cir. 1999). ' END"""


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(SENTENCE).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "s"))), lambda x: x["s"])
    return rows.groupBy(F.col("user_id").alias("doc_id")).agg(F.concat_ws("", ordered).alias("text"))


@query(f"""WITH e AS (SELECT user_id, event_id, event_id % 6 AS m, event_id % 7 AS a, {SENTENCE} AS s FROM events), f AS (SELECT user_id, a, min(event_id) AS first FROM e WHERE m < 2 GROUP BY ALL),
    r AS (SELECT e.*, CASE WHEN m < 2 OR (m IN (4, 5) AND first < event_id) THEN e.a END AS own FROM e LEFT JOIN f ON f.user_id = e.user_id AND f.a = e.a),
    l AS (SELECT *, CASE WHEN m IN (2, 3) THEN last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE own END AS who FROM r),
    k AS (SELECT user_id, event_id, m, CASE WHEN who IS NOT NULL THEN (100 + who) || ' f3d 10' WHEN m = 4 THEN 'short ' || (100 + a) || ' f3d ' ELSE 'at' END AS key, CASE WHEN who IS NOT NULL THEN 'Party' || chr((65 + who)::INT) || ' v. Corp' WHEN m = 4 THEN 'Party' || chr((65 + a)::INT) END AS name FROM l WHERE m < 2 OR m = 2 OR m = 4 OR (m = 5 AND event_id % 2 = 1 AND who IS NOT NULL))
    SELECT user_id AS doc_id, CASE m WHEN 2 THEN 'id' WHEN 4 THEN 'short' WHEN 5 THEN 'supra' ELSE 'full' END AS kind, key, name, CASE m WHEN 2 THEN '15' WHEN 4 THEN '17' WHEN 5 THEN '18' ELSE '12' END AS pin,
        row_number() OVER (PARTITION BY user_id, key ORDER BY event_id)::INT AS "index", count(*) OVER (PARTITION BY user_id, key)::INT AS "count" FROM k WHERE key <> 'at'""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances with their authority: antecedents of short, supra and id. forms, folded ones left out. An id. before any citation has a key of its own and is not shown."""
    found = C.citations(briefs(spark, sf_dir)).where("not startswith(key, 'at ')")
    return found.select("doc_id", "kind", "key", "name", "pin", "index", "count")


NOTED = "'Under ' || CASE o_orderkey % 3 WHEN 0 THEN 'Tax Code § ' || (o_custkey % 40) WHEN 1 THEN 'TAX CODE § ' || (o_custkey % 40) ELSE 'Fed. R. Civ. P. ' || (o_custkey % 40) END || ' it is so. '"


@query("""WITH r AS (SELECT o_custkey, min(CASE WHEN o_orderkey % 3 = 2 THEN 'procedural rule' ELSE 'statute' END) AS kind, o_orderkey % 3 = 2 AS rule, count(*) AS n FROM orders GROUP BY o_custkey, o_orderkey % 3 = 2) SELECT o_custkey AS doc_id, kind, 1::BIGINT AS n FROM r""")
def other_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes and rules of each customer's orders as one document: each once, whatever its case."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat_ws("", F.collect_list(F.expr(NOTED))).alias("text"))
    return C.references(rows).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


TREATED = """CASE event_id % 8 WHEN 0 THEN 'We overruled Smith. ' WHEN 1 THEN 'We have not overruled Smith. ' WHEN 2 THEN 'The objection was overruled in Smith. ' WHEN 3 THEN 'Smith was distinguished and later questioned. ' WHEN 4 THEN 'Questioned by 7 U.S. 9 and Smith. '
    WHEN 5 THEN 'Criticized' || repeat(' x', 130) || ' Smith. ' WHEN 6 THEN 'Smith v. Doe was abrogated. ' ELSE 'It declined to follow 12 F.3d at 19. ' END"""


@query("""WITH t AS (SELECT event_id AS id, unnest(CASE event_id % 8 WHEN 0 THEN [{'c': 'strong', 'v': 'overruled', 'd': 1}] WHEN 3 THEN [{'c': 'caution', 'v': 'distinguished', 'd': 5}, {'c': 'caution', 'v': 'questioned', 'd': 29}] WHEN 7 THEN [{'c': 'caution', 'v': 'declined to follow', 'd': 1}] ELSE [] END) AS x FROM events)
    SELECT id, x.c AS class, x.v AS verb, x.d AS distance FROM t""")
def treatments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatment verbs near a mention of Smith, 12 F.3d 15: denied, procedural, foreign and distant ones don't count."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(TREATED).alias("text"), F.array(F.lit("Smith")).alias("tokens"), F.lit("12 F.3d 15").alias("cite"))
    return C.treatments(rows)


CHAIN = """'He wrote "these very words". ' || CASE o_orderkey % 4 WHEN 0 THEN repeat('x ', 160) WHEN 1 THEN '' ELSE 'So ' END || 'Baker v. State, 100 F.3d 10' || CASE o_orderkey % 3 WHEN 0 THEN '; Cole v. State, 200 F.3d 20' WHEN 1 THEN '. See Cole v. State, 200 F.3d 20' ELSE '. Then Cole v. State, 200 F.3d 20' END || '.'"""


@query("""SELECT o_orderkey AS doc_id, i::BIGINT AS i, i = 2 AS support_only FROM orders, (SELECT unnest([1, 2]) AS i) WHERE o_orderkey % 4 <> 0 AND (i = 1 OR o_orderkey % 3 <> 2)""")
def quote_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citation that owns a quotation, and the further ones of its string."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(CHAIN).alias("text"))
    w = Window.partitionBy("doc_id").orderBy("start")
    return C.owners(docs).select("doc_id", F.row_number().over(w).cast("long").alias("i"), "support_only")


@query("""WITH p AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(substr(text, 20, 90)), '[a-z0-9]{3,}')) AS want, list_distinct(regexp_extract_all(lower(CASE WHEN doc_id % 2 = 0 THEN text ELSE reverse(text) END), '[a-z0-9]{3,}')) AS have FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)),
    s AS (SELECT id, CASE WHEN len(want) = 0 THEN 0.0 ELSE len(list_intersect(want, have)) / len(want) END AS score FROM p)
    SELECT id, round(score, 6)::DOUBLE AS score, score > 0.5 AS supports, round(1 - score, 6)::DOUBLE AS inextractability FROM s""")
def support_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage of each document against its text, or against the text reversed, by the lexical scorer."""
    pairs = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.substring("text", 20, 90).alias("proposition"), F.expr("if(doc_id % 2 = 0, text, reverse(text))").alias("text"))
    scored = S.support(pairs, size=None).select("id", "score", *S.judged(F.col("score")))
    return scored.select("id", F.round("score", 6).alias("score"), "supports", F.round("inextractability", 6).alias("inextractability"))
