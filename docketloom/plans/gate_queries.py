"""Gates and triggers over the document tables and over texts written out from structured columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators.staging import dealt
from .registry import query, table


def sql(pattern: str) -> str:
    """A pattern of gates.py in an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


# Opinions: a document with an ending that its number chooses.
ENDING = "CASE doc_id % 5 WHEN 0 THEN ' It is therefore ORDERED.' WHEN 1 THEN ' I hereby certify that a true and correct copy was served on all.' WHEN 2 THEN ' Judgment affirmed. Certificate of service.' WHEN 3 THEN ' Dated in May.' ELSE ' Per curiam.' END"


@query(f"""WITH d AS (SELECT doc_id, text || {ENDING} AS t FROM documents)
    SELECT doc_id, coalesce(length(t) BETWEEN 1200 AND 150000 AND regexp_matches(right(t, 6000), {sql(G.DECIDED)}) AND (NOT regexp_matches(right(t, 6000), {sql(G.SERVED)}) OR regexp_matches(right(t, 6000), {sql(G.DISPOSED)})), false) AS complete FROM d""")
def opinion_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat(text, {ENDING})").alias("t"))
    return docs.select("doc_id", G.complete_opinion(F.col("t")).alias("complete"))


HEADS = "CASE o_orderkey % 4 WHEN 0 THEN 'Case Events, Calendars. ' WHEN 1 THEN 'represented by A, LEAD ATTORNEY, TERMINATED: now. ' WHEN 2 THEN 'The court ordered: Docket Text, docket report, Party Information. ' ELSE 'The plaintiff and the defendant' END"
PAGE = f"concat({HEADS}, repeat('x ', cast(o_custkey % 1500 as int)), CASE WHEN o_orderkey % 3 = 0 THEN ' So ordered.' ELSE '' END)"
DUCK_PAGE = PAGE.replace("cast(o_custkey % 1500 as int)", "(o_custkey % 1500)::INT")


def sheet(t: str) -> str:
    return f"len(regexp_extract_all(substr({t}, 1, 8000), {sql(G.SHEET)})) >= 3"


@query(f"""WITH p AS (SELECT o_orderkey, {DUCK_PAGE} AS t FROM orders)
    SELECT o_orderkey, {sheet('t')} AS sheet, len(regexp_extract_all(substr(t, 1, 20000), {sql(G.SEARCH_PAGE)})) >= 2 AS search_page,
        length(t) >= 600 AND (SELECT count(*) FROM (SELECT unnest({G.OPINION_WORDS}) AS w) WHERE contains(lower(t), w)) >= 2 AS opinion,
        o_orderkey % 2 <> 0 OR (length(t) >= 2500 AND NOT {sheet('t')} AND regexp_matches(t, {sql(G.DECIDED)}) AND o_orderkey % 5 <> 0) AS acceptable FROM p""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docket sheets, case-search pages, opinions, and what an archive may stand for. Even orders cite a published reporter; every fifth text lacks the address."""
    t = F.col("t")
    pages = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(PAGE).alias("t"))
    carries, published = F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 2 == 0
    return pages.select("o_orderkey", G.docket_sheet(t).alias("sheet"), G.case_search_page(t).alias("search_page"), G.like_opinion(t).alias("opinion"), G.archive_acceptable(t, published, carries).alias("acceptable"))


SENTENCE = """CASE l_linenumber % 6 WHEN 0 THEN 'See ' || 'generally, the ' WHEN 1 THEN 'See ______ (holding that parties may (always) agree); ' WHEN 2 THEN '' WHEN 3 THEN 'Motion To Dismiss Claims The court found that ' WHEN 4 THEN 'and so the duty of care is owed to each ' ELSE 'Courts apply the rule where damages were proven by ' END || CASE WHEN l_quantity > 40 THEN repeat('word of law ', 45) WHEN l_quantity > 20 THEN 'party ' || l_partkey || ' in suit' ELSE '' END"""


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {SENTENCE} AS t FROM lineitem),
    v AS (SELECT *, replace(regexp_replace(regexp_replace(t, '\\([^()]*\\)', ' ', 'g'), '\\([^()]*\\)', ' ', 'g'), '_', ' ') AS seen FROM s)
    SELECT l_orderkey, l_linenumber, len(list_filter(regexp_extract_all(lower(t), '[a-z]{{3,}}'), lambda w: NOT list_contains({G.SIGNALS}, w))) < 4 AS bare,
        len(list_filter(regexp_extract_all(seen, '\\b[a-z]{{2,}}\\b'), lambda w: NOT list_contains({G.CITE_WORDS}, w))) < 2 AS citation FROM v""")
def bare_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), "l_orderkey", "l_linenumber", "l_partkey")
    rows = lines.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.expr(SENTENCE).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", G.bare_proposition(F.col("t")).alias("bare"), G.citation_sentence(F.col("t")).alias("citation"))


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 'Name ' || (l_suppkey % 3) AS name, trim({SENTENCE}, ' ') AS t FROM lineitem),
    k AS (SELECT *, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS key, regexp_extract(substr(t, 1, 120), {sql(G.GLUE)}, 1) AS glue FROM s),
    o AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT lower(name)) > 1),
    r AS (SELECT l_orderkey, l_linenumber, [x for x in [CASE WHEN t = '' THEN 'not extracted' END, CASE WHEN t <> '' AND length(t) < 50 THEN 'very short' END, CASE WHEN length(t) > 480 THEN 'runaway' END, CASE WHEN regexp_matches(t, '^[a-z]') THEN 'starts mid-sentence' END,
        CASE WHEN key IN (SELECT key FROM o) THEN 'shared with another authority' END, CASE WHEN glue <> '' AND NOT regexp_matches(glue, '[.!?:;,—]') THEN 'heading glued on' END] if x IS NOT NULL] AS reasons FROM k)
    SELECT l_orderkey, l_linenumber, array_to_string(reasons, '; ') AS reasons FROM r WHERE len(reasons) > 0""")
def proposition_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey"), "l_orderkey", "l_linenumber", "l_partkey")
    rows = lines.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.expr("concat('Name ', l_suppkey % 3)").alias("name"), F.expr(SENTENCE).alias("proposition"))
    return G.proposition_review(rows).select("l_orderkey", "l_linenumber", F.array_join("reasons", "; ").alias("reasons"))


REFERENCE = "CASE p_partkey % 9 WHEN 0 THEN 'Fed. R. Civ. P. ' WHEN 1 THEN 'Tax Code § ' WHEN 2 THEN 'Consent Order ' WHEN 3 THEN 'Lease Agreement ' WHEN 4 THEN 'In re Estate Order ' WHEN 5 THEN 'Smith v. Deed Co. ' WHEN 6 THEN '' ELSE 'Treatise ' END || p_name"
KIND = "CASE p_partkey % 4 WHEN 0 THEN 'Book' WHEN 1 THEN '' END"


def any_word(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {sql(w)})" for w in words) + ")"


@query(f"""WITH n AS (SELECT p_partkey, {REFERENCE} AS name, {KIND} AS kind FROM part)
    SELECT p_partkey, CASE {' '.join(f"WHEN {any_word('lower(coalesce(name, chr(32)))', words)} THEN '{label}'" for words, label in G.REFERENCES)} ELSE coalesce(nullif(lower(kind), ''), 'reference') END AS class,
        coalesce(name <> '' AND NOT regexp_matches(name, {sql(G.CASE_NAME)}) AND {any_word('lower(name)', G.INSTRUMENTS)}, false) AS instrument FROM n""")
def reference_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(REFERENCE).alias("name"), F.expr(KIND).alias("kind"))
    return rows.select("p_partkey", G.non_case_class(F.col("name"), F.col("kind")).alias("class"), G.instrument(F.col("name")).alias("instrument"))


HOST = "replace(url, 'example', CASE page_id % 7 WHEN 0 THEN 'law.justia.com' WHEN 1 THEN 'caselaw.FindLaw.com' WHEN 2 THEN 'casemine.com' WHEN 3 THEN 'nycourts.gov' WHEN 4 THEN 'search.txcourts.gov' WHEN 5 THEN 'courtlistener.com' ELSE 'example' END)"


@query(f"""WITH u AS (SELECT page_id, {HOST} AS u FROM pages) SELECT site, count(*) AS n FROM (SELECT CASE {' '.join(f"WHEN contains(lower(u), '{h}') THEN '{s}'" for h, s in G.SITES)} ELSE 'web' END AS site FROM u) GROUP BY site""")
def page_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(G.site(F.expr(HOST)).alias("site")).groupBy("site").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN y AND s > 0.8 AND a < 0.5 THEN 'supports' WHEN a >= 0.7 THEN 'does not support' WHEN a >= 0.5 OR s < 0.3 THEN 'weak' WHEN y THEN 'supports' ELSE 'unclear' END AS note
    FROM (SELECT *, coalesce(l_discount * 10, 0) AS s, coalesce(CASE WHEN l_linenumber <> 5 THEN l_tax * 10 END, 1) AS a, coalesce(l_returnflag = 'A', false) AS y FROM lineitem)""")
def qa_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    note = G.qa_note(F.col("l_discount") * 10, F.when(F.col("l_linenumber") != 5, F.col("l_tax") * 10), F.col("l_returnflag") == "A")
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), note.alias("note"))


@query("""WITH q AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders GROUP BY 1)
    SELECT c_custkey, c_acctbal > 0 AND c_custkey % 4 <> 0 AND coalesce(open, 0) = 0 AS ok FROM customer LEFT JOIN q ON k = c_custkey""")
def interpretive_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer as a case: read, in full text, and all its orders (as quotations) confirmed."""
    confirmed = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.col("o_orderstatus") == "F").alias("q"))
    rows = table(spark, sf_dir, "customer").join(confirmed, F.col("c_custkey") == F.col("k"), "left")
    return rows.select("c_custkey", G.may_interpret(F.col("c_acctbal") > 0, F.col("c_custkey") % 4 != 0, F.col("q")).alias("ok"))


FILE = "CASE o_orderkey % 4 WHEN 0 THEN '2024.01.05 [12] Order.pdf' WHEN 1 THEN '2024.1.05 [12] Order.pdf' WHEN 2 THEN 'scan.PDF' ELSE 'notes.docx' END"


@query(f"SELECT skip, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match({FILE}, '\\d{{4}}\\.\\d{{2}}\\.\\d{{2}} \\[\\d+\\] .+\\.pdf') THEN 'already_normalized' WHEN NOT ends_with(lower({FILE}), '.pdf') THEN 'not_pdf' END AS skip FROM orders) GROUP BY skip")
def files_to_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(FILE)
    skip = F.when(G.already_named(name), "already_normalized").when(~F.lower(name).endswith(".pdf"), "not_pdf")
    return table(spark, sf_dir, "orders").select(skip.alias("skip")).groupBy("skip").agg(F.count("*").alias("n"))


CAPTION = "concat(CASE o_orderkey % 5 WHEN 0 THEN '§ § §' WHEN 1 THEN 'Smith v. Jones, PLAINTIFF' WHEN 2 THEN '§ CAUSE NO. 5' WHEN 3 THEN 'Smith vs. Jones' ELSE 'COUNTY ROAD' END, ' ', o_orderpriority)"


@query(f"""SELECT o_orderkey, length(t) - length(replace(t, '§', '')) >= 3 OR (regexp_matches(t, '{G.COURT_WORDS}') AND (contains(t, '§') OR regexp_matches(t, '(?i)\\bvs?\\.\\s'))) AS caption,
    CASE WHEN o_orderkey % 3 = 0 THEN 'txt' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'txt' ELSE 'md' END AS format FROM (SELECT o_orderkey, {CAPTION} AS t FROM orders)""")
def caption_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions, and the format that a document's kind or the user chooses."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(CAPTION).alias("t"), F.expr("if(o_orderkey % 2 = 0, 'deposition', 'brief')").alias("kind"), F.expr("case o_orderkey % 3 when 0 then 'txt' when 2 then 'md' end").alias("wanted"))
    return rows.select("o_orderkey", G.caption_block(F.col("t")).alias("caption"), G.output_format(F.col("kind"), F.col("wanted")).alias("format"))


LINES = """o_custkey AS page, o_orderkey AS line, CASE o_orderkey % 6 WHEN 0 THEN 'ARGUMENT' WHEN 1 THEN 'the motion is denied' WHEN 2 THEN '§' WHEN 3 THEN 'From: Clerk' WHEN 4 THEN 'STATEMENT OF FACTS' ELSE 'Introduction' END AS text, 10 + o_orderkey % 7 AS size, 10 AS body_size, (o_orderkey % 3) / 2.0 AS bold_share, (o_orderkey % 5) / 20.0 AS off_centre"""


@query(f"""WITH l AS (SELECT {LINES} FROM orders), c AS (SELECT *, regexp_matches(text, '[A-Z]') AND text = upper(text) AND length(text) > 3 AS caps FROM l),
    b AS (SELECT *, coalesce(lag(caps) OVER w, false) OR coalesce(lead(caps) OVER w, false) AS beside FROM c WINDOW w AS (PARTITION BY page ORDER BY line))
    SELECT line, CASE WHEN length(text) < 4 THEN 0 WHEN caps AND NOT size > 14 AND beside THEN 0 WHEN text LIKE 'From:%' THEN 0 WHEN size > 14 THEN 1 WHEN size > 11.5 AND caps AND (off_centre < 0.15 OR bold_share >= 0.8) THEN 2 ELSE 0 END AS level FROM b""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .severity_queries import _split

    return G.heading_level(table(spark, sf_dir, "orders").selectExpr(*_split(LINES)), "page", "line").select("line", "level")
