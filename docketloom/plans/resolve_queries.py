"""Resolution, names and grouped reports over citations that are written out from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as A
from ..functions import normalize as N
from ..operators import resolve as R
from .match_queries import sql_tokens
from .registry import query, table, texts

NAME = """CASE p_partkey % 6 WHEN 0 THEN 'In re ' || p_name WHEN 1 THEN p_name || ' vs. ' || p_type || ', 12 F.3d 345' WHEN 2 THEN p_name || ', v. ' || p_type || ' (1999)' WHEN 3 THEN '*' || p_name || '* V. ' || p_type ELSE p_name || ' v ' || p_type || ',' END"""
FIRST = """CASE p_partkey % 6 WHEN 0 THEN 'In re ' || p_name WHEN 3 THEN '*' || p_name || '*' ELSE p_name END"""
SECOND = "CASE p_partkey % 6 WHEN 0 THEN '' ELSE p_type END"


@query(f"SELECT p_partkey, {FIRST} AS first, {SECOND} AS second, trim(replace({FIRST}, '*', '') || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE ' ' || p_type END, ' ') AS search FROM part")
def case_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case names in their parties, and the name to search by."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(NAME).alias("name"))
    return rows.select("p_partkey", A.parties(F.col("name")).alias("p"), A.search_name(F.col("name"), F.lit(None).cast("string")).alias("search")).select("p_partkey", "p.first", "p.second", "search")


CITE = """l_partkey || ' A.D.3d ' || l_suppkey || CASE l_linenumber % 3 WHEN 0 THEN ', ' || (l_suppkey + 7) ELSE '' END || CASE l_linenumber % 4 WHEN 0 THEN ' (1st Dept. ' || year(l_shipdate) || ')' WHEN 1 THEN '(U) (Sup. Ct. Mar. ' || (l_orderkey % 28 + 1) || ', ' || year(l_shipdate) || ')' WHEN 2 THEN '' ELSE ' (S.D. Tex. Foo 3, 2021)' END"""


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey AS o, l_shipdate AS d, l_suppkey AS s, {CITE} AS cite FROM lineitem)
    SELECT l_orderkey, l_linenumber, regexp_extract_all(cite, '\\b(?:1[89]|20)\\d{{2}}\\b')[-1]::INT AS year, CASE WHEN l_linenumber % 4 = 1 THEN make_date(year(d), 3, o % 28 + 1)::VARCHAR END AS date,
        CASE WHEN l_linenumber % 3 = 0 THEN (s + 7)::VARCHAR END AS pin, trim(regexp_replace(cite, '\\s*\\([^()]*\\d{{4}}[^()]*\\)', '', 'g')) AS plain FROM c""")
def cite_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, full date, pincite and address of a cite."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.expr(CITE).alias("cite"))
    c = F.col("cite")
    return rows.select("l_orderkey", "l_linenumber", A.cited_year(c).alias("year"), A.decision_date(c).cast("string").alias("date"), A.pincite(F.lit(None).cast("string"), c).alias("pin"), A.without_date(c).alias("plain"))


SHOWN = """CASE doc_id % 5 WHEN 0 THEN '“' || substr(text, 1, 20) WHEN 1 THEN substr(text, 1, 20) || '”' WHEN 2 THEN '"' || substr(text, 1, 20) WHEN 3 THEN substr(text, 1, 20) || '"' ELSE substr(text, 1, 20) END"""


@query(f"""WITH s AS (SELECT doc_id, trim({SHOWN}, ' ') AS s FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)),
    c AS (SELECT doc_id, CASE WHEN length(s) - length(replace(s, '”', '')) > length(s) - length(replace(s, '“', '')) THEN '“' || s WHEN length(s) - length(replace(s, '“', '')) > length(s) - length(replace(s, '”', '')) THEN s || '”' ELSE s END AS s FROM s)
    SELECT doc_id, CASE WHEN (length(s) - length(replace(s, '"', ''))) % 2 = 1 THEN CASE WHEN length(s) - instr(reverse(s), '"') > length(s) / 2 THEN '"' || s ELSE s || '"' END ELSE s END AS shown FROM c""")
def balanced_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", A.balanced(F.expr(SHOWN)).alias("shown"))


ENTRY = "l_suppkey || ' F.3d ' || (l_partkey % 50) AS key, CASE l_linenumber % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 300 END AS status, l_orderkey * 10 + l_linenumber AS pos, l_partkey::VARCHAR AS value"


@query(f"SELECT key, status, pos, value FROM (SELECT {ENTRY} FROM lineitem) QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(status <> 200, true), pos) = 1")
def lookup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat(l_suppkey, ' F.3d ', l_partkey % 50) as key", "case l_linenumber % 4 when 0 then 200 when 1 then 404 when 2 then 300 end as status", "l_orderkey * 10 + l_linenumber as pos", "cast(l_partkey as string) as value")
    return R.lookup_map(rows)


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS cite_id, l_partkey || 'f3d' || l_suppkey AS key FROM lineitem), t AS (SELECT p_partkey AS list_id, regexp_replace(lower(p_partkey || ' F.3d ' || (p_size * 3 % 11) || '1, ' || p_size), '[\\s.,]', '', 'g') AS listed FROM part)
    SELECT cite_id, min(list_id) AS list_id FROM c JOIN t ON contains(listed, key) WHERE length(key) >= 4 GROUP BY cite_id, key""")
def cite_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cite against the listed cites that contain it."""
    cites = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cite_id"), A.compact_cite(F.concat("l_partkey", F.lit(" F. 3d "), "l_suppkey")).alias("key")).distinct()
    listed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("list_id"), A.compact_cite(F.expr("concat(p_partkey, ' F.3d ', p_size * 3 % 11, '1, ', p_size)")).alias("listed"))
    return R.contained_cite(cites, listed)


@query("""SELECT l_orderkey AS cite_id, first(l_partkey ORDER BY coalesce(l_tax > 0.04, false) DESC, l_linenumber, l_partkey) AS cand_id FROM lineitem WHERE l_linenumber <= 3 AND l_quantity > 10 GROUP BY l_orderkey""")
def pincite_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the three first candidates the one whose text has the cited page, else the first with a text."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as cite_id", "l_partkey as cand_id", "l_linenumber as rank", "l_quantity > 10 as has_text", "l_tax > 0.04 as has_pincite")
    return R.choose_candidate(rows)


GATE = """l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'on_record' WHEN 1 THEN 'not_on_record' WHEN 2 THEN 'contradicted' ELSE 'no_data' END AS address, l_returnflag = 'N' AS elsewhere, CASE l_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS gate,
    CASE l_suppkey % 3 WHEN 0 THEN 'mismatch' ELSE 'match' END AS caption, 1 + l_partkey % 2 AS clusters, l_suppkey % 4 = 0 AS database, year(l_shipdate) AS cited, 1994 AS filed"""


@query(f"""WITH g AS (SELECT {GATE}, l_partkey % 3 AS kind FROM lineitem), k AS (SELECT *, address = 'contradicted' OR (address IN ('not_on_record', 'no_data') AND elsewhere) AS contradicted FROM g)
    SELECT l_orderkey, l_linenumber, CASE WHEN contradicted THEN false WHEN caption = 'match' AND clusters = 1 AND kind <> 2 THEN true ELSE gate END AS ok, contradicted, address = 'not_on_record' AND NOT database AND abs(cited - filed) > 1 AS other FROM k""")
def identity_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity gate relaxed by one matching cluster or refuted by the address, and decisions of another year."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "cast(l_linenumber as bigint) as l_linenumber", "case l_linenumber % 4 when 0 then 'on_record' when 1 then 'not_on_record' when 2 then 'contradicted' else 'no_data' end as address", "l_returnflag = 'N' as elsewhere",
        "case l_orderkey % 3 when 0 then false when 1 then null else true end as gate", "case l_suppkey % 3 when 0 then 'mismatch' else 'match' end as caption", "1 + l_partkey % 2 as clusters", "l_suppkey % 4 = 0 as database", "year(l_shipdate) as cited",
        "case l_partkey % 3 when 0 then array('acme', 'corporation') when 1 then array('corp') else array('acme', 'zeta') end as want",
    )
    c = F.col
    have = F.array(F.lit("acme"), F.lit("corporation"))
    both = R.identity(c("gate"), c("caption"), c("clusters"), c("want"), have, c("address"), c("elsewhere"))
    return rows.select("l_orderkey", "l_linenumber", both.alias("i"), R.other_decision(c("address"), c("database"), c("cited"), F.lit(1994)).alias("other")).select("l_orderkey", "l_linenumber", "i.ok", "i.contradicted", "other")


@query("""WITH c AS (SELECT o_orderkey AS cite_id, o_orderdate::DATE AS date, ['u' || o_custkey % 40, 'v' || o_custkey % 5, 'w'] AS tokens FROM orders), e AS (SELECT l_orderkey * 10 + l_linenumber AS entry_id, l_shipdate::DATE AS filed, CASE l_linenumber % 4 WHEN 0 THEN 'Order on motion' WHEN 1 THEN 'MEMORANDUM opinion' WHEN 2 THEN 'Notice' ELSE 'reordered list' END AS description, 'U' || l_partkey % 40 || '-v' || l_suppkey % 5 AS slug FROM lineitem),
    b AS (SELECT cite_id, entry_id, len(list_filter(tokens, lambda t: contains(lower(slug), t))) + (filed = date)::INT AS score, len(list_filter(tokens, lambda t: contains(lower(slug), t))) AS m FROM c JOIN e ON filed BETWEEN date - 1 AND date + 1 WHERE regexp_matches(description, '(?i)\\b(ORDER|OPINION|MEMORANDUM|RULING)\\b'))
    SELECT cite_id, entry_id, score::INT AS score FROM b WHERE m >= 2 QUALIFY row_number() OVER (PARTITION BY cite_id ORDER BY score DESC, entry_id) = 1""")
def archive_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cite_id"), F.to_date("o_orderdate").alias("date"), F.expr("array(concat('u', o_custkey % 40), concat('v', o_custkey % 5), 'w')").alias("tokens"))
    entries = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"), F.to_date("l_shipdate").alias("filed"), F.expr("case l_linenumber % 4 when 0 then 'Order on motion' when 1 then 'MEMORANDUM opinion' when 2 then 'Notice' else 'reordered list' end").alias("description"),
        F.expr("concat('U', l_partkey % 40, '-v', l_suppkey % 5)").alias("slug"),
    )
    return R.archive_match(cites, entries)


@query(f"""WITH t AS (SELECT p_partkey AS id, p_brand, {sql_tokens("p_name || ' ' || p_type")} AS t FROM part)
    SELECT a.id AS cited, b.id AS citing, len(a.t) > 0 AND len(list_intersect(a.t, b.t)) >= least(greatest(len(a.t), 1), 2) AS later FROM t a JOIN t b ON b.id = a.id + 1""")
def later_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the next part, as a citing case, is later history of a part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cited"), N.name_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("a"))
    other = part.select((F.col("cited") - 1).alias("cited"), F.col("cited").alias("citing"), F.col("a").alias("b"))
    return part.join(other, "cited").select("cited", "citing", R.later_history(F.col("a"), F.col("b")).alias("later"))


@query("""WITH p AS (SELECT user_id AS doc, event_id, (value * 37)::INT AS pos FROM events), s AS (SELECT o_custkey AS doc, o_orderkey AS span, (o_totalprice % 3000)::INT AS a, (o_totalprice % 3000)::INT + o_orderkey % 900 AS b FROM orders)
    SELECT event_id, count(*) AS n, min(span) AS span FROM p JOIN s USING (doc) WHERE a <= pos AND pos < b GROUP BY event_id""")
def offsets_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets in footnotes, sentences or parentheticals: each event's place in its customer's spans."""
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), "event_id", F.expr("cast(rint(value * 37) as int)").alias("at"))
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("span"), F.expr("cast(rint(o_totalprice % 3000) as int)").alias("start")).withColumn("end", F.col("start") + F.col("span") % 900)
    return R.in_spans(points, spans, "doc").groupBy("event_id").agg(F.count("*").alias("n"), F.min("span").alias("span"))


@query("""WITH r AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS id, l_linenumber * 100 AS start, CASE WHEN l_linenumber % 3 = 0 THEN (l_linenumber - 1) * 100 WHEN l_linenumber % 5 = 0 THEN 7 END AS up FROM lineitem)
    SELECT a.doc, a.id, b.id AS parent FROM r a LEFT JOIN (SELECT DISTINCT doc, id, start FROM r) b ON a.doc = b.doc AND a.up = b.start""")
def nested_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "cast(l_linenumber as bigint) as id", "l_linenumber * 100 as start", "case when l_linenumber % 3 = 0 then (l_linenumber - 1) * 100 when l_linenumber % 5 = 0 then 7 end as parent_start")
    return R.with_parent(rows, "doc").select("doc", "id", "parent")


@query("""WITH a AS (SELECT l_orderkey AS claim_id, l_partkey AS section_id FROM lineitem UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 0)
    SELECT claim_id, section_id, p_partkey IS NOT NULL AS found FROM a LEFT JOIN part ON p_partkey = section_id AND p_size > 10""")
def claim_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_list("l_partkey").alias("sections"))
    asked = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("section_id"))
    return R.claim_sections(claims, asked, table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("section_id")))


CLASS = "CASE event_id % 5 WHEN 0 THEN 'negative' WHEN 1 THEN 'caution' WHEN 2 THEN '' WHEN 3 THEN 'none' END"
KEY = "coalesce(CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR END, CASE WHEN event_id % 3 = 1 THEN 'cite:' || event_type END, 'at:' || event_id)"


@query(f"""WITH k AS (SELECT event_id, {KEY} AS key, {CLASS} AS cls FROM events), g AS (SELECT key, min(event_id) AS first_id, coalesce(nullif(first(cls ORDER BY event_id), ''), 'none') AS cls FROM k GROUP BY key)
    SELECT k.key, event_id AS "at", CASE WHEN g.cls IN ('negative', 'caution') THEN 'flagged' WHEN first_id % 7 = 0 THEN 'not_checked' ELSE 'clean' END AS part, g.cls AS classification FROM k JOIN g ON k.key = g.key""")
def treatment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as instances by authority; an authority is classified by its first instance, and every seventh of those was not checked."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.expr("if(event_id % 3 = 0, user_id, null)").alias("cluster_id"), F.expr("if(event_id % 3 = 1, event_type, null)").alias("cite"), F.col("event_type").alias("name"))
    first = F.element_at("instances", 1)
    graded = R.authorities(rows).withColumn("event_id", first).withColumn("classification", F.expr(CLASS)).withColumn("status", F.when(F.col("event_id") % 7 == 0, "not_checked").otherwise("done"))
    return R.treatment_summary(graded)


@query("""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, floor(value / 10) DESC, event_id) AS rank FROM events) WHERE rank <= 4""")
def top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("strong"), F.floor(F.col("value") / 10).alias("weight"), F.col("event_id").alias("pos"))
    return R.top_signals(rows, "user_id").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


KINDS = "CASE l_linenumber % 6 WHEN 0 THEN '040dissent' WHEN 1 THEN '030concurrence' WHEN 2 THEN '020Lead' WHEN 3 THEN NULL WHEN 4 THEN '999other' ELSE '010combined' END"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber::BIGINT AS id, {KINDS} AS kind, l_quantity AS length FROM lineitem), r AS (SELECT *, CASE lower(kind) WHEN '040dissent' THEN 5 WHEN '030concurrence' THEN 4 WHEN '020lead' THEN 1 WHEN '010combined' THEN 0 ELSE 3 END AS rank FROM p)
    SELECT l_orderkey, id FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY rank, length DESC, id) = 1""")
def controlling_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("id"), F.expr(KINDS).alias("kind"), F.col("l_quantity").alias("length"))
    return R.controlling(parts, "l_orderkey")


@query("""WITH r AS (SELECT page_id AS pos, CASE WHEN page_id % 3 = 0 THEN 'http://x/a/' || (page_id % 9) || '//' END AS url, 'Case No. ' || (page_id % 11) AS name, CASE WHEN page_id % 4 = 0 THEN ' Cap ' || page_id END AS caption FROM pages),
    k AS (SELECT *, CASE WHEN url IS NOT NULL THEN (pos % 9)::VARCHAR ELSE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') END AS key FROM r)
    SELECT key, coalesce(trim(caption), name) AS name FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1""")
def body_only_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id as at", "if(page_id % 3 = 0, concat('http://x/a/', page_id % 9, '//'), null) as url", "concat('Case No. ', page_id % 11) as name", "if(page_id % 4 = 0, concat(' Cap ', page_id), null) as caption")
    return R.body_only_names(rows)


SECTION = "CASE WHEN p_partkey % 10 = 0 THEN 'VF-' WHEN p_partkey % 10 = 1 THEN 'X' ELSE '' END || (100 + p_partkey * 7 % 900)"


@query(f"""WITH i AS (SELECT p_partkey AS pos, {SECTION} AS section_id, p_name AS title, (100 + p_partkey * 7 % 900)::VARCHAR AS d FROM part WHERE p_partkey % 10 > 1), s AS (SELECT *, substr(d, 1, length(d) - 2) || '00' AS series, row_number() OVER (PARTITION BY substr(d, 1, length(d) - 2) ORDER BY pos) AS n FROM i)
    SELECT series, first(title ORDER BY pos) AS title, string_agg(section_id, ',' ORDER BY pos) AS sections FROM s WHERE n <= 40 GROUP BY series""")
def series_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.expr(SECTION).alias("section_id"), F.col("p_name").alias("title"))
    return R.series_drafts(index).select("series", "title", F.array_join("sections", ",").alias("sections"))


@query("""WITH v AS (SELECT p_brand, k, v, count(*) AS votes FROM (SELECT p_brand, unnest(['size', 'type']) AS k, unnest([CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_size % 7)::VARCHAR END, p_type]) AS v FROM part) WHERE v IS NOT NULL GROUP BY ALL)
    SELECT p_brand, k, v AS value, votes FROM v QUALIFY row_number() OVER (PARTITION BY p_brand, k ORDER BY votes DESC, v) = 1""")
def observed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "part").selectExpr("p_brand", "stack(2, 'size', if(p_size % 5 = 0, null, cast(p_size % 7 as string)), 'type', p_type) as (k, value)")
    return R.observed_profile(values, ["p_brand", "k"])


@query("""SELECT 'routing-validate' AS source, 'q' || c_nationkey AS question, 'ROUTING' AS category, CASE WHEN c_custkey % 3 = 0 THEN 'critical' ELSE 'review' END AS severity, 'q' || c_nationkey || ': ' || c_mktsegment || ': x' AS finding FROM customer""")
def validation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ledger_records(table(spark, sf_dir, "customer").selectExpr("if(c_custkey % 3 = 0, 'error', 'warning') as level", "concat('q', c_nationkey, ': ', c_mktsegment, ': x') as message"))


@query("""WITH n AS (SELECT n_nationkey AS k, n_nationkey + 1 AS num, CASE WHEN n_nationkey % 2 = 0 THEN 'AND' ELSE 'OR' END AS logic FROM nation),
    c AS (SELECT k AS node, 0 AS kind, j AS pos, 'you ' || CASE WHEN k % 5 = 0 THEN 'unanimously ' ELSE '' END || 'answered “' || CASE WHEN j = 1 THEN 'Yes' ELSE 'No' END || '” to Question No. ' || (k - j + 1) || CASE WHEN k % 3 = 0 THEN ' regarding any party' WHEN k % 3 = 1 THEN ' regarding a party' ELSE '' END AS t, k % 3 = 1 AS pp FROM n, (SELECT unnest([1, 2]) AS j) WHERE k - j >= 0
        UNION ALL SELECT k, 1, 1, 'you answered “No” to Question No. ' || (k - 2), false FROM n WHERE k % 4 = 3 UNION ALL SELECT k, 2, 1, 'you answered “No” to Question No. ' || (k + 2) || ' or did not answer it', false FROM n WHERE k % 6 = 1 AND k < 24),
    g AS (SELECT node, string_agg(t, ' and ' ORDER BY kind, pos) AS a, string_agg(t, ' or ' ORDER BY kind, pos) AS o, bool_or(pp) AS pp, bool_or(kind = 1) AS b FROM c GROUP BY node)
    SELECT node, 'If ' || CASE WHEN b OR logic = 'AND' THEN a ELSE o END || ', then answer Question No. ' || num || CASE WHEN pp THEN ' regarding that party' ELSE '' END || '. Otherwise, do not answer Question No. ' || num || '.' AS sentence FROM g JOIN n ON k = node""")
def routing_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    numbers, nodes = n.withColumn("number", F.col("key") + 1), n.withColumn("logic", F.expr("if(key % 2 = 0, 'AND', 'OR')"))
    rows = n.withColumn("pos", F.explode(F.array(F.lit(1), F.lit(2)))).where("key - pos >= 0")
    predicates = rows.selectExpr("key as node", "key - pos as source", "if(pos = 1, 'Yes', 'No') as answer", "case key % 3 when 0 then 'any_party' when 1 then 'same_party' else 'all' end as scope", "key % 5 = 0 as unanimous", "pos")
    others = n.where("key % 4 = 3").selectExpr("key - 3 as node", "key as target", "'blocks' as kind", "1 as pos").unionByName(n.where("key % 6 = 1 and key < 24").selectExpr("key as node", "key + 1 as target", "'alternative' as kind", "1 as pos"))
    return R.routing_sentences(nodes, predicates, others, numbers)
