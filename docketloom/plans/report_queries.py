"""Dates, filings, styles, graphs, verdicts, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as T
from ..functions import style as S
from ..operators import dedup as D
from ..operators import grade as G
from ..operators import graph as R
from ..operators import segment as Z
from ..operators.staging import dealt
from .registry import query, table, texts

# Dates written out from orders; every seventh has a wrong weekday, every ninth a day that doesn't exist.
MENTION = "concat(date_format(date_add(to_date(o_orderdate), if(o_orderkey % 7 = 0, 1, 0)), 'EEEE'), ', ', date_format(o_orderdate, 'MMMM'), ' ', if(o_orderkey % 9 = 0, 31, day(o_orderdate)), ', ', year(o_orderdate))"
SQL_DAYS = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"
REAL = "try_cast(year(o_orderdate) || '-' || month(o_orderdate) || '-' || CASE WHEN o_orderkey % 9 = 0 THEN 31 ELSE day(o_orderdate) END AS DATE)"
CLAIMED = "(isodow(o_orderdate::DATE + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) - 1)"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(MENTION).alias("text"))
    m = orders.select("o_orderkey", "o_custkey", F.explode(T.mentions(F.col("text"), 2026)).alias("m")).select("o_orderkey", "o_custkey", "m.*")
    return m.withColumn("date", T.real_date(F.col("year"), F.col("month"), F.col("day")))


@query(f"SELECT o_orderkey, {REAL} IS NOT NULL AS valid FROM orders")
def date_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(spark, sf_dir).select("o_orderkey", F.col("date").isNotNull().alias("valid"))


@query(f"SELECT o_orderkey, {SQL_DAYS}[isodow({REAL})] AS correct FROM orders WHERE {REAL} IS NOT NULL AND {CLAIMED} <> isodow({REAL}) - 1")
def dow_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(spark, sf_dir).where("date is not null and claimed <> weekday(date)").select("o_orderkey", F.date_format("date", "EEEE").alias("correct"))


@query(f"SELECT {REAL}::VARCHAR AS date, count(DISTINCT {CLAIMED}) AS n_labels FROM orders WHERE {REAL} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {CLAIMED}) > 1")
def date_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that documents label with more than one weekday."""
    named = dated(spark, sf_dir).where("date is not null").groupBy(F.col("date").cast("string").alias("date")).agg(F.count_distinct("claimed").alias("n_labels"))
    return named.where("n_labels > 1")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' ELSE 'yesterday' END AS word FROM orders
    WHERE o_orderdate::DATE <> DATE '1995-06-17' + CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END""")
def relative_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative words next to a date, against a given clock."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.expr("case o_orderkey % 3 when 0 then 'today' when 1 then 'tomorrow' else 'yesterday' end").alias("word"))
    shift = F.when(F.col("word") == "today", 0).when(F.col("word") == "tomorrow", 1).otherwise(-1)
    return rows.where(F.col("d") != F.date_add(F.to_date(F.lit("1995-06-17")), shift)).select("o_orderkey", "word")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') || ' [' || (o_orderkey % 100 + 1) || '] Order ' || o_orderpriority || '.pdf' AS name, length(strftime(o_orderdate, '%Y.%m.%d') || ' [' || (o_orderkey % 100 + 1) || '] Order ' || o_orderpriority || '.pdf') <= 240 AS ok FROM orders")
def filing_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = T.filing_name(F.to_date("o_orderdate"), F.col("o_orderkey") % 100 + 1, F.concat(F.lit("Order "), "o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    return rows.withColumn("ok", ~F.col("name").rlike(r'[<>:"/\\|?*]') & (F.length("name") <= 240))


@query("""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 1 END AS a, CASE WHEN o_orderkey % 3 <> 0 THEN 1 END AS b, CASE WHEN o_orderkey % 2 <> 0 THEN 1 END AS c FROM orders)
    SELECT o_orderkey, CASE (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM f""")
def filing_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.concat(F.when(F.col("o_orderkey") % 5 != 0, F.lit("2024.01.05 ")).otherwise(F.lit("")), F.when(F.col("o_orderkey") % 3 != 0, F.lit("[12] ")).otherwise(F.lit("")), F.when(F.col("o_orderkey") % 2 != 0, F.lit("Title Motion")).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", names.alias("file"))
    field = lambda pattern, g=0: F.nullif(F.regexp_extract("file", pattern, g), F.lit(""))
    rows = rows.select("o_orderkey", F.try_to_date(field(r"\d{4}\.\d\d\.\d\d"), "yyyy.MM.dd").alias("date"), field(r"\[(\d+)\]", 1).alias("docket"), field(r"Title.*").alias("title"))
    return rows.select("o_orderkey", G.confidence("date", "docket", "title").alias("confidence"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 'Smith v Jones, ' || l_partkey || CASE l_linenumber % 4 WHEN 0 THEN ' NY3d ' WHEN 1 THEN ' F Supp 2d ' WHEN 2 THEN ' US ' ELSE ' So 3d ' END || l_suppkey || ' [2d Dept ' || year(l_shipdate) || ']' AS styled FROM lineitem""")
def restyle_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    reporter = F.expr("case l_linenumber % 4 when 0 then ' N.Y.3d ' when 1 then ' F. Supp. 2d ' when 2 then ' U.S. ' else ' So. 3d ' end")
    text = F.concat(F.lit("Smith v. Jones, "), "l_partkey", reporter, "l_suppkey", F.lit("  (2d Dept "), F.year("l_shipdate"), F.lit(")"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), S.restyle(text).alias("styled"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS v, l_linenumber % 3 = 0 AS p, l_quantity > 25 AS s FROM lineitem)
    SELECT issue, count(*) AS n FROM (SELECT 'versus_period' AS issue FROM c WHERE v UNION ALL SELECT 'date_in_parens' FROM c WHERE p UNION ALL SELECT 'comma_after_signal' FROM c WHERE s UNION ALL SELECT 'truncated_page_range' FROM c) GROUP BY issue""")
def style_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(if(l_quantity > 25, 'see, ', 'see '), 'Smith ', if(l_linenumber % 2 = 0, 'v. ', 'v '), 'Jones, 37 NY3d 371, 316-17 ', if(l_linenumber % 3 = 0, '(2021)', '[2021]'))")
    found = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_linenumber", "l_quantity").select(text.alias("t")).select(S.issues(F.col("t")).alias("xs")).select(F.explode_outer("xs").alias("x")).where("x is not null")  # of explode, Spark takes a filter that finds the issues once more
    return found.groupBy("x.issue").agg(F.count("*").alias("n"))


NODES = "SELECT n_nationkey AS id, (n_nationkey * 7 + 3) % 25 AS a, (n_nationkey * 5 + 1) % 25 AS b FROM nation"
EDGES = f"(SELECT id AS src, a AS dst FROM ({NODES}) UNION SELECT id, b FROM ({NODES}) WHERE id % 3 = 0)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    first = n.select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % 25).alias("dst"))
    return first.union(n.where("id % 3 = 0").select("id", (F.col("id") * 5 + 1) % 25)).distinct()


@query(f"""WITH RECURSIVE e AS {EDGES}, w AS (SELECT n_nationkey::BIGINT AS root, n_nationkey::BIGINT AS node, 0 AS depth FROM nation UNION ALL SELECT root, dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 3)
    SELECT root, node, min(depth)::INT AS depth FROM w GROUP BY ALL""")
def xref_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("root"))
    return R.closure(edges(spark, sf_dir), roots, 3)


@query(f"""WITH RECURSIVE e AS {EDGES}, w AS (SELECT src AS start, dst AS node, [src] AS path FROM e WHERE src <= dst UNION ALL SELECT start, dst, list_append(path, node) FROM w JOIN e ON src = node WHERE node > start AND NOT list_contains(path, node))
    SELECT array_to_string(list_append(path, start), ' -> ') AS path FROM w WHERE node = start""")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cycles(edges(spark, sf_dir))


TYPE = "CASE n_nationkey % 4 WHEN 0 THEN 'liability' WHEN 1 THEN 'damages' WHEN 2 THEN 'defense' ELSE 'predicate' END"


@query(f"""WITH RECURSIVE e AS {EDGES}, n AS (SELECT n_nationkey::BIGINT AS key, {TYPE} AS type FROM nation), w AS (SELECT key AS root, key AS node FROM n UNION SELECT root, dst FROM w JOIN e ON src = node)
    SELECT root AS key, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM w JOIN n ON node = key GROUP BY root""")
def chain_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as key", f"{TYPE} as type")
    return R.chain_types(edges(spark, sf_dir), nodes).select("key", F.array_join("types", ",").alias("types"))


@query(f"""WITH RECURSIVE n AS (SELECT 'q' || n_nationkey AS key, n_regionkey AS part, {TYPE} AS type, n_nationkey % 2 = 0 AS pp, n_nationkey % 6 <> 5 AS sourced FROM nation),
    p AS (SELECT 'q' || n_nationkey AS node, 'q' || (n_nationkey + 1) AS source, CASE WHEN n_nationkey % 8 = 0 THEN 'Maybe' ELSE 'Yes' END AS answer, CASE WHEN n_nationkey % 5 = 0 THEN 'any_party' ELSE 'any' END AS scope FROM nation),
    o AS (SELECT 'q' || n_nationkey AS node, 'q' || (n_nationkey + 3) AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'blocks' ELSE 'alternative' END AS kind FROM nation WHERE n_nationkey % 3 = 0),
    pj AS (SELECT p.*, n.key AS k, n.type AS kt, n.pp AS kp FROM p LEFT JOIN n ON source = n.key), oj AS (SELECT o.*, t.key AS k, t.type AS kt, s.type AS nt FROM o LEFT JOIN n t ON target = t.key LEFT JOIN n s ON node = s.key),
    ways AS (SELECT node AS src, source AS dst FROM pj WHERE k IS NOT NULL UNION SELECT node, target FROM oj WHERE kind = 'alternative' AND k IS NOT NULL), w AS (SELECT src, dst FROM ways UNION SELECT w.src, ways.dst FROM w JOIN ways ON w.dst = ways.src),
    fed AS (SELECT source AS node FROM pj JOIN n ON node = n.key WHERE n.type IN ('damages', 'exemplary_predicate', 'fees') UNION SELECT target FROM oj WHERE kind = 'alternative')
    SELECT key AS node, 'part not declared ' || part AS finding FROM n WHERE part = 4 UNION ALL SELECT key, 'no source' FROM n WHERE NOT sourced
    UNION ALL SELECT node, 'predicated on unknown ' || source FROM pj WHERE k IS NULL UNION ALL SELECT node, 'predicated on a node without yes or no ' || source FROM pj WHERE kt = 'damages'
    UNION ALL SELECT node, 'scope needs a per-party source ' || source FROM pj WHERE scope = 'any_party' AND NOT kp UNION ALL SELECT node, 'bad answer ' || answer FROM pj WHERE answer = 'Maybe'
    UNION ALL SELECT node, kind || ' unknown ' || target FROM oj WHERE k IS NULL UNION ALL SELECT node, 'alternative to a node that isn''t liability ' || target FROM oj WHERE kind = 'alternative' AND kt <> 'liability'
    UNION ALL SELECT node, 'blocks a node that isn''t damages ' || target FROM oj WHERE kind = 'blocks' AND kt <> 'damages' UNION ALL SELECT node, 'only a defense blocks' FROM oj WHERE kind = 'blocks' AND nt <> 'defense'
    UNION ALL SELECT src, 'cycle ' || src FROM w WHERE src = dst UNION ALL SELECT key, 'damages without liability in its chain' FROM n WHERE type = 'damages' AND key NOT IN (SELECT src FROM w JOIN n ON dst = key WHERE type = 'liability')
    UNION ALL SELECT key, 'liability without damages' FROM n WHERE type = 'liability' AND key NOT IN (SELECT node FROM fed)
    UNION ALL SELECT key, 'defense that blocks and predicates nothing' FROM n WHERE type = 'defense' AND key NOT IN (SELECT source FROM pj) AND key NOT IN (SELECT node FROM oj WHERE kind = 'blocks')
    UNION ALL SELECT node, 'unreachable if not asked ' || source FROM pj WHERE answer = 'No' AND source IN (SELECT node FROM pj) AND node NOT IN (SELECT node FROM oj WHERE kind = 'alternative')""")
def graph_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    nodes = n.selectExpr("concat('q', n_nationkey) as key", "cast(n_regionkey as string) as part", f"{TYPE} as type", "n_nationkey % 2 = 0 as per_party", "n_nationkey % 6 <> 5 as sourced")
    predicates = n.selectExpr("concat('q', n_nationkey) as node", "concat('q', n_nationkey + 1) as source", "if(n_nationkey % 8 = 0, 'Maybe', 'Yes') as answer", "if(n_nationkey % 5 = 0, 'any_party', 'any') as scope")
    others = n.where("n_nationkey % 3 = 0").selectExpr("concat('q', n_nationkey) as node", "concat('q', n_nationkey + 3) as target", "if(n_nationkey % 2 = 0, 'blocks', 'alternative') as kind")
    return R.validate(nodes, predicates, others, table(spark, sf_dir, "region").where("r_regionkey <> 4").selectExpr("cast(r_regionkey as string) as part"))


@query("""WITH e AS (SELECT o_custkey AS node, list_sort(list(DISTINCT o_orderpriority)) AS want FROM orders GROUP BY 1), p AS (SELECT o_custkey AS node, list_sort(list(DISTINCT CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderpriority END)) AS got FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1)
    SELECT node, CASE WHEN got IS NULL THEN 'missing' WHEN NOT list_contains(got, 'X') THEN 'matched' ELSE 'mismatch' END AS status, CASE WHEN list_contains(got, 'X') THEN 1 ELSE 0 END::INT AS n_unexpected FROM e LEFT JOIN p USING (node)""")
def route_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    expected = orders.select(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("route"))
    parsed = orders.where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("node"), F.expr("if(o_orderkey % 10 = 0, 'X', o_orderpriority)").alias("route"))
    return R.crosscheck(expected, parsed).select("node", "status", F.size("unexpected").alias("n_unexpected"))


@query("""WITH q AS (SELECT s_suppkey * 7 + CASE WHEN s_suppkey % 3 = 0 THEN 100000 ELSE 0 END AS want FROM supplier), s AS (SELECT p_partkey AS n FROM part)
    SELECT want, n AS section, 'exact' AS kind FROM q JOIN s ON n = want
    UNION ALL SELECT want, n, 'near' FROM (SELECT want, n, row_number() OVER (PARTITION BY want ORDER BY n) AS r FROM q JOIN s ON substr(n::VARCHAR, 1, 2) = substr(want::VARCHAR, 1, 2) WHERE want NOT IN (SELECT n FROM s)) WHERE r <= 8""")
def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section by number; else up to eight that share two leading characters, in numeric order."""
    want = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey * 7 + if(s_suppkey % 3 = 0, 100000, 0)").alias("want"))
    sections = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("section"))
    exact = want.join(sections, F.col("want") == F.col("section")).select("want", "section", F.lit("exact").alias("kind"))
    prefix = lambda c: F.substring(F.col(c).cast("string"), 1, 2)
    lost = want.join(sections, F.col("want") == F.col("section"), "left_anti").withColumn("p", prefix("want"))
    near = lost.join(sections.withColumn("p", prefix("section")), "p").withColumn("r", F.row_number().over(Window.partitionBy("want").orderBy("section"))).where("r <= 8")
    return exact.unionByName(near.select("want", "section", F.lit("near").alias("kind")))


@query("""WITH t AS (SELECT p_type AS term, list_sort(list(p_partkey)) AS c FROM part GROUP BY 1) SELECT term, unnest(c) AS section FROM t WHERE contains(lower(term), 'o')""")
def define_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("term")).agg(F.collect_list("p_partkey").alias("candidates"))
    return terms.where(F.contains(F.lower("term"), F.lit("o"))).select("term", F.explode("candidates").alias("section"))


CASES = """SELECT event_id, event_id % 13 <> 0 AS opinion_resolved, event_id % 31 = 0 AS override, CASE WHEN event_id % 17 <> 0 THEN 'text' END AS proposition, event_id % 7 = 0 AS quote_matched, (event_id * 37) % 900 AS opinion_chars,
    CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS name_cite_ok, event_id % 3 = 0 AS pincite_given, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS pincite_found, event_id % 2 = 0 AS unpaginated,
    event_id % 11 = 0 AS adverse, (event_id * 7) % 100 > 45 AS supports, ((event_id * 7) % 100) / 100.0 AS score, (event_id * 3 % 90) / 100.0 AS inextractability, event_id % 19 = 0 AS body_only, CASE WHEN event_id % 23 = 0 THEN 'applied_rule' END AS application FROM events"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.sql(CASES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return c.withColumns({k: F.col(k).cast("double") for k in ("score", "inextractability")})


VERDICT = f"""SELECT event_id, CASE WHEN NOT opinion_resolved THEN 'unable' WHEN override THEN 'verified' WHEN proposition IS NULL THEN 'prop_not_extracted' WHEN name_cite_ok = false AND NOT quote_matched THEN 'identity_unconfirmed'
    WHEN pincite_given AND pincite_found = false AND NOT unpaginated AND NOT quote_matched THEN 'pincite_not_found' WHEN adverse AND NOT quote_matched AND NOT (supports AND score >= 0.8) THEN 'cited_as_contrary' WHEN application IS NOT NULL THEN application
    WHEN inextractability >= 0.7 AND NOT quote_matched THEN 'does_not_support' WHEN body_only THEN 'flagged' WHEN NOT supports AND score = 0 AND inextractability = 0 THEN 'partial' WHEN quote_matched AND NOT (opinion_chars > 0 AND opinion_chars < 400) THEN 'verified'
    WHEN opinion_chars > 0 AND opinion_chars < 400 THEN 'flagged' WHEN inextractability >= 0.5 OR score < 0.3 THEN 'flagged'
    WHEN supports AND score > 0.5 THEN CASE WHEN pincite_given AND pincite_found = false AND unpaginated AND NOT quote_matched THEN 'pincite_unconfirmed' WHEN score >= 0.8 THEN 'verified' ELSE 'somewhat' END ELSE 'flagged' END AS verdict FROM ({CASES})"""


@query(VERDICT)
def verdict_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("event_id", G.verdict().alias("verdict"))


TIERS = """SELECT event_id, user_id, CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN NULL ELSE 5 END AS identity, CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE NULL END AS quote, CASE event_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE NULL END AS support, CASE event_id % 10 WHEN 0 THEN 4 ELSE NULL END AS treatment FROM events"""


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TIERS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")).withColumn("tier", G.worst_tier("identity", "quote", "support", "treatment"))


@query(f"SELECT event_id, coalesce(least(identity, quote, support, treatment), 5)::INT AS tier FROM ({TIERS})")
def severity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers(spark, sf_dir).select("event_id", F.col("tier").cast("int").alias("tier"))


@query(f"WITH t AS (SELECT coalesce(least(identity, quote, support, treatment), 5) AS tier FROM ({TIERS})) SELECT b.tier::BIGINT AS tier, count(t.tier) AS n FROM (SELECT unnest(range(1, 6)) AS tier) b LEFT JOIN t ON b.tier = t.tier GROUP BY b.tier")
def tier_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five buckets, empty ones too: counts first, then the join."""
    counts = tiers(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))
    return spark.range(1, 6).select(F.col("id").alias("tier")).join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"""WITH t AS (SELECT event_id, user_id, coalesce(least(identity, quote, support, treatment), 5) AS tier FROM ({TIERS})), a AS (SELECT *, min(tier::BIGINT * 1000000000 + event_id) OVER (PARTITION BY user_id) AS anchor FROM t)
    SELECT event_id, row_number() OVER (ORDER BY anchor, tier, event_id) AS place FROM a""")
def severity_order_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report order: clusters of an authority stay together, at the place of their worst member."""
    t = tiers(spark, sf_dir).select("event_id", "user_id", "tier")
    anchor = t.groupBy("user_id").agg(F.min(F.struct("tier", "event_id")).alias("anchor"))
    anchored = t.join(anchor, "user_id")
    bucket = F.struct(F.col("anchor.tier").alias("tier"), F.floor(F.col("anchor.event_id") / D.RANGE).alias("range"))
    return D.placed(anchored, bucket, ["anchor", "tier", "event_id"]).select("event_id", "place")


@query("SELECT first_line, count(DISTINCT source) AS owners FROM (SELECT source, string_split(text, chr(10))[1] AS first_line FROM documents) GROUP BY 1 HAVING count(DISTINCT source) > 1")
def shared_proposition_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("source", F.element_at(F.split("text", "\n", -1), 1).alias("first_line"))
    return lines.groupBy("first_line").agg(F.count_distinct("source").alias("owners")).where("owners > 1")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS dot, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) AS m FROM embeddings, q WHERE vec_id <> 0)
    SELECT vec_id, round(dot / n / m, 4) AS score FROM s ORDER BY round(dot / n / m, 4) DESC, vec_id LIMIT 10""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest to one query vector by cosine (a top-k report)."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    wanted = F.array(*(F.lit(float(x)) for x in vectors.where("vec_id = 0").first()["v"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(total(F.transform(a, lambda x: x * x)))
    score = F.round(total(F.zip_with("v", wanted, lambda a, b: a * b)) / norm(F.col("v")) / norm(wanted), 4)
    return vectors.where("vec_id <> 0").select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


# Lines of a text that aren't only spaces, put together by a running length that starts anew when it passes 800: a recursion over the lines.
@query("""WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, trim(line, ' ') AS line, length(trim(line, ' ')) AS len FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)) WHERE trim(line, ' ') <> ''),
    w AS (SELECT doc_id, i, len, 0 AS c, len + 2 AS n FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, p.len, CASE WHEN n + p.len > 800 THEN c + 1 ELSE c END, CASE WHEN n + p.len > 800 THEN p.len ELSE n + p.len + 2 END FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
    SELECT doc_id, c::INT AS i, (sum(len) + count(*) - 1)::INT AS n_chars FROM w GROUP BY doc_id, c""")
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "documents").select("doc_id", Z.chunks(F.col("text"), 800, "\n").alias("chunks"))
    return text.select("doc_id", F.posexplode("chunks").alias("i", "c")).select("doc_id", "i", F.length("c").alias("n_chars"))


@query()
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the chunks of ``chunk_paragraphs`` begin."""
    return Z.chunk_places(table(spark, sf_dir, "documents"), 800, "\n")


@query("SELECT doc_id, sum(length(text))::BIGINT AS n_chars, md5(text) AS text_md5 FROM documents WHERE length(text) > 0 GROUP BY doc_id, text")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 64 tokens at most, put together again in order: the texts."""
    found = Z.chunked(table(spark, sf_dir, "documents"), 64)
    parts = F.array_sort(F.collect_list(F.struct("start", "text")))
    whole = found.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("t"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))
    return whole.select("doc_id", "n_chars", F.md5("t").alias("text_md5"))


@query("""WITH RECURSIVE k AS (SELECT c_mktsegment, c_name, length(c_name) + 1 AS len, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS i FROM (SELECT DISTINCT c_mktsegment, c_name FROM customer WHERE c_name IS NOT NULL)),
    w AS (SELECT c_mktsegment, i, 0 AS b, 1 AS n, len AS c FROM k WHERE i = 1 UNION ALL SELECT k.c_mktsegment, k.i, CASE WHEN n + 1 > 250 OR c + len > 6400 THEN b + 1 ELSE b END, CASE WHEN n + 1 > 250 OR c + len > 6400 THEN 1 ELSE n + 1 END, CASE WHEN n + 1 > 250 OR c + len > 6400 THEN len ELSE c + len END FROM w JOIN k ON k.c_mktsegment = w.c_mktsegment AND k.i = w.i + 1)
    SELECT c_mktsegment, b::INT AS batch, count(*) AS n FROM w GROUP BY c_mktsegment, b""")
def batch_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique keys of each customer segment packed into batches of at most 250 keys and 6400 characters."""
    keys = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.array_sort(F.collect_set("c_name")).alias("keys"))
    packed = keys.select("c_mktsegment", F.explode(Z.batches(F.col("keys"), 250, 6400)).alias("batch"))
    return packed.groupBy("c_mktsegment", "batch").agg(F.count("*").alias("n"))


@query()
def sentence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.sentences(table(spark, sf_dir, "documents"))


@query()
def mask_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.masked(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("See 37 N.Y.3d 371 and "), "text").alias("text")))


@query("SELECT count(*) FILTER (event_type = 'click') AS n_open, count(*) FILTER (event_type <> 'click') AS n_closed, count(*) FILTER (value > 50) AS n_critical, bool_or(value > 50 AND event_type = 'click') AS blocked FROM events")
def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_, critical = F.col("event_type") == "click", F.col("value") > 50
    return table(spark, sf_dir, "events").agg(F.count_if(open_).alias("n_open"), F.count_if(~open_).alias("n_closed"), F.count_if(critical).alias("n_critical"), F.bool_or(critical & open_).alias("blocked"))


@query("SELECT o_orderpriority AS severity, o_orderkey AS question, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'")
def ledger_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings by severity, then question; places are within a severity."""
    w = Window.partitionBy("severity").orderBy("question")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderpriority").alias("severity"), F.col("o_orderkey").alias("question")).withColumn("place", F.row_number().over(w).cast("long"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys still to do: those without a finished row."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY ALL")
def latest_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event wins; max_by combines on the map side, unlike a window."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("SELECT source, count(*) AS pages, count(*) FILTER (length(text) < 200) AS gaps, round(100.0 * (count(*) - count(*) FILTER (length(text) < 200)) / count(*), 1)::DOUBLE AS complete FROM documents GROUP BY source")
def extraction_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.count_if(F.length("text") < 200)
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("pages"), gap.alias("gaps"))
    return rows.withColumn("complete", F.round(F.lit(100.0) * (F.col("pages") - F.col("gaps")) / F.col("pages"), 1))
