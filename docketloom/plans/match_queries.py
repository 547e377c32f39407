"""Joins, windows, decision trees and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import grade as G
from ..operators import match as M
from .registry import query, table

STOPS = "['" + "','".join(N.CASE_STOPS) + "']"


def sql_tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({STOPS}, t)))"


@query(f"""
    WITH p AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS name, {sql_tokens("p_name || ' ' || p_type")} AS t FROM part),
    s AS (SELECT a.id AS left_id, b.id AS right_id, b.name, len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) AS score FROM p a JOIN p b ON a.id <> b.id)
    SELECT left_id, right_id, score FROM s WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, length(name) DESC, right_id) = 1""")
def toa_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name (as a cited name) against all others (as listed names)."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    parts = parts.withColumn("tokens", N.name_tokens(F.col("name")))
    return M.best_overlap(parts, parts, others=True)


@query("""
    WITH c AS (SELECT l_orderkey, l_linenumber, (l_partkey % 400) || ' F.3d ' || (l_suppkey * 7) AS cite FROM lineitem),
    t AS (SELECT DISTINCT lower(replace(cite, '.', '')) AS k FROM c WHERE l_linenumber = 1)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, lower(replace(cite, '.', '')) AS key, k IS NOT NULL AS listed FROM c LEFT JOIN t ON lower(replace(cite, '.', '')) = k""")
def toa_cite_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    cites = lines.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), N.cite_key(F.concat(F.col("l_partkey") % 400, F.lit(" F.3d "), F.col("l_suppkey") * 7)).alias("key"))
    listed = cites.where("l_linenumber = 1").select("key").distinct().withColumn("listed", F.lit(True))
    return cites.join(listed, "key", "left").select("l_orderkey", "l_linenumber", "key", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("""
    WITH a AS (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT DISTINCT o_custkey AS key FROM orders)
    SELECT key, 'body_only' AS side FROM b WHERE key NOT IN (SELECT key FROM a) UNION ALL SELECT key, 'toa_only' FROM a WHERE key NOT IN (SELECT key FROM b)""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"))
    return M.coverage_gaps(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), listed, "key")


CANDIDATES = """(SELECT c.p_partkey AS cite_id, s.p_partkey AS cand_id, c.p_size = s.p_size AND c.p_brand = s.p_brand AS exact,
    len(list_distinct(string_split(c.p_type, ' '))) AS want, len(list_intersect(string_split(c.p_type, ' '), string_split(s.p_type, ' '))) AS shared
    FROM part c JOIN part s ON c.p_brand = s.p_brand WHERE c.p_partkey <> s.p_partkey)"""


def candidates(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return M.nearest(part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("area"), F.col("p_size").alias("address"), F.split("p_type", " ").alias("tokens")), most)


@query(f"""SELECT cite_id, cand_id, exact FROM {CANDIDATES} WHERE exact OR (shared >= least(want, 2) AND 2 * shared >= want)
    QUALIFY row_number() OVER (PARTITION BY cite_id ORDER BY exact DESC, CASE WHEN exact THEN 0 ELSE -shared END, cand_id) = 1""")
def pick_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pick(candidates(spark, sf_dir, 1))


@query(f"""SELECT cite_id, cand_id, row_number() OVER (PARTITION BY cite_id ORDER BY exact DESC, shared DESC, cand_id) AS rank FROM {CANDIDATES}
    QUALIFY row_number() OVER (PARTITION BY cite_id ORDER BY exact DESC, shared DESC, cand_id) <= 3""")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published (here: exact) first, then overlap; three for each cite."""
    w = Window.partitionBy("cite_id").orderBy(F.desc("exact"), F.desc("shared"), "cand_id")
    return candidates(spark, sf_dir, 3).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("cite_id", "cand_id", "rank")


@query("""
    WITH m AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
    SELECT s_suppkey, coalesce(r_name = 'EUROPE', true) AS accepted FROM supplier LEFT JOIN m ON s_nationkey = n_nationkey""")
def jurisdiction_fail_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's region must be EUROPE; nations without a known region pass."""
    known = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return table(spark, sf_dir, "supplier").join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce(F.col("r_name") == "EUROPE", F.lit(True)).alias("accepted"))


@query("""
    WITH e AS (SELECT event_id, user_id, value > 80 AS ok FROM events),
    f AS (SELECT user_id, min(event_id) AS a FROM e WHERE ok GROUP BY user_id), g AS (SELECT user_id, min(event_id) AS b FROM e JOIN f USING (user_id) WHERE ok AND event_id > a GROUP BY user_id)
    SELECT event_id, CASE WHEN event_id = a THEN b ELSE a END AS sibling FROM e LEFT JOIN f USING (user_id) LEFT JOIN g USING (user_id)""")
def sibling_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each instance the first confirmed other instance of its authority: two smallest ids per key, no self join."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    first = F.slice(F.array_sort(F.collect_set(F.when(F.col("value") > 80, F.col("event_id")))), 1, 2)
    two = events.where("value > 80").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("rn <= 2").groupBy("user_id").agg(first.alias("two"))
    sibling = F.when(F.get("two", F.lit(0)) == F.col("event_id"), F.get("two", F.lit(1))).otherwise(F.get("two", F.lit(0)))
    return events.join(two, "user_id", "left").select("event_id", sibling.alias("sibling"))


@query("SELECT event_id, first_value(CASE WHEN value > 50 THEN 'u/' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS url FROM events")
def propagate_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    url = F.when(F.col("value") > 50, F.concat(F.lit("u/"), "event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.first(url, ignorenulls=True).over(w).alias("url"))


@query("SELECT event_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM events")
def page_before_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    marker = events.agg(F.min("event_type")).first()[0]
    return M.last_before(events, "user_id", "ts", F.col("event_id"), F.col("event_type") == marker, "page", ["event_id"]).select("event_id", "page")


@query("SELECT event_id, first_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS owner FROM events")
def quote_owner_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return M.next_after(events, "user_id", "ts", F.col("event_id"), F.col("value") > 50, "owner", ["event_id"]).select("event_id", "owner")


POS = "floor(epoch(ts))::BIGINT"


@query(f"""
    WITH e AS (SELECT user_id, event_id AS id, {POS} AS pos, value > 50 AS verb FROM events)
    SELECT a.id, b.id AS other_id, abs(a.pos - b.pos) AS distance FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.pos - b.pos) <= 90000 AND a.verb AND NOT b.verb
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY abs(a.pos - b.pos), b.id) = 1""")
def verb_near_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each strong event the closest weak one of its user within reach."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("pos"), (F.col("value") > 50).alias("verb"))
    pairs = M.within(e.where("verb").drop("verb"), e.where("not verb").drop("verb"), "user_id", 90000).withColumn("distance", F.abs(F.col("pos") - F.col("other_pos")))
    w = Window.partitionBy("id").orderBy("distance", "other_id")
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "other_id", "distance")


ADDRESS = """(SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_partkey % 3) || ' f3d ' || (l_suppkey % 3) AS cited, CASE WHEN l_linenumber = 3 THEN '' ELSE 'f' END AS family,
    CASE WHEN l_quantity < 10 THEN [] ELSE [(l_suppkey % 2) || ' f3d ' || (l_partkey % 2)] END AS record, CASE WHEN l_quantity < 10 THEN [] WHEN l_quantity < 30 THEN ['f'] ELSE ['us'] END AS families FROM lineitem)"""


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN cited = '' OR family = '' OR len(record) = 0 THEN 'no_data' WHEN list_contains(record, cited) THEN 'on_record'
    WHEN list_contains(families, family) THEN 'contradicted' ELSE 'not_on_record' END AS kind FROM {ADDRESS}""")
def address_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "cast(l_linenumber as bigint) as l_linenumber", "concat(l_partkey % 3, ' f3d ', l_suppkey % 3) as cited", "case when l_linenumber = 3 then '' else 'f' end as family",
        "case when l_quantity < 10 then cast(array() as array<string>) else array(concat(l_suppkey % 2, ' f3d ', l_partkey % 2)) end as record",
        "case when l_quantity < 10 then cast(array() as array<string>) when l_quantity < 30 then array('f') else array('us') end as families",
    )
    return rows.select("l_orderkey", "l_linenumber", M.address_check(*map(F.col, ("cited", "family", "record", "families"))).alias("kind"))


@query(f"""SELECT a.p_partkey AS id, CASE WHEN len({sql_tokens('a.p_name')}) = 0 OR len({sql_tokens('b.p_name')}) = 0 THEN 'nocompare' WHEN len(list_intersect({sql_tokens('a.p_name')}, {sql_tokens('b.p_name')})) > 0 THEN 'match' ELSE 'mismatch' END AS kind
    FROM part a JOIN part b ON b.p_partkey = a.p_partkey - 1""")
def caption_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    other = part.select((F.col("p_partkey") + 1).alias("id"), N.name_tokens(F.col("p_name")).alias("b"))
    both = part.select(F.col("p_partkey").alias("id"), N.name_tokens(F.col("p_name")).alias("a")).join(other, "id")
    kind = F.when((F.size("a") == 0) | (F.size("b") == 0), "nocompare").when(F.arrays_overlap("a", "b"), "match").otherwise("mismatch")
    return both.select("id", kind.alias("kind"))


CITED = {
    "volume": "CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat(doc_id % 90 + 10, '') END",
    "page": "CASE WHEN doc_id % 13 <> 0 THEN concat(doc_id % 700 + 1000, '') END",
    "docket": "CASE WHEN doc_id % 3 = 0 THEN concat('05-24-', doc_id + 10000, '-CV') END",
}
PRINTED = """CASE doc_id % 8 WHEN 0 THEN concat(text, ' 7 ', doc_id % 90 + 10, ' F.3d', chr(10), ' ', doc_id % 700 + 1000, '. ') WHEN 1 THEN concat(doc_id % 90 + 10, repeat(' x', 30), ' ', doc_id % 700 + 1000, ' ', text)
    WHEN 2 THEN concat(text, ' Smith', doc_id, ' and JONES', doc_id) WHEN 3 THEN concat(text, ' Smith', doc_id, ' alone') WHEN 4 THEN concat(text, ' No. 05 – 24-', doc_id + 10000, '-cv') WHEN 5 THEN concat('1', doc_id % 90 + 10, ' ', doc_id % 700 + 1000, ' ', text) ELSE text END"""


@query(f"""WITH c AS (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in CITED.items())}, {PRINTED} AS text FROM documents), l AS (SELECT *, regexp_replace(lower(text), '\\s+', ' ', 'g') AS low FROM c)
    SELECT doc_id, coalesce(length(text) >= 200, false) AND (coalesce(volume <> '' AND regexp_matches(low, '(?s)\\b' || volume || '\\b.{{0,' || (60 - length(volume) - length(page)) || '}}\\b' || page || '\\b'), false)
        OR coalesce(contains(low, 'smith' || doc_id) AND contains(low, 'jones' || doc_id), false) OR coalesce(contains(regexp_replace(low, '\\s*[-–—]\\s*', '-', 'g'), lower(docket)), false)) AS accepted FROM l""")
def identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against a cite of its own: volume and page, two names, a docket number, each printed in some documents, near misses in others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *(F.expr(e).alias(n) for n, e in CITED.items()), F.expr(PRINTED.replace("chr(10)", "char(10)")).alias("text"), F.expr("array(concat('Smith', doc_id), concat('Jones', doc_id), 'v')").alias("tokens"))
    return docs.select("doc_id", M.identity_gate(*map(F.col, ("text", "volume", "page", "tokens", "docket"))).alias("accepted"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS occurrence_index, count(*) OVER (PARTITION BY user_id, event_type) AS occurrence_count FROM events")
def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("occurrence_index"), F.count("*").over(w).alias("occurrence_count"))


@query("SELECT event_id, last_value(CASE WHEN value > 70 THEN event_type || '/' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS antecedent, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def antecedent_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance without a full cite of its own inherits the nearest one before."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    filled = M.last_before(events, "user_id", "ts", F.concat_ws("/", "event_type", "event_id"), F.col("value") > 70, "antecedent", ["event_id"])
    return filled.select("event_id", "antecedent", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


@query("""
    WITH l AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
    n AS (SELECT doc_id, pos, lower(substr(line, 1, 2)) AS id, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), pos + 1) - pos + length(line) AS span FROM l)
    SELECT id, doc_id, pos, span FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY span DESC, doc_id, pos) = 1""")
def longest_span_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
    span = F.coalesce(F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos")), F.col("pos") + 1) - F.col("pos") + F.length("line")
    named = lines.select("doc_id", "pos", F.lower(F.substring("line", 1, 2)).alias("id"), span.alias("span"))
    w = Window.partitionBy("id").orderBy(F.desc("span"), "doc_id", "pos")
    return named.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "doc_id", "pos", "span")


COURT = "CASE o_orderkey % 7 WHEN 0 THEN 'Supreme Court of the United States' WHEN 1 THEN 'Supreme Court, Kings County' WHEN 2 THEN 'Court of Criminal Appeals of Texas' WHEN 3 THEN 'Court of Appeals for the Fifth Circuit' WHEN 4 THEN 'Court of Appeals of Ohio' WHEN 5 THEN 'District Court' ELSE 'Municipal Court' END"


@query(f"""
    WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, {COURT} AS court FROM orders),
    w AS (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN 100 WHEN 1 THEN 40 WHEN 2 THEN 90 WHEN 3 THEN 80 WHEN 4 THEN 70 WHEN 5 THEN 50 ELSE 60 END AS weight FROM o)
    SELECT o_custkey, o_orderkey, weight, row_number() OVER (PARTITION BY o_custkey ORDER BY weight DESC, o_orderdate DESC, o_orderkey) AS rank FROM w
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY weight DESC, o_orderdate DESC, o_orderkey) <= 10""")
def topn_citing_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.expr(COURT).alias("court"))
    weighed = orders.withColumn("weight", G.court_weight(F.col("court"), F.lit("")))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("weight"), F.desc("o_orderdate"), "o_orderkey")
    return weighed.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select("o_custkey", "o_orderkey", "weight", "rank")


@query("""
    WITH s AS (SELECT user_id, event_id % 5 = 0 AS strong, (value::INT % 10) * 10 AS weight, event_id % 11 = 0 AS later, event_id % 3 AS op FROM events)
    SELECT user_id, CASE WHEN bool_or(strong AND (weight >= 80 OR later)) THEN 'negative' WHEN bool_or(strong) THEN 'caution' WHEN count(DISTINCT CASE WHEN NOT strong THEN op END) >= 2 THEN 'caution' ELSE 'none' END AS class FROM s GROUP BY user_id""")
def evidence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").selectExpr("user_id", "event_id % 5 = 0 as strong", "(cast(rint(value) as int) % 10) * 10 as weight", "event_id % 11 = 0 as later", "event_id % 3 as op")
    return s.groupBy("user_id").agg(G.evidence_class(*map(F.col, ("strong", "weight", "later", "op"))).alias("class"))
