"""Resolution of cites by tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ladder as L
from .registry import query, table

# The same expressions in both dialects, over orders, customers and lines.
CITE = {
    "key": "CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE concat(o_custkey % 50, 'f3d', o_orderkey % 97) END",
    "court": "CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END",
    "year": "2000 + o_orderkey % 5",
    "database": "o_orderkey % 11 = 0",
}
CITE_WORDS = ["concat('acme', o_custkey % 40)", "concat('zeta', o_orderkey % 9)"]
LOOKUP = {"key": "concat(c_custkey % 50, 'f3d', c_custkey % 97)", "status": "CASE c_custkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 300 WHEN 2 THEN 404 ELSE 200 END"}
CANDIDATE = {"court": "CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END", "year": "2000 + c_custkey % 7", "published": "c_custkey % 2 = 0", "text_id": "CASE WHEN c_custkey % 6 <> 0 THEN c_custkey END", "key": "concat(c_custkey % 50, 'f3d', (c_custkey * 3) % 97)"}
CANDIDATE_WORDS = ["concat('acme', c_custkey % 40)", "concat('zeta', c_custkey % 9)"]
ENTRY = {"description": "CASE l_linenumber % 4 WHEN 0 THEN 'Order on motion' WHEN 1 THEN 'MEMORANDUM opinion' WHEN 2 THEN 'letter' ELSE 'Ruling' END", "slug": "concat('ACME', l_partkey % 40, '-v-zeta', l_suppkey % 9)"}
HAS_NAME, IS_SHORT = "o_orderkey % 10 <> 9", "o_orderkey % 10 = 8"


def sql_list(xs: list[str]) -> str:
    return "[" + ", ".join(xs) + "]"


def named(fields: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in fields.items())


NEED = "greatest(least(len(q), 2), ceil(len(q) / 2))"


def by_name(tier: int, after: str, court: str) -> str:
    """A name tier over the cites of ``after``: best candidate of each name, refused when year and address show another decision."""
    where = f"({court} IS NULL OR n.court IS NULL OR {court} = n.court)"
    return f"""p{tier} AS (SELECT cite_id, c.key, c.year, c.database, elsewhere, cand_id, n.year AS filed, n.key AS c_key, row_number() OVER (PARTITION BY cite_id ORDER BY len(list_intersect(q, have)) DESC, published DESC, cand_id) AS r
            FROM {after} c JOIN n ON text_id IS NOT NULL AND {where} AND len(q) > 0 AND len(list_intersect(q, have)) >= {NEED}),
        h{tier} AS (SELECT cite_id, cand_id AS match_id, CASE WHEN (key IS NULL OR key <> c_key) AND (key IS NOT NULL OR elsewhere) THEN false END AS identity FROM p{tier}
            WHERE r = 1 AND NOT coalesce(false AND abs(year - filed) > 1, false)),
        c{tier + 1} AS (SELECT * FROM {after} WHERE cite_id NOT IN (SELECT cite_id FROM h{tier}))"""


ORACLE = f"""WITH
    c1 AS (SELECT o_orderkey AS cite_id, {named(CITE)}, CASE WHEN NOT ({HAS_NAME}) THEN [] WHEN {IS_SHORT} THEN {sql_list(CITE_WORDS[:1])} ELSE {sql_list(CITE_WORDS)} END AS q, o_orderdate::DATE AS decided FROM orders),
    n AS (SELECT c_custkey AS cand_id, {named(CANDIDATE)}, {sql_list(CANDIDATE_WORDS)} AS have FROM customer),
    k AS (SELECT key, min(cite_id) AS text_id FROM c1 WHERE cite_id % 13 = 0 AND key IS NOT NULL GROUP BY key),
    h1 AS (SELECT cite_id, text_id AS match_id, NULL::BOOLEAN AS identity FROM c1 JOIN k USING (key)),
    c2 AS (SELECT * FROM c1 WHERE cite_id NOT IN (SELECT cite_id FROM h1)),
    m AS (SELECT key, status, c_custkey AS first FROM (SELECT {named(LOOKUP)}, c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY key ORDER BY status <> 200, c_custkey) = 1),
    t AS (SELECT cite_id, q, have, cand_id, cand_id - first AS place, len(q) = 0 OR len(list_intersect(q, have)) > 0 AS fine FROM c2 JOIN m USING (key) JOIN n ON cand_id IN (first, first + 1) WHERE status = 200 AND text_id IS NOT NULL),
    h2 AS (SELECT cite_id, cand_id AS match_id, NULL::BOOLEAN AS identity FROM t WHERE fine QUALIFY row_number() OVER (PARTITION BY cite_id ORDER BY place) = 1),
    c3 AS (SELECT *, cite_id IN (SELECT cite_id FROM t WHERE NOT fine) AS elsewhere FROM c2 WHERE cite_id NOT IN (SELECT cite_id FROM h2)),
    h3 AS (SELECT cite_id, cand_id AS match_id, NULL::BOOLEAN AS identity FROM c3 c JOIN n USING (key) WHERE text_id IS NOT NULL AND (c.court IS NULL OR n.court IS NULL OR c.court = n.court) QUALIFY row_number() OVER (PARTITION BY cite_id ORDER BY published DESC, cand_id) = 1),
    c4 AS (SELECT * FROM c3 WHERE cite_id NOT IN (SELECT cite_id FROM h3)),
    {by_name(4, "c4", "c.court")}, {by_name(5, "c5", "NULL")},
    e AS (SELECT l_orderkey * 10 + l_linenumber AS entry_id, l_shipdate::DATE AS filed, {named(ENTRY)} FROM lineitem),
    s AS (SELECT cite_id, elsewhere, entry_id, len(list_filter(q, lambda w: contains(lower(slug), w))) AS m, filed = decided AS same FROM c6 JOIN e ON filed BETWEEN decided - 1 AND decided + 1 WHERE regexp_matches(description, '(?i)\\b(ORDER|OPINION|MEMORANDUM|RULING)\\b')),
    h6 AS (SELECT cite_id, entry_id AS match_id, CASE WHEN elsewhere THEN false END AS identity FROM s WHERE m >= 2 QUALIFY row_number() OVER (PARTITION BY cite_id ORDER BY m + same::INT DESC, entry_id) = 1),
    h AS (SELECT 1 AS tier, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3 UNION ALL SELECT 4, * FROM h4 UNION ALL SELECT 5, * FROM h5 UNION ALL SELECT 6, * FROM h6)
    SELECT cite_id, tier, match_id, identity FROM c1 LEFT JOIN h USING (cite_id)"""


@query(ORACLE)
def resolution_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a cite: cache, lookup, address, name in and out of court, archive."""
    orders, customers, lines = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    pick = lambda fields: [F.expr(e).alias(n) for n, e in fields.items()]
    words = f"CASE WHEN NOT ({HAS_NAME}) THEN array() WHEN {IS_SHORT} THEN array({CITE_WORDS[0]}) ELSE array({', '.join(CITE_WORDS)}) END"
    cites = orders.select(F.col("o_orderkey").alias("cite_id"), *pick(CITE), F.lit("f").alias("family"), F.expr(words).alias("tokens"), F.to_date("o_orderdate").alias("decided"))
    cache = cites.where("cite_id % 13 = 0").select("key", F.col("cite_id").alias("text_id"))
    lookups = customers.select(*pick(LOOKUP), F.col("c_custkey").alias("pos"), F.expr("array(c_custkey, c_custkey + 1)").alias("clusters"))
    listed = {n: e for n, e in CANDIDATE.items() if n != "key"}
    candidates = customers.select(F.col("c_custkey").alias("cand_id"), F.col("c_name").alias("name"), *pick(listed), F.array(F.expr(CANDIDATE["key"])).alias("keys"), F.array(F.lit("f")).alias("families"), F.expr(f"array({', '.join(CANDIDATE_WORDS)})").alias("tokens"))
    entries = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"), F.to_date("l_shipdate").alias("filed"), *pick(ENTRY))
    return L.resolve(cites, cache, lookups, candidates, entries).select("cite_id", "tier", "match_id", "identity")
