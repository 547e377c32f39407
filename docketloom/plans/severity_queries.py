"""Severity cards and must-verify reasons over synthesized results: every flag of a card follows from a line item's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import severity as V
from .registry import query, table

# The same expressions in both dialects; every branch of the trees is hit.
FLAGS = """k, k % 7 <> 0 AS opinion_resolved, CASE k % 5 WHEN 0 THEN 404 WHEN 1 THEN 300 ELSE 200 END AS lookup_status, k % 2 = 0 AS no_results, k % 3 = 0 AS outside_coverage,
    CASE k % 23 WHEN 0 THEN 'confirmed_wrong_case' WHEN 1 THEN 'confirmed_contrary' WHEN 2 THEN 'confirmed_supports' WHEN 3 THEN 'confirmed_does_not_support' END AS finding,
    k % 13 = 2 AS override, CASE k % 17 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS name_cite_ok, k % 11 = 0 AS docket_source, k % 4 <> 0 AS reporter_style,
    k % 3 <> 1 AS pincite_given, CASE k % 19 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS pincite_found, k % 29 = 0 AS unpaginated, k % 2 = 1 AS quote_marks,
    CASE WHEN k % 31 = 0 THEN ' ' ELSE 'some proposition' END AS proposition, k % 37 = 0 AS adverse, k % 6 = 0 AS quote_matched, l_discount * 10 > 4 AS supports,
    l_discount * 10 AS score, l_tax * 10 AS inextractability, (k * 131) % 3000 AS opinion_chars,
    CASE k % 41 WHEN 0 THEN 'distinguish' WHEN 1 THEN 'applied_rule' END AS application, CASE k % 9 WHEN 0 THEN 'negative' WHEN 1 THEN 'caution' WHEN 2 THEN 'not_checked' WHEN 3 THEN NULL ELSE 'clean' END AS treatment,
    k % 43 = 0 AS nested, CASE WHEN k % 2 = 0 THEN 'u' END AS url,
    CASE k % 10 WHEN 0 THEN 'FABRICATED' WHEN 1 THEN 'CLOSE' ELSE 'VERBATIM' END AS q1, CASE k % 12 WHEN 0 THEN 'FABRICATED' WHEN 1 THEN 'CLOSE' ELSE 'VERBATIM' END AS q2,
    CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS c1, k % 16 > 3 AS c2, k % 47 = 5 AS licensed, k % 53 < 9 AS alterations, k % 5 < 2 AS clean, k % 3 AS brackets, k % 4 > 2 AS dots, k % 4 AS nq"""
CARDS = "(l_orderkey * 7 + l_linenumber) AS k"
SQL = f"""f AS (SELECT {FLAGS} FROM (SELECT l_orderkey * 7 + l_linenumber AS k, l_discount, l_tax FROM lineitem)),
    s AS (SELECT *, (finding = 'confirmed_wrong_case') IS TRUE AS wrong, lookup_status = 404 AS gone,
        opinion_resolved AND name_cite_ok IS FALSE AND (finding = 'confirmed_wrong_case') IS NOT TRUE AND NOT override AS unconfirmed,
        opinion_resolved AND docket_source AND reporter_style AND (lookup_status = 404 OR pincite_found IS FALSE) AS docket,
        nq > 0 AS has, (nq > 0 AND q1 = 'FABRICATED' AND c1 IS TRUE) OR (nq > 1 AND q2 = 'FABRICATED' AND c2) AS absent, (nq > 0 AND q1 = 'FABRICATED' AND c1 IS NOT TRUE) OR (nq > 1 AND q2 = 'FABRICATED' AND NOT c2) AS unsure,
        CASE WHEN nq > 0 AND q1 = 'CLOSE' THEN 1 WHEN nq > 1 AND q2 = 'CLOSE' THEN 2 ELSE 0 END AS first_close FROM f),
    i AS (SELECT *, CASE WHEN NOT opinion_resolved THEN CASE WHEN gone AND no_results THEN CASE WHEN outside_coverage THEN 'outside_coverage:2' ELSE 'possible_nonexistent:2' END ELSE 'not_found:' END
            WHEN wrong THEN CASE WHEN gone THEN 'wrong_doc_coverage:2' ELSE 'wrong_case:1' END WHEN docket THEN 'wrong_doc_coverage:2' WHEN name_cite_ok IS FALSE THEN 'unconfirmed:2' ELSE 'confirmed:5' END AS identity,
        CASE WHEN NOT opinion_resolved THEN CASE WHEN has OR quote_marks THEN 'unchecked:' ELSE 'no_quote:' END WHEN override AND (finding = 'confirmed_supports') IS TRUE THEN 'verified_agent:5'
            WHEN NOT has THEN CASE WHEN quote_marks THEN 'present_unlocated:4' ELSE 'no_quote:' END WHEN (unconfirmed OR wrong OR docket) AND (absent OR unsure OR first_close > 0) THEN 'unchecked_identity:'
            WHEN absent THEN 'fabricated:1' WHEN unsure THEN CASE WHEN override THEN 'verified_agent:5' ELSE 'unconfirmed_absence:4' END
            WHEN first_close > 0 THEN CASE WHEN clean AND brackets + dots::INT > 0 THEN 'verify_brackets:4' ELSE 'misquote:3' END
            WHEN licensed THEN 'verified_licensed:5' WHEN alterations THEN 'verified_alterations:5' ELSE 'verified:5' END AS quote,
        CASE WHEN NOT opinion_resolved THEN 'unable:2' WHEN trim(proposition) = '' THEN 'no_proposition:4' WHEN unconfirmed THEN 'identity_unconfirmed:2' WHEN docket THEN 'wrong_document_recap:2' WHEN wrong THEN 'wrong_document:2'
            WHEN absent AND NOT override THEN 'superseded:' WHEN finding = 'confirmed_contrary' THEN 'contrary:1' WHEN override THEN 'supported:5' WHEN adverse AND NOT quote_matched AND NOT (supports AND score >= 0.8) THEN 'adverse_by_design:5'
            WHEN pincite_given AND pincite_found IS FALSE AND NOT unpaginated AND NOT quote_matched THEN 'page_not_found:4' WHEN application = 'distinguish' THEN 'cited_to_distinguish:4' WHEN application IS NOT NULL THEN 'applied_rule:4'
            WHEN inextractability >= 0.7 AND NOT quote_matched THEN 'does_not_support:3' WHEN quote_matched AND NOT opinion_chars BETWEEN 1 AND 399 THEN 'supported:5' WHEN opinion_chars BETWEEN 1 AND 399 THEN 'review:4'
            WHEN NOT supports AND score = 0 AND inextractability = 0 THEN 'text_unavailable:2' WHEN inextractability >= 0.5 OR score < 0.3 THEN 'review:4' WHEN supports AND score >= 0.8 THEN 'supported:5' WHEN supports AND score > 0.5 THEN 'somewhat:4' ELSE 'review:4' END AS support,
        CASE WHEN treatment IS NULL OR treatment = 'not_checked' THEN 'not_checked:' WHEN treatment = 'clean' THEN 'clean:5' ELSE treatment || ':4' END AS treat FROM s),
    t AS (SELECT *, [x for x in [try_cast(split_part(identity, ':', 2) AS INT), try_cast(split_part(quote, ':', 2) AS INT), try_cast(split_part(support, ':', 2) AS INT), try_cast(split_part(treat, ':', 2) AS INT)] if x IS NOT NULL] AS tiers FROM i),
    u AS (SELECT *, coalesce(list_min(tiers), 5) AS least, CASE WHEN nested THEN CASE WHEN opinion_resolved OR url IS NOT NULL THEN 5 ELSE 4 END ELSE coalesce(list_min(tiers), 5) END AS tier FROM t)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("k"), "l_discount", "l_tax").selectExpr(*_split(FLAGS))
    made = lambda r, c: f"named_struct('result', {r}, 'confirmed', {c}, 'licensed', licensed, 'alterations_only', alterations, 'clean', clean, 'brackets', cast(brackets as int), 'ellipses', int(dots))"
    return rows.withColumn("quotes", F.expr(f"slice(array({made('q1', 'c1')}, {made('q2', 'c2')}), 1, cast(nq as int))"))


def _split(columns: str) -> list[str]:
    """Select items of a list in SQL; commas inside brackets don't part them."""
    out, depth, item = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += ch
    return [*out, item]


@query(f"""WITH {SQL} SELECT k, split_part(identity, ':', 1) AS identity, split_part(quote, ':', 1) AS quote, split_part(support, ':', 1) AS support, split_part(treat, ':', 1) AS treatment, tier,
    CASE WHEN least < 5 THEN CASE WHEN split_part(identity, ':', 2) = least::VARCHAR THEN split_part(identity, ':', 1) WHEN split_part(quote, ':', 2) = least::VARCHAR THEN split_part(quote, ':', 1) WHEN split_part(support, ':', 2) = least::VARCHAR THEN split_part(support, ':', 1) ELSE split_part(treat, ':', 1) END END AS worst,
    tier = 5 AND least = 5 AS clean FROM u""")
def severity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four axes of every card, its tier, its worst row and whether all rows are clean."""
    rows = cards(spark, sf_dir).withColumnRenamed("clean", "q_clean")
    flat = rows.select("k", "nested", "opinion_resolved", "url", *V.card())
    graded = flat.withColumn("tier", V.card_tier())
    return graded.select("k", *(F.col(f"{a}.status").alias(a) for a in V.AXES), "tier", V.worst_status().alias("worst"), V.all_clean(F.col("tier")).alias("clean"))


@query(f"""WITH {SQL} SELECT status, tier, count(*) AS n FROM (SELECT unnest(['identity:' || identity, 'quote:' || quote, 'support:' || support, 'treatment:' || treat]) AS x FROM u) CROSS JOIN LATERAL (SELECT split_part(x, ':', 1) || ' ' || split_part(x, ':', 2) AS status, try_cast(split_part(x, ':', 3) AS INT) AS tier) GROUP BY ALL""")
def severity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each axis ends at each status."""
    rows = cards(spark, sf_dir).select(*V.card())
    long = rows.select(F.explode(F.array(*(F.struct(F.concat(F.lit(a + " "), F.col(f"{a}.status")).alias("status"), F.col(f"{a}.tier").alias("tier")) for a in V.AXES))).alias("r"))
    return long.groupBy("r.status", "r.tier").agg(F.count("*").alias("n"))


BRACKETED = "concat('the [judgment debtor', if(p_size % 3 = 0, '', ']'), ' owes ', if(p_size % 2 = 0, '[a] sum]', 'a sum'), ' to ', p_name)"


@query("""WITH w AS (SELECT p_partkey, unnest(string_split('the [judgment debtor' || CASE WHEN p_size % 3 = 0 THEN '' ELSE ']' END || ' owes ' || CASE WHEN p_size % 2 = 0 THEN '[a] sum]' ELSE 'a sum' END || ' to ' || p_name, ' ')) AS w, generate_subscripts(string_split('the [judgment debtor' || CASE WHEN p_size % 3 = 0 THEN '' ELSE ']' END || ' owes ' || CASE WHEN p_size % 2 = 0 THEN '[a] sum]' ELSE 'a sum' END || ' to ' || p_name, ' '), 1) AS i FROM part WHERE p_name IS NOT NULL),
    d AS (SELECT *, length(w) - length(replace(w, '[', '')) - length(w) + length(replace(w, ']', '')) AS step FROM w),
    r AS (SELECT *, sum(step) OVER p AS total, coalesce(sum(step) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WINDOW p AS (PARTITION BY p_partkey ORDER BY i)),
    m AS (SELECT *, before - least(0, coalesce(min(total) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS depth FROM r)
    SELECT p_partkey, string_agg(CASE WHEN depth > 0 OR contains(w, '[') OR contains(w, ']') THEN '1' ELSE '0' END, '' ORDER BY i) AS flags FROM m GROUP BY p_partkey""")
def bracket_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where("p_name is not null").select("p_partkey", V.in_brackets(F.expr(BRACKETED)).alias("f"))
    return rows.select("p_partkey", F.array_join(F.transform("f", lambda b: b.cast("int").cast("string")), "").alias("flags"))


RISK = """CASE k % 6 WHEN 0 THEN '2020 NY Slip Op 5(U)' WHEN 1 THEN NULL ELSE '1 F.3d 2' END AS cite_text, CASE k % 4 WHEN 0 THEN 'Justia' WHEN 1 THEN '' ELSE 'CourtListener' END AS opinion_source,
    CASE WHEN k % 9 = 0 THEN 'Patched from free source via gap manifest' END AS search_detail, CASE k % 15 WHEN 0 THEN 'A non-reporter copy' WHEN 1 THEN 'no reporter pagination' END AS pincite_note, k % 21 = 0 AS cite_contradicted, k % 26 = 0 AS address_mismatch,
    CASE k % 5 WHEN 0 THEN 'does_not_support' WHEN 1 THEN 'cited_as_contrary' WHEN 2 THEN 'somewhat' ELSE 'verified' END AS verdict"""


@query(f"""WITH {SQL}, r AS (SELECT *, {RISK} FROM s),
    x AS (SELECT *, [c for c in [CASE WHEN contains(cite_text, '(U)') THEN 'unpublished slip opinion' END, CASE WHEN k % 4 = 0 THEN 'free source' END, CASE WHEN search_detail IS NOT NULL THEN 'patched' END, CASE WHEN pincite_note IS NOT NULL THEN 'non-reporter copy' END,
        CASE WHEN name_cite_ok IS FALSE THEN 'identity gate failed' END, CASE WHEN cite_contradicted THEN 'address contradicted' END, CASE WHEN address_mismatch THEN 'address mismatch' END] if c IS NOT NULL] AS risks FROM r)
    SELECT k, CASE WHEN verdict = 'does_not_support' THEN 'contrary or unsupportive' WHEN unsure THEN 'unconfirmed fabricated quotation' WHEN absent AND lookup_status <> 200 THEN 'fabricated quotation without an address match'
        WHEN verdict = 'cited_as_contrary' AND len(risks) > 0 THEN 'adverse verdict' WHEN verdict = 'somewhat' AND score < 0.35 AND len(risks) > 0 THEN 'low confidence' END AS trigger, array_to_string(risks, '; ') AS risks FROM x""")
def must_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cards(spark, sf_dir).selectExpr("*", *_split(RISK)).withColumn("risks", V.high_risk())
    return rows.select("k", V.must_verify(F.col("verdict"), F.col("risks")).alias("trigger"), F.array_join("risks", "; ").alias("risks"))
