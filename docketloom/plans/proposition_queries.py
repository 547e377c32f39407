"""Propositions of citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import propositions as P
from ..operators.staging import dealt
from .registry import query, table

CITE = "(event_id % 900 + 1) || ' F.3d ' || (user_id % 800 + 1)"
RULE = "'The ' || event_type || ' rule bars every claim of party ' || user_id || ' for good'"
BRIEF = f"""CASE event_id % 10
    WHEN 0 THEN 'Prose stands here first. ' || {RULE} || '. See Smith v. Jones, ' || {CITE} || ', 36 (2d Cir. 2001). More prose follows in this place.'
    WHEN 1 THEN {RULE} || ', Smith v. Jones, ' || {CITE} || ' (2001), and nothing follows.'
    WHEN 2 THEN 'The claim fails now. See Smith v. Jones, ' || {CITE} || ' (2001) (holding that ' || {RULE} || ').'
    WHEN 3 THEN {RULE} || ', as \"a long settled rule of this state.\" Id. at 35. The next sentence is another one.'
    WHEN 4 THEN {RULE} || '. Id. at 36, a rule called \"the plain terms of any contract\" by many.'
    WHEN 5 THEN 'Body text stands here.' || chr(10) || chr(10) || '1 ' || {RULE} || '. See Roe v. Doe, ' || {CITE} || ' (1990). Nothing else.' || chr(10) || chr(10) || 'The body of the text goes on and on.'
    WHEN 6 THEN 'Body text stands here for a while.' || chr(10) || chr(10) || '2 See Roe v. Doe, ' || {CITE} || ' (1990) (quoting \"' || {RULE} || '\").' || chr(10) || chr(10) || 'The body goes on and on.'
    WHEN 7 THEN 'See Smith v. Jones, ' || {CITE} || ' (2001).'
    WHEN 8 THEN {RULE} || '. Yes. No. See Smith v. Jones, ' || {CITE} || ' (2001); Roe v. Doe, 5 U.S. 6 (1990).'
    ELSE 'No citation stands here at all.' END"""


@query(f"""WITH r AS (SELECT event_id, event_id % 10 AS k, {RULE} AS rule, lower((event_id % 900 + 1) || ' f3d ' || (user_id % 800 + 1)) AS key FROM events),
    b AS (SELECT event_id, k, rule, CASE WHEN k IN (3, 4) THEN NULL ELSE key END AS key FROM r WHERE k <> 9 UNION ALL SELECT event_id, k, rule, '5 us 6' FROM r WHERE k = 8)
    SELECT event_id, key, CASE k WHEN 2 THEN 'parenthetical' WHEN 3 THEN 'id_quote' WHEN 4 THEN 'id_prop' WHEN 5 THEN 'footnote' WHEN 6 THEN 'citing_parenthetical' ELSE 'host' END AS kind,
        CASE k WHEN 0 THEN rule || '.' WHEN 1 THEN rule || ', and nothing follows.' WHEN 3 THEN rule || ', as "a long settled rule of this state."' WHEN 6 THEN '"' || rule || '"' WHEN 7 THEN '' WHEN 2 THEN rule ELSE rule || '.' END AS proposition, k = 7 AS needs_attention FROM b""")
def citation_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in every place: after their sentence, inside it, with a parenthetical, as id., in footnotes, alone."""
    events = dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", "user_id")
    docs = events.select(F.col("event_id").alias("doc_id"), F.expr(BRIEF.replace("chr(10)", "char(10)").replace('\\"', '"')).alias("text"))
    found = P.propositions(docs)
    return found.select(F.col("doc_id").alias("event_id"), F.when(~F.startswith("key", F.lit("at ")), F.col("key")).alias("key"), "kind", "proposition", "needs_attention")
