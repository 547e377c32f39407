"""Lines, matter and layers of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines as L
from .registry import query, table, texts


def joined(rows: DataFrame, by: str, at: str, text: str, between: str = "") -> DataFrame:
    """Texts written out from rows in the order of ``at``."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text])
    return rows.groupBy(F.col(by).alias("doc_id")).agg(F.concat_ws(between, parts).alias("text"))


@query("""SELECT user_id AS doc_id, string_agg('Line ' || event_id || ' of text' || CASE WHEN last THEN '' WHEN event_id % 4 = 1 THEN chr(10) || chr(10) ELSE ' ' END, '' ORDER BY event_id) AS text
    FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS last FROM events) GROUP BY user_id""")
def stitched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wraps, paragraphs, and pages with numbers and stamps between the lines of one text for each user."""
    line = F.expr("concat('Line ', event_id, if(event_id % 3 = 0, '  of\ttext ', ' of text'), case event_id % 4 when 0 then '\\n' when 1 then '\\n \\n' when 2 then '\\n\\n12\\n\\n' else '\\nFILED: today\\n' end)")
    docs = joined(table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line")), "user_id", "event_id", "line")
    return L.rows(docs, lambda t: [(L.stitched(t),)], "text string")


@query(r"""WITH d AS (SELECT doc_id, text AS t, 'Contents ........ 3' || chr(10) || 'INTRODUCTION' || chr(10) || text || chr(10) || 'Dated: now' AS b FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents))
    SELECT doc_id, md5(CASE WHEN length(b) < 500 THEN b ELSE regexp_replace('INTRODUCTION' || chr(10) || t, '\s+$', '') END) AS body_md5 FROM d""")
def argument_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the body of a brief, between a line of its contents and a closing."""
    docs = texts(spark, sf_dir).select("doc_id", F.concat(F.lit("Contents ........ 3\nINTRODUCTION\n"), "text", F.lit("\nDated: now")).alias("text"))
    return L.rows(docs, lambda t: [(L.argument(t),)], "body string").select("doc_id", F.md5("body").alias("body_md5"))


@query("""WITH p AS (SELECT p_size AS doc_id, p_partkey, row_number() OVER (PARTITION BY p_size, p_partkey % 50 ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 6 <> 5)
    SELECT doc_id, 'Smith' || (p_partkey % 50) || ' v. State' AS name, (p_partkey % 300) || ' F.3d ' || (p_partkey % 700) AS cite, CASE WHEN p_partkey % 4 = 0 THEN 'passim' ELSE '5,' || (10 + p_partkey % 9) END AS pages FROM p WHERE n = 1""")
def authority_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of authorities for each size of part: wrapped entries, leaders, statutes among them, names listed twice."""
    entry = F.expr("""if(p_partkey % 6 = 5, concat('Tax Code § ', p_partkey, ' ........ 7'), concat('Smith', p_partkey % 50, ' v. State,', if(p_partkey % 3 = 0, '\\n  ', ' '), p_partkey % 300, ' F.3d ', p_partkey % 700, '. ', if(p_partkey % 2 = 0, '........ ', ' . . . . . '), if(p_partkey % 4 = 0, 'passim', concat('5, ', 10 + p_partkey % 9))))""")
    rows = table(spark, sf_dir, "part").select("p_size", "p_partkey", F.replace(entry, F.lit(" . . . . . "), F.lit(" ..... ")).alias("entry"))
    docs = joined(rows, "p_size", "p_partkey", "entry", "\n").select("doc_id", F.concat(F.lit("A BRIEF\nTABLE OF AUTHORITIES\nCases\n"), "text", F.lit("\n\nARGUMENT\nSee the table of authorities.")).alias("text"))
    found = L.rows(docs, L.authorities, "name string, cite string, pages array<string>, key string")
    return found.select("doc_id", "name", "cite", F.array_join("pages", ",").alias("pages"))


@query("""WITH d AS (SELECT doc_id, substr(text, 1, length(text) // 2) || ' *987654321 ' || substr(text, length(text) // 2 + 1) AS t, length(text) // 2 + 1 AS p FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)),
    w AS (SELECT *, greatest(0, p - 9000) AS low, least(length(t), p + 9010) AS high FROM d)
    SELECT doc_id, md5(CASE WHEN length(t) <= 28000 THEN t WHEN low > 1500 THEN substr(t, 1, 1500) || chr(10) || '[...]' || chr(10) || substr(t, low + 1, high - low) ELSE substr(t, low + 1, high - low) END) AS window_md5 FROM w""")
def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents around the mark of a page that none has, which is put into their middle."""
    marked = texts(spark, sf_dir).select("doc_id", F.expr("concat(substr(text, 1, length(text) div 2), ' *987654321 ', substr(text, length(text) div 2 + 1))").alias("text"))
    return L.rows(marked, lambda t: [(L.page_window(t, "987654321"),)], "w string").select("doc_id", F.md5("w").alias("window_md5"))


@query("""WITH l AS (SELECT user_id AS doc_id, event_id, event_id % 5 AS m, CASE event_id % 5 WHEN 0 THEN (event_id % 90 + 1) || ' The note' WHEN 1 THEN '' ELSE 'goes on' END AS line FROM events),
    g AS (SELECT *, sum(CASE WHEN m < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY event_id) AS part FROM l)
    SELECT doc_id, (min(event_id) % 90 + 1)::INT AS number, (sum(length(line)) + count(*) - 1)::INT AS n_chars FROM g GROUP BY doc_id, part HAVING min(m) = 0 OR bool_or(m = 0)""")
def footnote_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered notes up to a blank line or the next note."""
    line = F.expr("case event_id % 5 when 0 then concat(event_id % 90 + 1, ' The note') when 1 then '' else 'goes on' end")
    docs = joined(table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line")), "user_id", "event_id", "line", "\n")
    return L.rows(docs, L.footnotes, "number int, start int, end int").select("doc_id", "number", (F.col("end") - F.col("start")).alias("n_chars"))


@query()
def single_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a turn a page, of which every third is there twice: characters, those that stay, and the share of doubled pages."""
    page = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n"), "text")).otherwise(F.col("text"))
    docs = joined(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(page, F.lit("")).alias("page")), "conv_id", "turn", "page", "\f")
    return L.rows(docs, lambda t: [(len(t), sum(len(L.single_layer(p)) for p in t.split("\f")), L.doubling(t.split("\f")))], "n_chars int, n_kept int, doubled double")


@query("""SELECT doc_id, CASE WHEN NOT contains(text, chr(10)) THEN ceil(length(text) / 5000.0)::BIGINT END AS n, length(text)::BIGINT AS n_chars, true AS fits FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents) WHERE length(text) > 0""")
def lookup_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 5,000 characters, cut at line ends: together the text; how many is shown for texts of one line. An empty text has none."""
    docs = texts(spark, sf_dir)
    found = L.rows(docs.withColumn("one", ~F.contains("text", F.lit("\n"))), lambda t, one: [(one, len(p), len(p) <= 5000) for p in L.split_at_lines(t, 5000)], "one boolean, n int, fits boolean", "one")
    return found.groupBy("doc_id").agg(F.when(F.bool_and("one"), F.count("*")).alias("n"), F.sum("n").alias("n_chars"), F.bool_and("fits").alias("fits"))
