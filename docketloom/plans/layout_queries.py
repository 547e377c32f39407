"""Positioned spans, made of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import layout as L
from ..operators.staging import dealt
from .registry import query, table

SPAN = {
    "doc_id": "l_orderkey",
    "page": "l_linenumber % 2",
    "i": "l_partkey",
    "block": "l_suppkey % 5",
    "x0": "(l_partkey % 40) * 10.0",
    "x1": "(l_partkey % 40) * 10.0 + CASE WHEN l_quantity > 25 THEN 10.0 ELSE 5.0 END",
    "y": "(l_suppkey % 6) * 3.0 + (l_partkey % 3) * 0.5",
    "text": "CASE WHEN l_orderkey % 4 = 0 THEN concat('· ', l_linenumber, ' ·') WHEN l_orderkey % 4 = 1 THEN 'Q. why' ELSE concat('w', l_suppkey) END",
    "font": "CASE WHEN l_orderkey % 3 = 0 THEN 'Courier New-Bold' ELSE 'Times' END",
    "size": "10.0 + l_suppkey % 2",
    "bold": "l_partkey % 2 = 0",
    "italic": "false",
    "width": "420.0",
}
FIELDS = ", ".join(f"{e} AS {n}" for n, e in SPAN.items())
LINES = f"""s AS (SELECT DISTINCT {FIELDS} FROM lineitem), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, x0, i ORDER BY y, text, size, block, x1) AS u FROM s), b AS (SELECT * FROM a WHERE u = 1),
    g AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, x0, i) > 2 AS lower FROM b), l AS (SELECT *, coalesce(sum(lower::INT) OVER (PARTITION BY doc_id, page ORDER BY y, x0, i), 0)::INT AS line FROM g)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in SPAN.items()))
    rows = dealt(rows, "doc_id", "page").distinct()  # all that follows is of one page: nothing is dealt again
    w = Window.partitionBy("doc_id", "page", "x0", "i").orderBy("y", "text", "size", "block", "x1")
    return rows.withColumn("u", F.row_number().over(w)).where("u = 1").drop("u")


@query(f"""WITH {LINES}, t AS (SELECT *, CASE WHEN x0 > lag(x1) OVER w + 1 THEN ' ' ELSE '' END || text AS piece FROM l WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x0, i))
    SELECT doc_id, page::INT AS page, line, string_agg(piece, '' ORDER BY x0, i) AS text, min(x0) AS x0, max(x1) AS x1, min(y) AS y FROM t GROUP BY doc_id, page, line""")
def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page with their text."""
    return L.line_texts(spans(spark, sf_dir)).selectExpr("doc_id", "cast(page as int) as page", "line", "text", "cast(x0 as double) as x0", "cast(x1 as double) as x1", "cast(y as double) as y")


@query(f"""WITH {LINES}, t AS (SELECT *, coalesce(bold <> lag(bold) OVER w OR size <> lag(size) OVER w, false)::INT AS new FROM l WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x0, i)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, line ORDER BY x0, i)::INT AS run FROM t) SELECT doc_id, page::INT AS page, line, run, bool_and(bold) AS bold, max(size)::DOUBLE AS size, count(*) AS n FROM r GROUP BY doc_id, page, line, run""")
def style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one style; how many spans each has."""
    from pyspark.sql import functions as F

    rows = L.pieces(L.visual_lines(spans(spark, sf_dir)))
    return rows.groupBy("doc_id", F.col("page").cast("int").alias("page"), "line", "run").agg(F.bool_and("bold").alias("bold"), F.max("size").cast("double").alias("size"), F.count("*").alias("n"))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, page, block, (min(x0) + max(x1)) / 2 AS x FROM b GROUP BY ALL), c AS (SELECT doc_id, page, count(*) FILTER (x < 420 * 0.45) AS l, count(*) FILTER (x > 420 * (1 - 0.45)) AS r FROM k GROUP BY ALL),
    p AS (SELECT doc_id, CASE WHEN l + r > 0 THEN least(l, r) / (l + r) END AS bal FROM c), d AS (SELECT doc_id, avg(bal) AS avg_bal, avg((bal > 0.3)::INT) AS even FROM p GROUP BY doc_id)
    SELECT doc_id, CASE WHEN even >= 0.5 AND avg_bal > 0.25 THEN 'two-column' WHEN doc_id % 3 = 0 AND doc_id % 4 < 2 THEN 'deposition' ELSE 'general' END AS kind FROM d""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.document_types(spans(spark, sf_dir))
