"""Checks of packages, over rows written out from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import packages as P
from .registry import query, table

ROWS = [
    "('document', 'body', 'p', '', if(o_orderkey % 3 = 0, 'style=Heading1;align=|II. ARGUMENT', 'style=Heading1;align=;num|ARGUMENT'))",
    "('document', 'body', 'p', '', concat('style=;align=;line=', if(o_orderkey % 4 = 0, 240, 480), '|One.', if(o_orderkey % 5 = 0, '  ', ' '), 'Two ', o_custkey))",
    "('document', 'end', 'p', '', 'style=;align=|Respectfully submitted,')",
    "('document', 'end', 'p', '', if(o_orderkey % 7 = 0, 'style=;align=|________', concat('style=;align=|/s/ Name', o_custkey)))",
    "('document', '', '/sectPr/pgSz', 'w', if(o_orderkey % 2 = 0, '12240', '11900'))",
    "('document', '', '/sectPr/pgSz', 'h', '15840')",
    "('footer', '', '/ftr/p/r/rPr/sz', 'val', if(o_orderkey % 9 = 0, '24', '20'))",
]
CHECKS = ["heading_numbering", "body_spacing", "double_spaces", "signature_block", "underscore_lines", "page_size", "footer"]
BROKEN = {"heading_numbering": "k % 3 = 0", "body_spacing": "k % 4 = 0", "double_spaces": "k % 5 = 0", "signature_block": "k % 7 = 0", "underscore_lines": "k % 7 = 0", "page_size": "true", "footer": "k % 9 = 0"}
COUNTS = {"page_size": "4 + (k % 2)", "footer": "2 + (k % 9 = 0)::INT"}


@query(" UNION ALL ".join(f"SELECT k AS order_key, '{c}' AS \"check\", CASE WHEN {BROKEN[c]} THEN 'FAIL' ELSE '{'WARN' if c == 'footer' else 'PASS'}' END AS status, ({COUNTS.get(c, f'({BROKEN[c]})::INT')})::INT AS n_broken FROM (SELECT o_orderkey AS k FROM orders)" for c in CHECKS))
def package_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as the rows of a package, broken by its number in some checks."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("path"), F.explode(F.array(*(F.expr(f"struct{r}") for r in ROWS))).alias("r"))
    rows = rows.select("path", F.col("r.col1").alias("part"), F.col("r.col2").alias("place"), F.col("r.col3").alias("elem"), F.col("r.col4").alias("attr"), F.col("r.col5").alias("value"))
    found = P.checked(rows, [r for r in P.core() if r.check in CHECKS])
    return found.select(F.col("path").cast("long").alias("order_key"), "check", "status", "n_broken")
