"""Large reference graphs: the lines of all orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import routing
from ..operators.resolve import routing_sentences
from ..operators.staging import dealt, large, stage
from .registry import query, table

LINES = """l AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS node, l_orderkey AS o FROM lineitem),
    s AS (SELECT node, o, row_number() OVER w AS i, lead(node) OVER w AS n, lag(node, 2) OVER w AS b FROM l WINDOW w AS (PARTITION BY o ORDER BY node)),
    c AS (SELECT o_orderkey AS o, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders),
    e AS (SELECT node AS src, n AS dst FROM s WHERE n IS NOT NULL UNION SELECT node, b FROM s WHERE b IS NOT NULL AND node % 3 = 0
        UNION SELECT t.node, h.node FROM c JOIN s t ON t.o = c.o AND t.n IS NULL JOIN s h ON h.o = c.next AND h.i = 1 WHERE c.o % 3 = 0)"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, o: the lines of an order in one part."""
    return dealt(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node"), F.col("l_orderkey").alias("o")), "o")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, order, the lines after and two before it in its order, and whether it is the first."""
    w = Window.partitionBy("o").orderBy("node")
    return order_lines(spark, sf_dir).distinct().select("node", "o", F.row_number().over(w).alias("i"), F.lead("node").over(w).alias("n"), F.lag("node", 2).over(w).alias("b"))


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line refers to the next of its order, every third back to the last but one, and a third of orders to the customer's next order."""
    back = F.when(F.col("node") % 3 == 0, F.col("b"))
    near = lines(spark, sf_dir).select(F.col("node").alias("src"), F.explode(F.array("n", back)).alias("dst")).where("dst is not null")
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("next"))
    ends = order_lines(spark, sf_dir).groupBy("o").agg(F.min("node").alias("dst"), F.max("node").alias("src"))
    last, first = large(ends.select("o", "src")), large(ends.select(F.col("o").alias("next"), "dst"))
    return near.union(c.where("o % 3 = 0 and next is not null").join(last, "o").join(first, "next").select("src", "dst"))


@query(f"""WITH RECURSIVE {LINES}, w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON w.dst = e.src),
    r AS (SELECT a.src AS node, min(a.dst) AS m FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src GROUP BY 1), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
    SELECT n.node, least(n.node, coalesce(m, n.node)) AS component FROM n LEFT JOIN r ON n.node = r.node""")
def line_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of the graph of all lines."""
    return G.components(line_edges(spark, sf_dir), lambda node: F.shiftright(node, 3))


@query(f"""WITH RECURSIVE {LINES}, w AS (SELECT node AS root, node FROM s WHERE i = 1 UNION SELECT root, dst FROM w JOIN e ON node = src)
    SELECT root, count(*) AS n_reached FROM w GROUP BY root""")
def line_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines the first line of each order leads to, itself included, over any number of steps."""
    roots = lines(spark, sf_dir).where("i = 1").select(F.col("node").alias("root"))
    return G.closure(line_edges(spark, sf_dir), roots, None).groupBy("root").agg(F.count("*").alias("n_reached"))


@query(f"""WITH RECURSIVE {LINES}, w AS (SELECT node AS root, node FROM s UNION SELECT root, dst FROM w JOIN e ON node = src), t AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS node, l_returnflag || l_linestatus AS type FROM lineitem)
    SELECT root AS key, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM w JOIN t USING (node) GROUP BY root""")
def line_chain_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of line on the chains from every line."""
    types = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), F.concat("l_returnflag", "l_linestatus").alias("type"))
    return G.chain_types(line_edges(spark, sf_dir), types, lambda node: F.shiftright(node, 3)).select("key", F.array_join("types", ",").alias("types"))


ROUTED = """r AS (SELECT node, o, i, lag(node) OVER (PARTITION BY o ORDER BY i) AS p FROM s)"""


@query(f"""WITH {LINES}, {ROUTED},
    x AS (SELECT o AS doc_id, i AS target, o % 5 = 0 AND node % 2 = 0 AS altered, o % 11 = 0 AND i = 2 AS lost FROM r WHERE i >= 2)
    SELECT doc_id, target::INT AS target, CASE WHEN lost THEN 'missing' WHEN altered THEN 'mismatch' ELSE 'matched' END AS status, CASE WHEN altered AND NOT lost THEN 1 ELSE 0 END::INT AS n_unexpected FROM x""")
def routing_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A charge for each order, a question a line: its routing sentences are written out, altered in some orders, left out in others, read back and checked against the map."""
    s = stage(lines(spark, sf_dir).withColumn("p", F.lag("node").over(Window.partitionBy("o").orderBy("i"))).withColumn("q", F.lag("node", 2).over(Window.partitionBy("o").orderBy("i"))), "charge")
    numbers = s.select(F.col("node").alias("key"), F.col("i").alias("number"))
    predicates = s.where("i >= 2").selectExpr("o as doc_id", "node", "p as source", "if(node % 2 = 0, 'Yes', 'No') as answer", "case node % 3 when 0 then 'any_party' when 1 then 'same_party' else 'all' end as scope", "node % 5 = 0 as unanimous", "1 as pos")
    others = s.where("i >= 3 and node % 4 = 0").selectExpr("o as doc_id", "node", "q as target", "'alternative' as kind", "1 as pos")
    said = routing_sentences(s.selectExpr("node as key", "if(node % 2 = 0, 'AND', 'OR') as logic"), predicates, others, numbers)
    rows = s.join(large(said), "node", "left").withColumn("sentence", F.when((F.col("o") % 11 == 0) & (F.col("i") == 2), "").otherwise(F.coalesce("sentence", F.lit(""))))
    told = F.when(F.col("o") % 5 == 0, F.replace("sentence", F.lit("“Yes”"), F.lit("“No”"))).otherwise(F.col("sentence"))
    told = F.when(F.col("o") % 7 == 0, F.regexp_replace(told, r"then answer Question No\. \d+", "then answer the following question")).otherwise(F.replace(told, F.lit(" "), F.lit("\n ")))
    part = F.concat(told, F.lit("\nQUESTION NO. 99 Did it happen?\nGRANTED: ____\n"))
    texts = rows.select("o", "i", part.alias("part")).groupBy(F.col("o").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("text"))
    want = routing.expected(predicates, others, s.selectExpr("o as doc_id", "node as key", "i as number"))
    return routing.checked(routing.routes(texts), want).select("doc_id", "target", "status", F.size("unexpected").alias("n_unexpected"))
