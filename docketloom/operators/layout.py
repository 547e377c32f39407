"""Text from positioned spans: visual lines, runs of one style, and the kind of a document.

A span is a row: doc_id, page, i (order), block, x0, x1, y, text, font, size, bold, italic, width (of the page). Lines and runs are gaps
and islands: windows over the spans of one page, which are few. Null texts are left out; a null style counts as plain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Distances that part lines and words, how much smaller small capitals are, families of one width, marks of a transcript, and shares that decide.
LINE_GAP, WORD_GAP, SMALL_CAPITALS = 2.0, 1.0, 0.75
STYLES = "semibold|demibold|bold|italic|regular|medium|light|black|heavy"
ONE_WIDTH = r"courier|consolas|mono|monospaced|arialmonospaced|lucidaconsole|dejavusansmono|liberationmono"
NUMBERED, ASKED = r"·\s*\d+\s*·", r"\b[QA]\s+|\b[QA]\.\s"
LEFT = 0.45
PAGE = ["doc_id", "page"]


def visual_lines(spans: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """``spans`` with ``line``: from 0 on a page, a new one where the next span lies more than ``gap`` lower."""
    down = Window.partitionBy(*PAGE).orderBy("y", "x0", "i")
    lower = F.coalesce(F.col("y") - F.lag("y").over(down) > gap, F.lit(False))
    return spans.where("text is not null and text <> ''").withColumn("_lower", lower.cast("int")).withColumn("line", F.sum("_lower").over(down).cast("int")).drop("_lower")


def family(font: Column) -> Column:
    """A font's name without its style and a subset's prefix, in lower case."""
    low = F.lower(F.regexp_replace(F.coalesce(font, F.lit("")), r"^[A-Z]{6}\+", ""))
    return F.regexp_replace(F.regexp_replace(low, "[-, ]", ""), STYLES, "")


def pieces(lines: DataFrame) -> DataFrame:
    """Spans of ``visual_lines`` from left to right with ``piece``: the text, after a space where a gap stands, and ``run``: a new one where bold, italic or size change.

    A single capital before smaller capitals of its family is their first letter: no space, and one run.
    """
    right = Window.partitionBy(*PAGE, "line").orderBy("x0", "i")
    plain = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = lines.withColumns({"_bold": plain("bold"), "_italic": plain("italic"), "_family": family(F.col("font")), "_t": F.trim("text")})
    upper = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    nxt = lambda c: F.lead(c).over(right)
    drop = (F.length("_t") == 1) & upper(F.col("_t")) & upper(nxt("_t")) & (nxt("_family") == F.col("_family")) & (nxt("_bold") == F.col("_bold")) & (nxt("size") <= F.col("size") * (SMALL_CAPITALS + 0.05))
    rows = rows.withColumn("_drop", F.coalesce(drop, F.lit(False)))
    rows = rows.withColumn("_size", F.round(F.when(F.col("_drop"), nxt("size")).otherwise(F.col("size")), 1)).withColumn("_italic", F.when(F.col("_drop"), nxt("_italic")).otherwise(F.col("_italic")))
    before = lambda c: F.lag(c).over(right)
    shown = F.when(F.col("_drop"), F.col("_t")).otherwise(F.col("text"))
    rows = rows.withColumn("_shown", shown)
    apart = (F.col("x0") > before("x1") + WORD_GAP) & ~before("_drop") & ~before("_shown").rlike(r"[ \t]$") & ~F.col("_shown").rlike(r"^[ \t]")
    rows = rows.withColumn("piece", F.concat(F.when(F.coalesce(apart, F.lit(False)), " ").otherwise(""), "_shown"))
    style = F.struct("_bold", "_italic", "_size")
    changes = F.coalesce(before(style) != style, F.lit(False)).cast("int")
    return rows.withColumn("_style", style).withColumn("_new", changes).withColumn("run", F.sum("_new").over(right).cast("int"))


def joined(rows: DataFrame, by: list[str]) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "i", "piece"))), lambda x: x["piece"])
    return rows.groupBy(*by).agg(F.array_join(parts, "").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y"))


def line_texts(spans: DataFrame) -> DataFrame:
    """doc_id, page, line, text, x0, x1, y of every visual line."""
    return joined(pieces(visual_lines(spans)), [*PAGE, "line"])


def style_runs(spans: DataFrame) -> DataFrame:
    """doc_id, page, line, run, bold, italic, size, text, x0, x1, y of every run of one style."""
    rows = joined(pieces(visual_lines(spans)), [*PAGE, "line", "run", "_style"])
    return rows.select(*PAGE, "line", "run", F.col("_style._bold").alias("bold"), F.col("_style._italic").alias("italic"), F.col("_style._size").alias("size"), "text", "x0", "x1", "y")


def document_types(spans: DataFrame) -> DataFrame:
    """doc_id, kind: 'two-column' where half of the pages have blocks on both sides, over 0.3 on the lesser, 0.25 on average; 'deposition' where half are mostly of one width and a third has
    line numbers or half questions and answers; else 'general'. All pages count; those without blocks on a side have no balance."""
    shown = spans.where("text is not null")
    fonts = shown.groupBy(*PAGE, family(F.regexp_replace("font", " ", "")).alias("family")).agg(F.sum(F.length("text")).alias("n"))
    mono = fonts.groupBy(*PAGE).agg(F.max_by("family", F.struct("n", "family")).rlike(ONE_WIDTH).alias("mono"))
    texts = shown.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x0", "i", "text"))), lambda x: x["text"]), " ").alias("t"))
    marks = texts.select(*PAGE, F.col("t").rlike(NUMBERED).alias("numbered"), F.col("t").rlike(ASKED).alias("asked"))
    blocks = shown.groupBy(*PAGE, "block").agg(((F.min("x0") + F.max("x1")) / 2).alias("x"), F.max("width").alias("w"))
    sides = blocks.groupBy(*PAGE).agg(F.count_if(F.col("x") < F.col("w") * LEFT).alias("l"), F.count_if(F.col("x") > F.col("w") * (1 - LEFT)).alias("r"))
    balance = sides.select(*PAGE, F.when(F.col("l") + F.col("r") > 0, F.least("l", "r") / (F.col("l") + F.col("r"))).alias("balance"))
    share = lambda c: F.avg(F.col(c).cast("double"))
    pages = mono.join(marks, PAGE).join(balance, PAGE).withColumn("even", F.when(F.col("balance").isNotNull(), F.col("balance") > 0.3))
    of = pages.groupBy("doc_id").agg(share("mono").alias("m"), share("numbered").alias("n"), share("asked").alias("a"), F.avg("balance").alias("b"), share("even").alias("e"))
    kind = F.when((F.col("e") >= 0.5) & (F.col("b") > 0.25), "two-column").when((F.col("m") >= 0.5) & ((F.col("n") >= 0.3) | (F.col("a") >= 0.5)), "deposition").otherwise("general")
    return of.select("doc_id", kind.alias("kind"))
