"""JSON corpora, ledgers and indexes: read with a fixed schema, written one document a file or one object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = "sectionNumber string, heading string, chapter string, text string, crossRefs array<string>, definedTerms array<string>"
TERMS = "term string, candidates array<struct<section:string,subsection:string,scope:string,definition:string>>"
FINDINGS = "id long, question string, node_key string, category string, severity string, finding string, disposition string, source string, history array<struct<ts:string,event:string,note:string>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that hold one array each; a file that can't be read fails, as a corpus must be whole."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, a file a partition. Nulls are written, so that readers see every field."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def cross_references(sections: DataFrame) -> DataFrame:
    """src, dst of the sections' cross-references that lead to a section of the corpus."""
    pairs = sections.select(F.col("sectionNumber").alias("src"), F.explode("crossRefs").alias("dst")).distinct()
    return pairs.join(sections.select(F.col("sectionNumber").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def candidates(terms: DataFrame) -> DataFrame:
    """One row for each candidate definition of a term."""
    return terms.select("term", F.explode("candidates").alias("c")).select("term", "c.*")
