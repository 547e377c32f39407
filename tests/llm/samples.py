"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
EXTRA = T.StructType([*SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in ("digest", "bucket", "key", "n", "copy_of", "_count"))])
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def sentence(n: int, step: int = 1, at: int = 0) -> str:
    return " ".join(WORDS[(at + i * step + i // 7) % len(WORDS)] + str(i % 11) for i in range(n))


TEXTS = [
    None,
    "",
    " \n\t ",
    "one two three",
    "Héllo wörld — don't stop, 123 ½ ² 日本語 text here  double  spaces\n\nnew line ",
    "<|endoftext|> inside <|endoftext|>",
    sentence(300),
    sentence(300),
    sentence(299) + " changed",
    sentence(9000, 3, 2),
    "!!! ### aaaaaaaaaaaa aaaa aaa 'tis we'll I'm",
    "same",
    "same",
    "same",
]


def table(spark, extra: bool = False):
    rows = [(i * 3 if i != 6 else None, t, "en", None if i == 4 else f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows.append(rows[-1])  # a repeated row
    if extra:
        return spark.createDataFrame([(*r, "x", "y", "z", "w", "v", "u") for r in rows], EXTRA)
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


SF = "/root/testdata/sf0.001"


def documents(spark, sf: str = SF):
    return spark.read.parquet(f"{sf}/documents.parquet")
