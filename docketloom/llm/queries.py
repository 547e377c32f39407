"""The queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, late_overwrite, mixing, ngram_join, pieces, quality_rules, secret_scan, sharding, substring_dedup, token_store, toxicity, whitening
from .common import shared_dir, stage


def tokenizer_path(name: str) -> str:
    """Where the named public tokenizer lies; the file stays there."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.read_digests(spark, path)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir), num=75, den=100, shingle=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), window=50)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir), keep="largest")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(documents(spark, sf_dir), shards=24)
    return out.select(F.col("record.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), temperature=0.7, epochs=1.0, seed=29)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)


def op13_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet").select(*columns)
    n = sales.count()
    h, day = F.crc32(F.col("sale_id").cast("string")), late_overwrite.day_of(F.col("sold_at"))
    later = lambda c, days: F.col(c) + F.make_dt_interval(days.cast("int"))
    copies = sales.where((h % 3 == 0) & (day % 4 == 0)).withColumns({"total": F.col("total") + 1, "sold_at": later("sold_at", h % 2), "arrived_at": later("arrived_at", 1 + h % 97)})
    early = F.coalesce(F.col("arrived_at") < F.lit("2024-03-20 00:00:00").cast("timestamp_ntz"), F.lit(False))
    rows = sales.union(copies)
    first, late = stage(rows.where(early), "sales-early"), stage(rows.where(~early), "sales-late")
    layout = late_overwrite.Layout(shared_dir(spark, "sales-layout"), 1 + n // 1100, first.schema)
    late_overwrite.lay_out(first, layout)
    started = stage(late_overwrite.files_of(layout, spark), "sales-started")
    late_overwrite.take_in(late, layout)
    out = late_overwrite.report(layout, spark, "total", started)
    return out.select("day", "file_no", "n_rows", "cents", "rows_crc", "path", "columns", "ids_sha256", "rewritten")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_secret_scan": op8_secret_scan,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_pieces": op11_pieces,
    "op12_whitening": op12_whitening,
    "op13_late_overwrite": op13_late_overwrite,
}

def _secret_oracle() -> str:
    """Offsets from the lengths of the pieces between matches and of the matches."""
    parts, lists = [], []
    for k, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"regexp_extract_all(t, '{pattern}') AS h{k}, string_split_regex(t, '{pattern}') AS p{k}")
        keep = f"length(regexp_extract(h{k}[i], '{pattern}', {rule.group})) >= {rule.least}" if rule.least else "true"
        begin = f"list_sum(list_transform(p{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h{k}[1:i-1], lambda x: length(x))), 0)"
        lists.append(f"list_transform(list_filter(range(1, len(h{k}) + 1), lambda i: {keep}), lambda i: {{'s': ({begin})::BIGINT, 'k': {k}, 'e': ({begin} + length(h{k}[i]))::BIGINT, 'n': '{rule.kind}'}}) AS l{k}")
    text = lambda ks: f"array_to_string(list_transform(list_sort({' || '.join(f'l{k}' for k in ks)}), lambda x: x.n || ':' || x.s || ':' || x.e), ',')"
    n = len(secret_scan.RULES)
    return f"""
        WITH h AS (SELECT doc_id, {", ".join(parts)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        l AS (SELECT doc_id, {", ".join(lists)} FROM h)
        SELECT doc_id, len(l0)::BIGINT AS n_assign, len(l1)::BIGINT AS n_access, len(l2)::BIGINT AS n_hex,
               sha256({text(range(3))}) AS base_sha256, {text(range(n))} AS spans FROM l"""


ORACLES: dict[str, str] = {
    "op8_secret_scan": _secret_oracle(),
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_mixing": """
        WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        m AS (SELECT source, (SELECT sum(n) FROM n) / (SELECT sum(pow(n, 0.7)) FROM n) * pow(n, 0.7) / n AS mean FROM n),
        s AS (SELECT source, greatest(1, ceil(mean / 200))::INT AS parts, mean / greatest(1, ceil(mean / 200)) AS mean FROM m),
        c AS (SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM s
              UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM c WHERE k < ceil(mean + 10 * sqrt(mean) + 30)),
        l AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cdf FROM c GROUP BY source),
        u AS (SELECT d.*, cdf, j, ('0x' || substr(md5('29:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT / 4503599627370496.0 AS u
              FROM (SELECT d.*, l.cdf, unnest(range(1, l.parts + 1)) AS j FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source) d),
        t AS (SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cdf, lambda x: x <= u)))::INT AS count FROM u GROUP BY ALL)
        SELECT doc_id, text, lang, source, n_chars, copy, md5('29/order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS mix_key
        FROM (SELECT *, unnest(range(1, count + 1))::INT AS copy FROM t)""",
}
