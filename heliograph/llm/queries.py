"""The operators over the given tables, as registered queries, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import (
    alignment,
    decontamination,
    minmax,
    packing,
    periodic_runs,
    perplexity_rules,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
    trusted_quality,
    url_rules,
    warc,
)
from heliograph.llm.common import table

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = 24
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Where a public tokenizer's file lies; the same on every machine of the cluster."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids."""
    pieces = packing.pack_documents(docs, tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *perplexity_rules.COUNTED, "base_failed", "kept", "mean_log", "low", "high")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn_lexicon(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score_toxicity(docs, lexicon, ["doc_id"]).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.feistel_shards(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_trusted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trusted_quality.quality_by_trust(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer_pattern() -> str:
    """How the byte-level tokenizer splits texts before merging."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.alignment_counts(docs, tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE), tokenizer_pattern())


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic_runs.periodic_runs(docs.select("doc_id", periodic_runs.repeated_by_rule(F.col("text"), number).alias("text")), ["doc_id"])
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.withColumn("top", periodic_runs.longest_run(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.minmax_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES
    ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS raw FROM rest),
parts AS (
    SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path
    FROM cut),
numbered AS (SELECT row_number() OVER () AS n, * FROM parts),
hits AS (
    SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
    FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY n)
SELECT page_id, host, path, rule, coalesce(hits.verdict, 'allow') AS verdict FROM numbered LEFT JOIN hits USING (n)
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_perplexity_rules": op2_perplexity_rules,
    "op9_trusted_quality": op9_trusted_quality,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op7_warc_normaliser": op7_warc_normaliser,
    "op6_feistel_sharding": op6_feistel_sharding,
    "op8_url_rules": op8_url_rules,
    "op10_decontamination": op10_decontamination,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_minmax_near_dedup": op13_minmax_near_dedup,
}

ORACLE_SQL = {"op8_url_rules": OP8_SQL}
