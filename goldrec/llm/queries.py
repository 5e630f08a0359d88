"""The registered queries: each operator over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldrec.llm import (
    exact_repeats,
    filter_audit,
    html_layout,
    latent_votes,
    merkle,
    mixing,
    packing,
    postings,
    preferences,
    repetition,
    sharding,
    simhash,
    url_filter,
)
from goldrec.plans.durable import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = repetition.Limits()
    rows = repetition.repetition(table(spark, sf_dir, "documents"), limits=limits)
    over = F.col("longest_repeat") > limits.longest_repeat
    return rows.withColumn("has_long_repeat", over).drop("longest_repeat")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = postings.contamination(docs, bench, near=2 * postings.WINDOW)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
        F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"),
    )


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = simhash.hex_digits(F.col("fp")).alias("fingerprint")
    return found.select(F.col("key").alias("doc_id"), digits, "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = exact_repeats.without_repeats(table(spark, sf_dir, "documents"))
    zero = F.lit(0).cast("long")
    return cut.select(
        F.col("key").alias("doc_id"),
        "n_bytes",
        F.aggregate("spans", zero, lambda n, x: n + x["e"] - x["s"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = preferences.conversations(table(spark, sf_dir, "conversations"))
    pairs = preferences.format_preferences(preferences.with_earlier_reply(convs))
    return pairs.withColumns(
        {c: preferences.spans_text(c) for c in ("chosen_mask", "rejected_mask")}
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(sharding.reshard(table(spark, sf_dir, "documents")))


def shard_rows(placed: DataFrame) -> DataFrame:
    """The digest of ``sharding.reshard``, read from its files."""
    text = F.col("row.text")
    return placed.select(
        "row.doc_id",
        sharding.row_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.labelled_by_rules(pages))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(entropy=0.99, epochs=1.25)
    return mixing.mixed(table(spark, sf_dir, "documents"), mix).select(
        "row.doc_id",
        "source",
        mixing.n_tokens("row.text").alias("n_tokens"),
        "epoch",
        "block",
        "block_position",
        "exponent_ppm",
        "weight_ppb",
    )


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return latent_votes.score(docs, latent_votes.fit(docs, table(spark, sf_dir, "labels")))


def op10_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.visible_text(table(spark, sf_dir, "pages"))


#: The file that ``public_tokenizers.path`` names.
TOKENIZER = "word_bpe_49k.json"


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return placed.withColumnRenamed("key", "doc_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_hash(*fields, F.col("text"))
    changed = merkle.leaf_hash(*fields, F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select(F.col("doc_id").alias("key"), F.col("source").alias("group"), leaf.alias("leaf"), F.when(tampered, changed).alias("changed"))
    leaves = durable(leaves, "leaf-hashes").withColumn("claim", F.coalesce("changed", "leaf"))
    found = merkle.climb(merkle.build(leaves))
    return found.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit.audit(filter_audit.failed_sets(docs, labels))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_preference_format": op5_preference_format,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_quality_votes": op9_quality_votes,
    "op10_html_layout": op10_html_layout,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}
