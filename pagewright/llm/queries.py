"""The numbered queries: each applies its operator to a whole table and returns the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, jaccard, language, lattice, mixing, oracles, repetition, resample, sharding, storage, token_counts, token_files, trie, urls, warc

URL_RULES = [urls.Rule("allow", "org"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 4-word shingles and the smallest document it is linked with, directly or not, at a Jaccard similarity of 0.85."""
    found = jaccard.joined(table(spark, sf_dir, "documents"), width=4, percent=85, links=False)
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def op1_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_jaccard with the number of different shingle sets that each document's is linked with."""
    found = jaccard.joined(table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in WARC archives, read back."""
    folder = storage.new_file_folder(spark, "warc")
    manifest = warc.write(table(spark, sf_dir, "pages"), folder, shuffles(spark))
    return warc.read(manifest, folder)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, or else by what the words of its names say, learned from the urls that the rules judge."""
    pages = table(spark, sf_dir, "pages")
    judged = urls.judged(pages.select("page_id", "url"), urls.word_counts(pages, "html"), URL_RULES)
    return judged.select("page_id", *(F.col(f"filter.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "score")))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, repeated spans and verdict."""
    judged = repetition.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "quality.*")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files of directly addressable codes and read back."""
    folder = storage.new_file_folder(spark, "token-files")
    manifest = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, folder, shuffles(spark))
    return token_files.read(manifest, folder)


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded over the lattice of its words' pieces; counts and digests of the ids, and whether they decode to the text."""
    return lattice.summary(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and whether they pass 4096."""
    docs = table(spark, sf_dir, "documents")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_counts.token_count(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards whose counts differ by one at most."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    placed = sharding.ring_shards(rows, F.col("doc_id"), F.col("text_crc32"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_ring.shard").alias("shard"), F.col("_ring.slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = language.fold(F.col("doc_id")) == 2
    model = language.fit(docs.filter(~held_out), F.col("doc_id"))
    found = language.identified(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in a mix of the sources at weights 3, 1, 2 that has one and a half times all words."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight towards the benchmark's texts, its score with noise, and its rank among the drawn 5 %."""
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    return {f.__name__: f for f in (op1_jaccard, op1_jaccard_links, op2_decontamination, op3_warc, op4_urls, op5_repetition, op6_token_files, op7_lattice, op8_token_counts, op9_sharding, op10_language, op11_mixing, op12_prefix_trie, op13_resampling)}


def oracle_sql():
    return {"op1_jaccard": oracles.OP1, "op1_jaccard_links": oracles.OP1_LINKS, "op3_warc": oracles.OP3, "op12_prefix_trie": oracles.OP12, "op13_resampling": oracles.OP13}
