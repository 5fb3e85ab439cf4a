"""The operators as registered queries, and their SQL where it exists.

Each query applies its operator with production parameters to the whole table
and derives the digest columns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm import classifier, divergence, embeddings, licenses, mixing, packing, prefix_trie, quality_rules, secrets, simhash, token_counts, topk, warc
from mergeloom.llm.common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.digests(warc.read_archives(spark, path, payloads=False))


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.maintained(_table(spark, sf_dir, "documents"), scratch_path(spark, "rollup")).totals()


def op2_packing_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.digests(packing.pack(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "batch_id", "batch_row")


def op3_mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.Mix(_table(spark, sf_dir, "documents")).taken()
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"), anywhere=True)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secret_scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_live", "n_example", "most_owners", "most_repos")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "lang", "source")


def op11_balltree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns)).drop("node")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing_binary": op2_packing_binary,
    "op3_mixing_blocks": op3_mixing_blocks,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_embedding_itq": op5_embedding_itq,
    "op6_warc_segments": op6_warc_segments,
    "op7_simhash_golay": op7_simhash_golay,
    "op8_license_scan": op8_license_scan,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_balltree_topk": op11_balltree_topk,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_token_counts": token_counts.oracle_sql(),
    "op6_warc_segments": warc.oracle_sql(),
    "op8_license_scan": licenses.oracle_sql(),
    "op9_secret_scan": secrets.oracle_sql(),
    "op11_balltree_topk": topk.oracle_sql(),
    "op12_prefix_trie": prefix_trie.oracle_sql(),
    "op13_source_divergence": divergence.oracle_sql(),
}
