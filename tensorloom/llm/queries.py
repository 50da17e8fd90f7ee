"""The queries opN_<name>: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .clustering import cluster
from .collocations import collocations
from .common import read_table, tokenizer_path, written
from .exact_dedup import exact_dedup
from .html_extract import extract
from .html_extract import train as train_extractor
from .licenses import scan_licenses
from .mixing import mix
from .pii import find_pii, summary
from .quality_model import score, train
from .quality_rules import ablation, apply_policy, rule_ledger
from .simhash import simhash_components
from .token_counts import count_tokens
from .warc import archive_round_trip


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = written(rule_ledger(read_table(spark, sf_dir, "documents")), "rule-ledger")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rated = apply_policy(ledger)
    return rated.select(*first, *[c for c in rated.columns if c not in first])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find_pii(read_table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("source")


def op6_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), tokenizer or tokenizer_path("byte_bpe_50k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read_table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer or tokenizer_path("byte_bpe_50k.tiktoken"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents")).drop("text_hash", "root")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, train_extractor(pages))


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy does by itself, from the bits of the ledger."""
    return ablation(rule_ledger(read_table(spark, sf_dir, "documents")))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can say."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can say."""
    return op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The numbered operators, and parts of their results that have an oracle."""
    parts = {f.__name__: f for f in (rules_ablation, pii_base, mixing_targets)}
    return {name: f for name, f in globals().items() if name.startswith("op")} | parts
