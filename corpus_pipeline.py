"""A training-data pipeline over documents: rules, exact and near dedup, mixing, encoding.

Each stage is (spark, docs, sf_dir) -> DataFrame; what it returns is written as Parquet
and read again as the docs of the next. All but the last keep the columns of documents.

In every stage a null text is empty, an empty table gives an empty result, further columns
pass through whatever their names (but the last stage's), and texts may have any length.
Rows that are alike are rows of their own, of which dedup stages keep one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tensorloom.llm.bpe import encode_decode
from tensorloom.llm.common import read_table, tokenizer_path, written
from tensorloom.llm.exact_dedup import drop_duplicates
from tensorloom.llm.mixing import mixed_documents
from tensorloom.llm.near_dedup import drop_similar
from tensorloom.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps; empty texts go, rows that repeat are rated alike."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest doc_id, null being the smallest; of equal ones any one."""
    return drop_duplicates(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with five-word similarity of at least 0.8: that with the smallest doc_id, null being the largest."""
    return drop_similar(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own, texts without words go."""
    return mixed_documents(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with their digests; no text has no ids."""
    return encode_decode(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=True).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("bpe_encode", bpe_encode),
]

#: Similarity components, seeded blocks and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
