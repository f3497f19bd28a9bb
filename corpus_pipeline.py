"""A corpus pipeline of five stages: quality rules, near-duplicates, personal data, mixing, token ids.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of `documents`, and each works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import mixing, personal_data, quality_rules, simhash, word_bpe
from quire.llm.common import drop_folder, fresh_folder
from quire.llm.queries import tokenizer_path

WEIGHTS = [3, 1, 2]  # over the sources by code point, in turn


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them, repeated rows alike."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id. Null and empty texts are alike;
    of rows that repeat a doc_id one stays; rows without a doc_id all stay."""
    return simhash.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the new text. A null text stays null; repeated rows
    are treated alike."""
    return personal_data.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice. A null source is one of its own, a null or
    empty text has no words and comes as often as a whole number of epochs says; rows equal in doc_id and text alike."""
    return mixing.mixed(docs, WEIGHTS)


def encode_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded of every row of the mix; a null text has no ids and an empty decoded text."""
    return word_bpe.encode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("token ids", encode_words),
]

ORACLE_SQL = None  # SQL can't express the fitted rules, the fingerprints or the merges; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written and read again, and goes when the next one is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                drop_folder(spark, f"{folder}/{k - 1}")
    return docs
