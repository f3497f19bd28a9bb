"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, digests, language, mixing, personal_data, quality_model, quality_rules, resampling, simhash, spelling, token_files, toxicity, word_bpe
from .common import fresh_folder, read
from .queries_sql import ORACLE_SQL as ORACLE_SQL


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    return language.predict_languages(read(spark, sf_dir, "documents"))


def op4_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical fingerprints of every document and of its edited text."""
    return digests.digest_report(read(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids in flat files, and what the files hold."""
    folder = fresh_folder(spark, "tokens")
    manifest = token_files.write_token_files(read(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(manifest)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a lexicon learned from those that are not held out."""
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with a lexicon and exact merges, and decoded."""
    coded = word_bpe.encode(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    ids = F.array_join("ids", " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of the sources takes."""
    return mixing.mix_report(read(spark, sf_dir, "documents"), weights=[3, 1, 2])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document, and whether the rules keep it."""
    return quality_rules.rule_report(read(spark, sf_dir, "documents"))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans by kind, and what the patterns add."""
    return personal_data.span_report(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicate_classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a discriminant learned from those that are not held out."""
    return quality_model.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that stand in a benchmark item's window of ten words, and those items."""
    found = decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the documents with the form it is a variant of."""
    return spelling.group_variants(read(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of the benchmark."""
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_digests": op4_digests,
    "op5_token_files": op5_token_files,
    "op6_toxicity": op6_toxicity,
    "op7_word_bpe": op7_word_bpe,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_model": op10_quality_model,
    "op11_decontamination": op11_decontamination,
    "op12_spelling": op12_spelling,
    "op13_resampling": op13_resampling,
}
