"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import contamination, debruijn, htmltext, licenses, mixing, ordinal, rules, sharding, simhash, substrings
from quern.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), rules.BASE, "_base"), rules.CURRENT)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "n_lines", "n_upper", "fail_bits")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = sharding.tree(8)
    return sharding.assign(table(spark, sf_dir, "documents"), leaves, more=sharding.grown(leaves))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.scored(docs, ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels"))))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.repeats(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.digest(debruijn.repeats(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_quality_rules, op3_mixing, op4_sharding, op5_quality_classifier, op6_html_text, op7_suffix_dedup, op8_simhash, op9_decontamination, op10_substring_dedup)
}
