"""One query for each operator of this folder, at production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, jaccard, licenses, linededup, mixing, quality, sharding, tokenids, warc, wrappers
from .common import table
from .oracles import FEW_LABELS


def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_ids(spark, sf_dir):
    return tokenids.token_files(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"), k=4, percent=85)


def op3_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    return mixing.mix(docs, mixing.target_weights(docs), key=["doc_id", "text_hash"]).drop("text_hash")


def op4_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"))


def op1_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)


def op2_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_html_extraction(spark, sf_dir):
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def op7_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def quality_rules_of_few_labels(spark, sf_dir):
    """op2's operator with limits that small tables can meet."""
    out = quality.verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"), **FEW_LABELS)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def benchmark_proximity(spark, sf_dir):
    """op10's operator with words up to two places off."""
    found = decontaminate.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join("items", ","))


QUERIES = {
    "quality_rules_of_few_labels": quality_rules_of_few_labels,
    "benchmark_proximity": benchmark_proximity,
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_warc": op5_warc,
    "op6_html_extraction": op6_html_extraction,
    "op7_license_scan": op7_license_scan,
    "op8_token_ids": op8_token_ids,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
