"""The training-corpus pipeline: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.llm import decontaminate, jaccard, mixing, quality, tokenids
from inkspark.llm.common import small, stored, table


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rules and the risk-controlled cutoffs keep.

    Null and empty texts have too few words and go; rows that repeat as a whole stay or go together; whole texts of any
    length count; without labels only the base rules decide; ties at a cutoff stay.
    """
    verdicts = quality.verdicts(docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("__hash")), table(spark, sf_dir, "labels"))
    rejected = verdicts.where("NOT kept").select("doc_id", "__hash").distinct().toDF("__id", "__hash")
    same = docs["doc_id"].eqNullSafe(rejected["__id"]) & F.xxhash64(docs["text"]).eqNullSafe(rejected["__hash"])
    return docs.join(rejected, same, "left_anti")


def jaccard_join(spark, docs, sf_dir):
    """One document of each group of five-word-shingle similarity 0.8 or more: that of the smallest id.

    Null, empty and wordless texts are linked with nothing and stay, as do rows without id; of rows that repeat an id one
    stays; texts of any length are compared whole; a pair of similarity 0.8 sharp is linked.
    """
    linked = jaccard.link(docs, k=5, percent=80)
    gone = linked.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # rows that repeat an id are one document
    return kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents without ten consecutive words of a benchmark item, or a whole shorter item.

    Null, empty and wordless texts hold nothing and stay; rows that repeat stay or go together; whole texts of any length
    are searched; an empty benchmark keeps all.
    """
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"))
    hit = decontaminate.search(own, table(spark, sf_dir, "benchmark"), keep=["doc_id", "__hash"]).where("size(__items) > 0")
    hit = stored(hit.select("doc_id", "__hash").distinct().toDF("__id", "__hash"), "hit")
    same = docs["doc_id"].eqNullSafe(hit["__id"]) & F.xxhash64(docs["text"]).eqNullSafe(hit["__hash"])
    return docs.join(small(hit), same, "left_anti")


def mixing_to_weights(spark, docs, sf_dir):
    """All documents in the order of the mixture, whose place is ``mix_pos``; target weights are the square roots of the sources' sizes.

    A null source is a source of its own; rows that repeat as a whole share the smallest of their places; texts are not
    looked at but for telling rows of one id apart; a column ``mix_pos`` that is there is replaced.
    """
    columns = [c for c in docs.columns if c != "mix_pos"]
    docs = docs.select(*columns).withColumn("__hash", F.xxhash64("text"))
    placed = mixing.mix(docs.select("doc_id", "source", "__hash"), mixing.target_weights(docs), key=["doc_id", "__hash"])
    # of rows that repeat as a whole each has a place of its own; the smallest stands for all
    places = placed.groupBy("doc_id", "__hash").agg(F.min("mix_pos").alias("mix_pos")).toDF("__id", "__own", "mix_pos")
    same = docs["doc_id"].eqNullSafe(places["__id"]) & docs["__hash"].eqNullSafe(places["__own"])
    return docs.join(places, same).select(*columns, "mix_pos")


def token_ids(spark, docs, sf_dir):
    """Token-id files in the order of the mixture; a row for each document, read back from them.

    Null and empty texts are an end id alone; rows that repeat are documents of their own; texts of any length are encoded
    whole; without ``mix_pos`` the order is that of the ids.
    """
    order = "mix_pos" if "mix_pos" in docs.columns else "doc_id"
    return tokenids.token_files(docs, order=order)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("token-ID / binary output", token_ids),
]

#: the tokenizer is beyond SQL; tests/llm/test_pipeline.py holds the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
