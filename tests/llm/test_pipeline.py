"""The pipeline against plain Python, stage by stage on all that the stage before kept."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_quality_lines import brute_statistics
from test_text_matching import brute_hits, brute_link

import corpus_pipeline
from inkspark.llm import decontaminate, licenses, linededup, mixing, quality, sharding, tokenids, warc, wrappers
from inkspark.llm.common import stored

SF = "/root/testdata/sf0.001"


def brute_quality(docs):
    for r in docs:
        n, _, _, _, rep = brute_statistics(r.text)
        if n >= 50 and 100 * rep <= 50 * n:
            yield r


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    docs = stored(stages["quality rules"](spark, docs, SF), "t")
    kept = docs.collect()
    assert docs.columns == columns and {r.doc_id for r in kept} == {r.doc_id for r in brute_quality(rows)}  # too few labels here to admit a cutoff

    docs = stored(stages["n-gram Jaccard join"](spark, docs, SF), "t")
    want = {d for d, _, c in brute_link([(r.doc_id, r.text) for r in kept], 5, 80) if d == c}
    kept = docs.collect()
    assert docs.columns == columns and sorted(r.doc_id for r in kept) == sorted(want) and len(want) < len(rows)

    docs = stored(stages["benchmark decontamination"](spark, docs, SF), "t")
    want = {r.doc_id for r in kept if not brute_hits(r.text, bench, 10)[1]}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == want and len(want) < len(kept)

    docs = stored(stages["mixing sources to target weights"](spark, docs, SF), "t")
    kept = docs.collect()
    assert docs.columns[: len(columns)] == columns and {r.doc_id for r in kept} == want
    assert sorted(r.mix_pos for r in kept) == list(range(len(kept)))

    out = stages["token-ID / binary output"](spark, docs, SF).collect()
    library = tokenids._encoder(tokenids.default_path()).library
    start, expected = 0, set()
    for r in sorted(kept, key=lambda r: r.mix_pos):
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        expected.add((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in out} == expected
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == expected


CLASHING = "n_words kept failed stratum quality rule cutoff rank part host lane lanes v size sketch component low high c shard slot text_hash first n key bytes chunk keeper place count item items ranges start n_tokens uri ids docs mix_block".split()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_awkward_rows(spark, corpus, nothing, name, stage):
    docs = corpus.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert len(rows) <= corpus.count()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns[: len(docs.columns)] == docs.columns and all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_operators_with_clashing_columns(spark, corpus):
    docs = corpus.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    n = corpus.count()
    assert linededup.dedup_lines(docs).count() == n
    assert quality.verdicts(docs, docs.select("doc_id", F.lit(1).alias("quality"))).count() == n
    assert sharding.shuffle_shards(docs, ["doc_id", "text"], 3).count() == n
    assert mixing.mix(docs, key=["doc_id", "text"]).count() == n
    assert decontaminate.search(docs, spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")).count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h/x").alias("url"), F.col("text").alias("html"), *CLASHING)
    assert wrappers.extract_pages(pages).count() == n and warc.round_trip(pages).count() == n
    assert licenses.scan(docs).columns[0] == "doc_id"
