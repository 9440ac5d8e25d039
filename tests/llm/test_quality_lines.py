import re
from collections import Counter
from math import comb

import pytest
import xxhash
from pyspark.sql import functions as F

from inkspark.llm import linededup, quality

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    text = text or ""
    w = SPACE.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def awkward(spark, corpus):
    more = [(50, "a b c a b c x a b c", "en"), (51, "x\nx\n\n \n x\nx\ny", "en"), (52, "#* $ <b> é|é " * 30, "fr"), (53, "a a a a", None), (54, "\x0b\x0c a\rb c\x1fd", "de")]
    return corpus.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))


@pytest.mark.parametrize("table", ["corpus", "documents"])
def test_statistics(spark, request, table):
    docs = request.getfixturevalue(table)
    docs = awkward(spark, docs) if table == "corpus" else docs
    got = quality.statistics(docs.withColumn("t2", F.col("text"))).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(r.t2), r.doc_id


def test_tail_is_the_binomial_one(spark):
    rows = [(k, n) for n in (0, 1, 5, 40, 700) for k in (0, 1, 3, 40) if k <= n]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("p", F.expr(quality.binomial_tail("k", "n", 0.1)))
    for r in df.collect():
        exact = sum(comb(r.n, j) * 0.1**j * 0.9 ** (r.n - j) for j in range(r.k + 1)) if r.k <= r.n * 0.1 else 1
        assert abs(r.p - exact) < 1e-9


def labelled(spark):
    """Good rows of few symbols and bad ones of many, in two languages; a few good ones have as many."""
    rows = [(i, "word " * 60 + "# " * (30 if i % 4 == 0 or i % 8000 == 1 else 1), "en" if i % 3 else "de", i % 4 != 0) for i in range(8000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    # windows of three equal words repeat, so the base rule is kept out of the way
    docs = docs.withColumn("text", F.concat_ws(" ", F.expr("transform(split(trim(text), ' '), (w, i) -> CASE WHEN w = '#' THEN concat('#', i) ELSE concat(w, i) END)")))
    return docs, spark.createDataFrame([(r[0], int(r[3]), 0) for r in rows], "doc_id long, quality int, toxic int")


def test_admitted_cutoffs_reject_bad_rows_and_keep_good_ones(spark):
    docs, labels = labelled(spark)
    out = quality.verdicts(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in out}
    assert kept[0] == 0 and kept[1] > 0.99


def test_nothing_is_admitted_without_evidence(spark):
    docs, labels = labelled(spark)
    assert quality.verdicts(docs, labels.limit(40)).where("size(failed) > 0").count() == 0
    assert quality.verdicts(docs, labels.limit(0)).where("NOT kept").count() == 0
    flipped = labels.withColumn("quality", F.lit(1))
    assert quality.verdicts(docs, flipped).where("NOT kept").count() == 0


def test_quality_of_awkward_rows(spark, corpus, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality(awkward(spark, corpus), labels).collect()
    assert len(rows) == 16 and all(r.base_failed is not None and r.kept is not None for r in rows)
    assert quality.quality(nothing, labels).collect() == []


def brute_chunks(text):
    lines = text.split("\n")
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in lines]
    h = [(x - (1 << 64) if x >> 63 else x) % linededup.PRIME for x in h]
    z = [sum((h[i - j] if i >= j else 0) * pow(linededup.BASE, j, linededup.PRIME) % linededup.PRIME for j in range(linededup.WINDOW)) % linededup.PRIME for i in range(len(h))]
    ends = [i for i in range(len(z)) if i == len(z) - 1 or i > 0 and z[i] <= z[i - 1] and z[i] < z[i + 1]]
    first = 0
    for e in ends:
        yield first, lines[first : e + 1]
        first = e + 1


def brute_dedup(rows):
    """{(id, text): text without repeated chunks}; the first by id, text hash and place stays."""
    def text_hash(t):
        x = xxhash.xxh64_intdigest(t.encode(), seed=42)
        return x - (1 << 64) if x >> 63 else x

    places = {}
    docs = {(d, t) for d, t in rows if t is not None}
    for d, t in docs:
        for first, lines in brute_chunks(t):
            if len(lines) >= 2 and SPACE.search("\n".join(lines)):
                places.setdefault(tuple(lines), []).append((d is not None, d or 0, text_hash(t), first))
    out = {}
    for d, t in docs:
        stay = []
        for first, lines in brute_chunks(t):
            own = places.get(tuple(lines))
            if not own or min(own) == (d is not None, d or 0, text_hash(t), first):
                stay += lines
        out[d, t] = "\n".join(stay)
    return out


def line_corpus(spark):
    passage = "\n".join(f"shared line {i} of the passage" for i in range(14))
    rows = [(i, "\n".join([*(f"own {i} {j}" for j in range(i % 7)), passage, *(f"tail {i} {j}" for j in range(i % 5))])) for i in range(30)]
    rows += [(100, passage), (100, passage), (101, None), (102, ""), (103, "\n\n\n"), (104, "a\na\na\na\na\na"), (None, passage + "\nx"), (105, "a\na\na\na\na\na")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_line_dedup_agrees_with_brute_force(spark):
    rows, df = line_corpus(spark)
    want = brute_dedup(rows)
    got = linededup.dedup_lines(df.withColumn("original", F.col("text")).withColumn("first", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (None if r.original is None else want[r.doc_id, r.original]), r.doc_id
        if r.original is not None and r.text:
            assert r.n_lines - r.n_removed_lines == len(r.text.split("\n"))
    assert sum(r.n_removed_lines for r in got) > 200


def test_line_dedup_of_real_documents(documents):
    want = brute_dedup([(r.doc_id, r.text) for r in documents.collect()])
    got = linededup.dedup_lines(documents.withColumn("original", F.col("text")))
    for r in got.collect():
        assert r.text == want[r.doc_id, r.original]


def test_whole_runs_of_lines_are_removed(spark):
    short = [(1, "a 1\nrun 1\nrun 2\nb 1"), (2, "c 2\nrun 1\nrun 2\nd 2"), (3, "e 3\nrun 2\nf 3"), (4, "a 1\nrun 1\nrun 2\nb 1"), (5, "x\nx\nx\nx\nx"), (6, None), (7, ""), (8, "\n\n\n"), (9, "one")]
    short += [(20, "\n".join(f"p {i}" for i in range(9))), (21, "q\n" + "\n".join(f"p {i}" for i in range(3, 8)) + "\nr")]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(short, "doc_id long, text string"), whole=True).collect()}
    want = dict(short) | {2: "c 2\nd 2", 4: "", 5: "x\nx", 21: "q\nr"}
    # x x stays, and what follows it apart from it goes
    assert {d: r.text for d, r in got.items()} == want
    assert (got[2].n_removed_lines, got[21].n_removed_lines, got[21].n_removed_chunks, got[4].n_removed_lines) == (2, 5, 1, 4)


def test_hot_runs_are_dealt_to_parts(spark):
    # one passage in all texts, and groups of two so that it has most of the repeated windows
    rows = [(i, f"own {i}\nhot 1\nhot 2\nend {i}") for i in range(900)] + [(900 + i, f"pair {i // 2}\nof lines {i // 2}\nlast {i}") for i in range(40)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), whole=True).collect()}
    want = {i: f"own {i}\nend {i}" if i else rows[0][1] for i in range(900)} | {900 + i: f"last {i}" if i % 2 else rows[900 + i][1] for i in range(40)}
    assert got == want


def test_boundaries_resist_shifts():
    lines = [f"line {i * 7919 % 1000}" for i in range(200)]
    one = {tuple(c) for _, c in brute_chunks("\n".join(lines))}
    two = {tuple(c) for _, c in brute_chunks("\n".join(["new", *lines[:90], "more", *lines[90:]]))}
    assert len(one & two) >= len(one) - 6


def test_line_dedup_of_nothing(nothing):
    assert linededup.dedup_lines(nothing).collect() == []
