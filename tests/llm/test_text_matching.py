import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspark.llm import decontaminate, jaccard
from inkspark.llm.textkernel import chunks, column, hashes, mix, words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_link(rows, k, percent):
    sets = [(d, shingle_set(t, k)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return Counter((d, len(s), root(d)) for d, s in sets)


@given(st.lists(st.text(st.sampled_from("aB é\t\n9.")), max_size=6))
@settings(max_examples=100, deadline=None)
def test_words(texts):
    import pyarrow as pa

    data, at = column(pa.array(texts, pa.string()))
    got = []
    for i, j, d, a in chunks(data, at, 5):
        starts, ends, w = words(d, a)
        h = hashes(d, starts, ends)
        for x in range(j - i):
            got.append([(bytes(d[s:e]).decode(), h_) for s, e, h_ in zip(starts[w[x] : w[x + 1]], ends[w[x] : w[x + 1]], h[w[x] : w[x + 1]])])
    assert [[p for p, _ in g] for g in got] == [SPACE.findall(t) for t in texts]
    seen = {}
    for g in got:
        for p, h_ in g:
            assert seen.setdefault(lower(p), h_) == h_
    assert len(set(seen.values())) == len(seen)


def edits(base, n, step):
    """Copies of a word list with ever other words changed."""
    return [" ".join(f"{w}x{c}" if (i + 7 * c) % step == 0 else w for i, w in enumerate(base)) for c in range(n)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 50)])
def test_links_agree_with_brute_force(spark, corpus, k, percent):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    i = 100
    for size in (6, 9, 20, 41, 150):
        base = [f"{size}a{j}" for j in range(size)]
        for text in [t for step in (9, 40, 90) for t in edits(base, 8, step)] + [" ".join(base + ["tail"] * n) for n in range(4)]:
            rows.append((i, text))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard.link(df, k, percent).collect())
    assert got == brute_link(rows, k, percent)


def test_links_of_real_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert Counter(tuple(r) for r in jaccard.link(documents, 4, 85).collect()) == brute_link(rows, 4, 85)


@pytest.mark.parametrize("stars", [0, 1])
def test_links_without_stars(spark, monkeypatch, stars):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", stars)
    base = [f"w{j}" for j in range(60)]
    rows = list(enumerate(t for step in (13, 25, 50) for t in edits(base, 9, step)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.link(df, 3, 80).collect()) == brute_link(rows, 3, 80)


@given(st.sets(st.integers(0, 400), min_size=1), st.sets(st.integers(0, 400), min_size=1))
@settings(max_examples=200, deadline=None)
def test_sketches_bound_the_difference(a, b):
    x, y = (np.unique(mix(np.array(sorted(s), np.uint64))) for s in (a, b))
    s, t = jaccard.bit_sketch(x, 80), jaccard.bit_sketch(y, 80)
    while len(s) != len(t):
        s, t = (v[: len(v) // 2] ^ v[len(v) // 2 :] if len(v) == max(len(s), len(t)) else v for v in (s, t))
    assert sum(bin(int(v) & (1 << 64) - 1).count("1") for v in s ^ t) <= len(a ^ b)


@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 40), st.sampled_from([50, 80, 85]))
@settings(max_examples=300, deadline=None)
def test_similar_sets_meet_in_a_lane(common, one, two, percent):
    n = mix(np.arange(common + one + two, dtype=np.uint64))
    x, y = np.unique(n[: common + one]), np.unique(np.concatenate([n[:common], n[common + one :]]))
    if len(x) and len(y) and (one or two) and 100 * common >= percent * (common + one + two):
        edges = jaccard.bands()
        assert set(jaccard.lane_keys(x, percent, edges).tolist()) & set(jaccard.lane_keys(y, percent, edges).tolist())


def test_null_ids_and_nothing(spark, nothing):
    assert jaccard.link(nothing).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.link(df, 4, 85).collect()} == {(None, 3, None), (1, 3, 1)}


def brute_hits(text, items, width):
    w = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for name, t in items:
        v = ALNUM.findall(lower(t))
        n = min(width, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for s in range(len(w) - n + 1):
                if w[s : s + n] == v[i : i + n]:
                    hit.update(range(s, s + n))
                    found.add(str(name))
    return len(w), len(hit), found


@pytest.mark.parametrize("max_block", [decontaminate.MAX_BLOCK, 5])
def test_contamination_agrees_with_brute_force(spark, corpus, monkeypatch, max_block):
    items = [(1, "Brown fox JUMPS over-the lazy"), (2, "the the"), (3, None), (4, " ... "), (5, " ".join(f"w{i % 977}x{i}" for i in range(990, 1010))), (6, "été 日本語"), (7, "Brown fox JUMPS over-the lazy"), (10, "two spaces its")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.search(corpus, bench, max_block=max_block, keep=["doc_id", "text"]).collect()
    for r in found:
        n, hit, names = brute_hits(r.text, items, 10)
        covered = sum(r["__ranges"][1::2]) - sum(r["__ranges"][::2])
        assert (r["__n_words"], covered, set(r["__items"])) == (n, hit and len(range(hit)), names)
    digests = decontaminate.contamination(corpus, bench).collect()
    for r in digests:
        text = next(x.text for x in found if x.doc_id == r.doc_id)
        n, hit, names = brute_hits(text, items, 10)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), decontaminate.digest(names), hit > 0)


def test_contamination_of_nothing(corpus, nothing, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(nothing, bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(corpus, bench).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha x y z beta gamma"), (3, "alpha beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    near = {r.doc_id for r in decontaminate.search(docs, bench, slop=1).where("size(__items) > 0").collect()}
    assert near == {1, 3}
    assert {r.doc_id for r in decontaminate.search(docs, bench).where("size(__items) > 0").collect()} == {3}
