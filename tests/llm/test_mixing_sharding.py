from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.llm import mixing, sharding


@pytest.mark.parametrize("seed", range(12))
def test_every_block_runs_between_its_release_and_its_deadline(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 40))
    blocks, weights = rng.integers(0, 200, k).tolist(), (rng.random(k) ** rng.integers(1, 6) + 1e-9).tolist()
    if seed % 3 == 0:
        weights = [1.0] * k  # ties everywhere
    phases = {}
    for n, s in mixing.schedule(blocks, weights):
        phases.setdefault(n, []).append(s)
    used = [0] * k
    for order in phases.values():
        alive = [s for s in range(k) if used[s] < blocks[s]]
        total, had = sum(Fraction(weights[s]) for s in alive), dict.fromkeys(alive, 0)
        slack = Fraction(1, 10**6)  # of the grid and of floating weights
        for t, s in enumerate(order):
            w = Fraction(weights[s]) / total
            assert had[s] / w - 1 - slack < t < (had[s] + 1) / w + slack
            had[s] += 1
            used[s] += 1
        assert any(used[s] == blocks[s] for s in alive)
    assert used == blocks


@pytest.mark.parametrize("weights", [(1, 1, 1), (1, 10, 100), (1e-5, 1, 1), (3**0.5, 2**0.5, 1, 0.1)])
def test_a_million_slots_stay_within_a_block_of_the_given_weights(weights):
    w = [Fraction(x) for x in weights]
    total = sum(w)
    order = np.fromiter(mixing.phase([int(1_000_000 * x / total) + 5 for x in w], list(weights)), int)
    assert len(order) >= 1_000_000
    t = np.arange(1, len(order) + 1)
    for s, x in enumerate(w):
        assert abs(np.cumsum(order == s) - t * float(x / total)).max() < 1 + 1e-6


def test_slots_have_all_rows(spark):
    counts = [1000, 1, 64, 129, 0]
    rows = mixing.slots_table(spark, counts, [5.0, 1.0, 1.0, 2.0, 1.0], 64).orderBy("slot").collect()
    left, base = list(counts), 0
    for k, r in enumerate(rows):
        assert (r.slot, r.base, r.block) == (k, base, (counts[r.n] - left[r.n]) // 64)
        size = min(64, left[r.n])
        left[r.n] -= size
        base += size
    assert left == [0] * 5 and base == sum(counts) and mixing.slots_table(spark, [], []).count() == 0


@pytest.mark.parametrize("table", ["corpus", "documents", "nothing"])
def test_mixture_is_gapless_and_close_to_its_weights(request, table):
    docs = request.getfixturevalue(table)
    weights = {"a": 3.0, "src1": 9.0, "b": float("nan"), "c": -1}
    rows = mixing.mix(docs, weights, key=["doc_id", "text"], block_rows=2).collect()
    assert sorted(r.mix_pos for r in rows) == list(range(docs.count()))
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((r.doc_id, r.source) for r in docs.collect())
    for s in {r.source for r in rows}:
        own = sorted(rows, key=lambda r: r.mix_pos)
        blocks = [r.mix_block for r in own if r.source == s]
        assert blocks == sorted(blocks) and Counter(blocks).most_common(1)[0][1] <= 2


def test_first_phase_deviates_by_less_than_a_block(documents):
    rows = mixing.mix(documents, {"src1": 9.0}, block_rows=1).collect()
    names = sorted({r.source for r in rows})
    given = {s: 9.0 if s == "src1" else 1.0 for s in names}
    own = sorted(rows, key=lambda r: r.mix_pos)
    end = min(max(r.mix_pos for r in rows if r.source == s) for s in names)
    had = Counter()
    for r in own[: end + 1]:
        had[r.source] += 1
        assert all(abs(had[s] - given[s] / sum(given.values()) * (r.mix_pos + 1)) < 1 + 1e-9 for s in names)


def test_many_sources_and_clashing_names(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 601) AS source", "'own' AS mix_block", "'own' AS mix_slot", "'own' AS mix_pos", "'own' AS n", "'own' AS base")
    out = mixing.mix(docs, mixing.target_weights(docs), block_rows=2)
    assert out.columns == ["doc_id", "source", "n", "base", "mix_block", "mix_slot", "mix_pos"]
    rows = out.orderBy("mix_pos").collect()
    assert [r.mix_pos for r in rows] == list(range(3000)) and {r.n for r in rows} == {"own"} and len({r.doc_id for r in rows}) == 3000


def test_matrix_sums():
    m = sharding.communication_matrix([5, 0, 100, 17], 7, 1)
    assert m.sum(1).tolist() == [5, 0, 100, 17] and m.min() >= 0
    assert sorted(set(m.sum(0).tolist())) == [17, 18]


def test_matrix_is_hypergeometric():
    draws = np.array([sharding.communication_matrix([10, 30], 4, s)[0, 0] for s in range(4000)])
    assert abs(draws.mean() - 2.5) < 0.1
    assert abs(draws.var() - 10 * 0.25 * 0.75 * 30 / 39) < 0.15


def test_large_populations():
    rng = np.random.default_rng(1)
    got = np.array([sharding._hypergeometric(rng, 10**10, 3 * 10**10, 10**6) for _ in range(300)])
    assert abs(got.mean() - 250_000) < 150 and 300 < got.std() < 600


@pytest.mark.parametrize("table", ["corpus", "documents", "nothing"])
def test_shards(request, table):
    docs = request.getfixturevalue(table)
    rows = sharding.shards(docs, 16).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shards(docs.repartition(3), 16).collect()))


def brute_shards(df, key, shards, seed):
    """{(key, shard, slot)} by sorting rows in plain Python; Spark gives the keyed hashes alone."""
    hashes = df.select(*key, *[F.xxhash64(F.lit(seed + i), *key).alias(f"h{i}") for i in range(4)]).collect()
    groups = max(8, -(-len(hashes) // sharding.GROUP_ROWS))
    nulls_first = lambda r: tuple((x is not None, x) if x is not None else (False,) for x in (r[k] for k in key))
    parts = [sorted((r for r in hashes if r.h0 % groups == p), key=lambda r: (r.h1, nulls_first(r))) for p in range(groups)]
    sent = sharding.communication_matrix([len(p) for p in parts], shards, seed)
    received = {s: [] for s in range(shards)}
    for part, row in zip(parts, sent):
        at = 0
        for s, n in enumerate(row):
            received[s] += [(part[i], i) for i in range(at, at + n)]
            at += n
        assert at == len(part)
    buckets = max(1, min(sharding.MAX_GROUPS // shards, -(-len(hashes) // (shards * sharding.GROUP_ROWS))))
    out = Counter()
    for s, rows in received.items():
        order = sorted(rows, key=lambda x: (x[0].h2 % buckets, x[0].h3, nulls_first(x[0]), x[1]))
        out.update((*(r[k] for k in key), s, slot) for slot, (r, _) in enumerate(order))
    return out


@pytest.mark.parametrize("table", ["corpus", "documents", "nothing"])
@pytest.mark.parametrize("group_rows", [20_000, 9])
def test_shards_agree_with_brute_force(request, monkeypatch, table, group_rows):
    monkeypatch.setattr(sharding, "GROUP_ROWS", group_rows)
    docs = request.getfixturevalue(table).select("doc_id", "text")
    got = Counter((r.doc_id, r.text, r.shard, r.slot) for r in sharding.shuffle_shards(docs, ["doc_id", "text"], 5, 3).collect())
    assert got == brute_shards(docs, ["doc_id", "text"], 5, 3)


def test_extra_columns_stay(corpus):
    out = sharding.shuffle_shards(corpus.withColumnRenamed("lang", "count"), ["doc_id", "text"], 3)
    assert out.columns[:5] == ["doc_id", "text", "count", "source", "n_chars"] and out.count() == corpus.count()
