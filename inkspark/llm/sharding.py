"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are first dealt to logical partitions by a hash of their key.  From the
partition sizes the driver draws how many rows each partition sends to each
shard (a matrix of partitions x shards numbers): a random one among all tables
whose row sums are the partition sizes and whose column sums are the shard
sizes, with the probability that a uniform random permutation gives it, which is
multivariate hypergeometric, one partition after the other.  Each partition
then puts its rows into a random order and cuts it by its row of the matrix;
what a shard receives is put into a random order again.  So every assignment of
rows to slots has the same chance, shard sizes are exact, and no task sorts or
holds more than a logical partition.

Random orders are those of keyed 64-bit hashes, so a lost task's rows come out
as before.

Defined results: shard sizes differ by one at most; null ids and texts are keys
like others; rows that repeat as a whole get slots of their own; no rows give no
rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows of a logical partition, and of a slot bucket, on average
GROUP_ROWS = 20_000
MAX_GROUPS = 1 << 18


def communication_matrix(sizes, shards, seed):
    """Rows that each partition sends to each shard: row sums are ``sizes``, column sums are equal up to one."""
    rng = np.random.default_rng(seed)
    total = int(sum(sizes))
    left = np.full(shards, total // shards, np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(sizes), shards), np.int64)
    for i, n in enumerate(sizes):
        rest, n = int(left.sum()), int(n)
        for s in range(shards - 1):  # a shard at a time: hypergeometric given those before
            if not n:
                break
            rest -= int(left[s])
            k = _hypergeometric(rng, int(left[s]), rest, n)
            out[i, s] = k
            n -= k
        out[i, shards - 1] += n
        left -= out[i]
    return out


def _hypergeometric(rng, good, bad, n):
    """Like rng.hypergeometric, which takes up to 10**9; larger populations are split into parts that it takes."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    if n > (good + bad) // 2:  # the drawn and the left change places
        return good - _hypergeometric(rng, good, bad, good + bad - n)
    from math import sqrt

    mean = n * good / (good + bad)
    width = sqrt(mean * (1 - good / (good + bad)) * (good + bad - n) / max(1, good + bad - 1))
    low, high = max(0, n - bad), min(n, good)
    while True:  # rejection from a rounded normal with heavier spread, by the ratio of log probabilities
        x = int(round(rng.normal(mean, 1.2 * width + 1)))
        if low <= x <= high:
            z = (x - mean) / (1.2 * width + 1)
            if np.log(rng.random()) <= _log_ratio(x, int(mean), good, bad, n) + z * z / 2 - 0.05:
                return x


def _log_ratio(x, y, good, bad, n):
    from math import lgamma

    f = lambda k: -(lgamma(k + 1) + lgamma(good - k + 1) + lgamma(n - k + 1) + lgamma(bad - n + k + 1))
    return f(x) - f(y)


def shuffle_shards(df: DataFrame, key: list[str], shards: int = 16, seed: int = 1) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to shards - 1) and ``slot`` (long, gapless from 0 in each shard), by a uniform shuffle.

    ``key``: columns that tell rows apart.  Columns of these two names that ``df`` has are replaced.
    """
    spark = df.sparkSession
    rows = df.count()
    groups = int(min(MAX_GROUPS, max(8, -(-rows // GROUP_ROWS))))
    dealt = df.withColumn("__p", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(groups)).cast("int"))
    counted = {r["__p"]: r["count"] for r in dealt.groupBy("__p").count().collect()}  # a number for each logical partition
    sizes = [counted.get(p, 0) for p in range(groups)]
    matrix = communication_matrix(sizes, shards, seed)
    ends = np.cumsum(matrix, axis=1)
    cuts = spark.createDataFrame([(p, [int(x) for x in ends[p]]) for p in range(groups)], "__p int, __ends array<long>")
    # two rows share a first random order only if they are equal in their key; these are in no order to begin with
    place = F.row_number().over(Window.partitionBy("__p").orderBy(F.xxhash64(F.lit(seed + 1), *key), *key)) - 1
    sent = dealt.withColumn("__r", place).join(F.broadcast(cuts), "__p")  # at most MAX_GROUPS short rows
    sent = sent.withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__r"))).cast("int"))
    # the second permutation: buckets of a keyed hash in order, and an order in each
    buckets = int(max(1, min(MAX_GROUPS // shards, -(-rows // (shards * GROUP_ROWS)))))
    mixed = F.xxhash64(F.lit(seed + 2), *key)
    sent = sent.drop("__p", "__ends").withColumn("__b", F.pmod(mixed, F.lit(buckets)).cast("int"))
    # how many rows each bucket of each shard has, from a second run of the same deterministic steps
    filled = {(r["shard"], r["__b"]): r["count"] for r in sent.groupBy("shard", "__b").count().collect()}
    base, rows_of = [], {}
    for s in range(shards):
        at = 0
        for b in range(buckets):
            base.append((s, b, at))
            at += filled.get((s, b), 0)
        rows_of[s] = at
    base = spark.createDataFrame(base, "shard int, __b int, __base long")
    place = F.row_number().over(Window.partitionBy("shard", "__b").orderBy(F.xxhash64(F.lit(seed + 3), *key), *key, "__r")) - 1
    out = sent.withColumn("__s", place).join(F.broadcast(base), ["shard", "__b"])
    return out.select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", (F.col("__base") + F.col("__s")).alias("slot"))


def shards(docs: DataFrame, n: int = 16, seed: int = 1) -> DataFrame:
    """The contract's digest columns: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
    )
    out = shuffle_shards(narrow, ["doc_id", "size", "text_crc32"], n, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
