"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_rows`` rows, in a random but
repeatable order.  Block i (from 0) of a source of weight w is released at slot
floor(i / w) and due at slot ceil((i + 1) / w); one block runs per slot, and
of those released the one due first comes first.  With weights that add up to
one this schedule meets all deadlines, so that after any number t of slots a
source has had more than w*t - 1 and less than w*t + 1 blocks.

The schedule runs by the given weights, as whole shares of a grid of 2**60 parts, until a source has no block left; it
then starts anew with the weights of the others (a phase).  All rows are used once, none is dropped or repeated.

Earliest deadline first is sequential: what a slot takes depends on all slots before it.  So one task runs it, a row a
block of ``block_rows`` rows: it keeps two numbers for each source, writes slots as they come, and takes some two
microseconds a slot (a minute for 2 * 10**9 rows).  The table of slots is stored and joined to the rows; blocks, slots
and rows never come to the driver, which holds a count and a weight for each source.

Defined results: a null source is a source of its own; sources without a given weight, or with one that is no positive
number, share ``default`` weight; no rows give no rows; repeated rows each have a place of their own, those with equal
keys in any order; null keys and very long texts do not matter, as only keys and sources are looked at; input columns
named like the three that are added are replaced.
"""

from __future__ import annotations

import heapq
import itertools
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, trimmed

BLOCK_ROWS = 64
#: parts of all weights together, and slots that leave the task at a time
GRID = 1 << 60
BATCH = 65536
#: rows of a bucket of one source, on average, and buckets whose sizes are added up at a time
GROUP_ROWS = 5_000
BUCKETS = 1024
ADDED = ("mix_block", "mix_slot", "mix_pos")


def shared_out(weights):
    """Whole shares of ``GRID`` in proportion to the weights."""
    total = math.fsum(weights)
    shares = [max(1, int(w / total * GRID)) for w in weights]
    shares[shares.index(max(shares))] += GRID - sum(shares)
    return shares


def phase(blocks, weights):
    """The source of each slot, earliest deadline first, until one of the sources has had all its blocks."""
    shares = shared_out(weights)
    waiting = [(0, s, 0) for s in range(len(shares))]  # release, source, block
    ready, t = [], 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * GRID // shares[s]), s, i))
        due, s, i = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        yield s
        t += 1
        if i + 1 == blocks[s]:
            return
        heapq.heappush(waiting, ((i + 1) * GRID // shares[s], s, i + 1))


def schedule(blocks, weights):
    """(phase, source) of each slot of the whole mixture; blocks: how many each source has."""
    left, n = list(blocks), 0
    while alive := [s for s, b in enumerate(left) if b]:
        for k in phase([left[s] for s in alive], [weights[s] for s in alive]):
            left[alive[k]] -= 1
            yield n, alive[k]
        n += 1


def slots_table(spark, counts, weights, block_rows=BLOCK_ROWS) -> DataFrame:
    """(n, block, slot, base) of every block of sources with so many rows; ``base`` is the number of rows before its slot."""
    blocks = [-(-c // block_rows) for c in counts]

    def run(batches):
        if not sum(batch.num_rows for batch in batches):
            return
        had, base, first = [0] * len(blocks), 0, 0
        slots = schedule(blocks, weights)
        while part := [s for _, s in itertools.islice(slots, BATCH)]:
            block, bases = [], []
            for s in part:  # only a source's last block can be short
                block.append(had[s])
                bases.append(base)
                had[s] += 1
                base += block_rows if had[s] < blocks[s] else counts[s] - (blocks[s] - 1) * block_rows
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(range(first, first + len(part)), pa.int64()), pa.array(bases, pa.int64())], names=["n", "block", "slot", "base"])
            first += len(part)

    return spark.range(0, 1, 1, 1).mapInArrow(trimmed(run), "n int, block long, slot long, base long")


def ranked(dealt: DataFrame, key: list[str], seed: int) -> DataFrame:
    """``dealt`` (__n, __groups, ...) with ``__rank``, a random but repeatable order of each source's rows from 0.

    Rows go to buckets by a hash, as many as the source needs, and have an order in each; the buckets before one are
    added up in two steps, so that no task has all rows, or all buckets, of a source.
    """
    dealt = dealt.withColumn("__b", F.pmod(F.xxhash64(F.lit(seed), *key), F.col("__groups")))
    sizes = dealt.groupBy("__n", "__b").count().withColumn("__s", F.floor(F.col("__b") / BUCKETS))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    whole = sizes.groupBy("__n", "__s").agg(F.sum("count").alias("sum"))
    whole = whole.select("__n", "__s", F.coalesce(F.sum("sum").over(before("__n", "__s")), F.lit(0)).alias("__whole"))
    base = sizes.withColumn("__part", F.coalesce(F.sum("count").over(before("__n", "__s", "__b")), F.lit(0))).join(whole, ["__n", "__s"])
    base = base.select("__n", "__b", (F.col("__whole") + F.col("__part")).alias("__base"))
    inside = Window.partitionBy("__n", "__b").orderBy(F.xxhash64(F.lit(seed + 1), *key), *key)
    return dealt.withColumn("__r", F.row_number().over(inside) - 1).join(base, ["__n", "__b"]).withColumn("__rank", F.col("__base") + F.col("__r"))


def mix(docs: DataFrame, weights: dict | None = None, source: str = "source", key: list[str] | None = None, default: float = 1.0, block_rows: int = BLOCK_ROWS, seed: int = 1) -> DataFrame:
    """``docs`` with ``mix_block`` (block of the source), ``mix_slot`` (block of the mixture) and ``mix_pos`` (gapless from 0).

    weights: target weight of each source; the rest have ``default``.  key: columns that tell rows apart.
    """
    spark = docs.sparkSession
    key = key or ["doc_id"]
    kept = [c for c in docs.columns if c not in ADDED]
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    named = docs.select(*kept).withColumn("__source", name)
    counts = {r["__source"]: r["count"] for r in named.groupBy("__source").count().collect()}  # a number for each source
    names = sorted(counts)
    usable = lambda w: w if isinstance(w, (int, float)) and math.isfinite(w) and w > 0 else default
    given = [usable((weights or {}).get(s[1:])) if s != "null" else default for s in names]

    numbers = [(s, i, max(1, -(-counts[s] // GROUP_ROWS))) for i, s in enumerate(names)]
    numbers = spark.createDataFrame(numbers or [("", 0, 1)], "__source string, __n int, __groups long")
    out = ranked(named.join(F.broadcast(numbers), "__source"), key, seed).withColumn("mix_block", F.floor(F.col("__rank") / block_rows).cast("long"))
    slots = stored(slots_table(spark, [counts[s] for s in names], given, block_rows), "slots").toDF("__n", "mix_block", "mix_slot", "__first")
    out = out.join(slots, ["__n", "mix_block"])
    return out.select(*kept, "mix_block", "mix_slot", (F.col("__first") + F.pmod("__rank", F.lit(block_rows))).alias("mix_pos"))


def target_weights(docs: DataFrame, source: str = "source", power: float = 0.5) -> dict:
    """Target weights as a power of the sources' row counts: 1 keeps their shares, 0 makes them equal."""
    counts = docs.groupBy(F.col(source).cast("string").alias("s")).count().collect()  # a number for each source
    return {r["s"]: float(r["count"]) ** power for r in counts if r["s"] is not None}
