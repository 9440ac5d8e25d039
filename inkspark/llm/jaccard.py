"""N-gram Jaccard join by parity sketches.

A document's shingle set is cut by shingle hash into P lanes, and a lane's
sketch is the XOR of its shingles' 64-bit hashes.  A shingle that only one of
two sets holds changes one lane, so the number of differing lanes (the Hamming
distance of the sketches, lane by lane) is a lower bound of the symmetric
difference.  Two sets of a and b shingles with similarity t differ in at most
``D = floor((1-t)/(1+t) * (a+b))`` shingles; with P = D + 1 + s lanes at least
s + 1 lanes are equal (pigeonhole).  P depends on sizes, so the join runs per
size band; a set takes part in its own band and in those that a partner of up
to 1/t times its size can be in.

Of its P lanes a set leaves out the s weakest, those of the fewest shingles
(ties by sketch).  Equal lanes have equal shingles, so this order is the same for
both sets of a pair; of their s + 1 or more equal lanes the strongest has s
weaker ones in either set and is left out by neither.  So every pair still
meets, while empty and nearly empty lanes, which unrelated sets share, do not.

Candidates are verified on the whole sets.  The result is components, so a pair
whose ends are known to be connected needs no verification.  Two rounds compare
every member of a lane's group with one member of the group (a star), which
connects most of a group of copies in as many pairs as it has members.  What
then meets in a lane from different components is compared by bit sketches
(every shingle flips one of m bits; the number of bits that differ is a lower
bound of the symmetric difference, too) inside the join, and only pairs whose
bound allows the similarity leave it.  Nothing is capped.

Equal sets are one vertex (the smallest id) from the start.

Defined results: null, empty and wordless texts have size 0 and are linked with
nothing; fewer words than ``k`` count as one shingle; rows with the same id
count as one document with several sets, linked with each other; rows with a
null id get a null component and link nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, release, small, stored, trimmed
from .components import components
from .textkernel import U, chunks, column, hashes, mix, shingles, signed, words

RATIO = 1.3
STAR_ROUNDS = 2
#: rounds by which labels spread along a star round's links
STAR_STEPS = 2
#: parts in which a class of equal sets is searched for its smallest id
CLASS_PARTS = 64
#: bits of a bit sketch for each shingle by which two sets of that size may differ, at least; and longs of the coarse one, at most
SKETCH_BITS = 8
COARSE = 16
#: lanes of a set, the first in order, by which a pair that meets in several lanes is told to leave the join once
FIRST_LANES = 16


def bands(limit=1 << 40, ratio=RATIO):
    """Ascending lower ends of the size bands."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out)


def spare(distance):
    """Lanes that a set may leave out."""
    return 1 + distance // 16


def lane_keys(shingle_set, percent, edges):
    """Keys of the lanes that a set (ascending unique hashes) sends to the join, one array over all its bands."""
    n = len(shingle_set)
    band = int(np.searchsorted(edges, n, "right")) - 1
    sums = None
    out = []
    while True:
        distance = (100 - percent) * 2 * (int(edges[band + 1]) - 1) // (100 + percent)
        if distance:  # else only equal sets are similar, which are one vertex anyhow
            if sums is None:
                sums = np.zeros(n + 1, U)
                np.bitwise_xor.accumulate(mix(shingle_set * U(0x9E3779B97F4A7C15)), out=sums[1:])
            s = spare(distance)
            lanes = distance + 1 + s
            bounds = np.arange(1, lanes, dtype=U) * U((1 << 64) // lanes)
            cut = np.concatenate([[0], np.searchsorted(shingle_set, bounds), [n]])
            sketch = sums[cut[1:]] ^ sums[cut[:-1]]
            strong = np.lexsort((sketch, np.diff(cut)))[s:]
            out.append(mix((sketch + np.arange(lanes, dtype=U) * U(0xD6E8FEB86659FD93))[strong] ^ mix(np.full(1, band + 1, U))))
        band += 1
        if int(edges[band]) * percent > 100 * n:  # the smallest partner there is too large
            break
    return np.concatenate(out) if out else np.zeros(0, U)


def _sets(batch, k):
    """(row, shingles of the row as an ascending unique array) over one Arrow batch."""
    data, at = column(batch.column("text"))
    for i, j, d, a in chunks(data, at):
        starts, ends, w = words(d, a)
        sh, o = shingles(hashes(d, starts, ends), w, k)
        for x in range(j - i):
            yield i + x, np.unique(sh[o[x] : o[x + 1]])


def _sign(k):
    def run(batches):
        for batch in batches:
            size, one, two = [], [], []
            for _, s in _sets(batch, k):
                size.append(len(s))
                one.append(int(np.bitwise_xor.reduce(s)) if len(s) else 0)
                two.append(int(mix(s ^ U(0xA0761D6478BD642F)).sum(dtype=U)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(signed(one)), pa.array(signed(two))], names=["doc_id", "size", "d1", "d2"])

    return run


def _lanes(k, percent):
    edges = bands()

    def run(batches):
        for batch in batches:
            ids, keys, owners, rows = batch.column("doc_id").to_pylist(), [], [], 0
            for row, s in _sets(batch, k):
                if len(s):
                    keys.append(lane_keys(s, percent, edges))
                    owners.append(np.full(len(keys[-1]), ids[row]))
                    rows += len(keys[-1])
                if rows > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(owners), pa.int64())], names=["lane", "v"])
                    keys, owners, rows = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(owners), pa.int64())], names=["lane", "v"])

    return run


def bit_sketch(shingle_set, percent):
    """Parities of the shingles in 2**j bits, as longs; the sketch of half as many bits is the XOR of its halves."""
    need = SKETCH_BITS * (100 - percent) * 2 * len(shingle_set) // (100 + percent)
    bits = 64
    while bits < need:
        bits *= 2
    place = (mix(shingle_set ^ U(0x589965CC75374CC3)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def coarse(sketch):
    """The sketch halved until it has at most ``COARSE`` longs."""
    while len(sketch) > COARSE:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


SETS = "v long, size long, shingles array<long>, sketch array<long>, coarse array<long>"


def _whole_sets(k, percent):
    def rows(got):
        ids, sets, sketches = zip(*got)
        longs = pa.list_(pa.int64())
        columns = [pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([signed(x) for x in sets], longs), pa.array(sketches, longs), pa.array([coarse(x) for x in sketches], longs)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SETS.split(", ")])

    def run(batches):
        for batch in batches:
            names, got, held = batch.column("doc_id").to_pylist(), [], 0
            for row, s in _sets(batch, k):
                if len(s):
                    got.append((names[row], s, bit_sketch(s, percent)))
                    held += len(s)
                if held > 500_000:
                    yield rows(got)
                    got, held = [], 0
            if got:
                yield rows(got)

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``similar``: whether any of a's sets and any of b's are similar, on whole sets."""
    one = sets.select(F.col("v").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("v").alias("b"), F.col("shingles").alias("t"))
    few = pairs.count() <= BROADCAST_ROWS  # their sets need not be shuffled to find them
    of_b = pairs.select("b").distinct()
    both = (F.broadcast(pairs) if few else pairs).join(one, "a").join(two.join(F.broadcast(of_b) if few else of_b, "b", "left_semi"), "b")
    shared = F.size(F.array_intersect("s", "t")).cast("long")
    return both.groupBy("a", "b").agg(F.max(100 * shared >= percent * (F.size("s") + F.size("t") - shared)).alias("similar"))


def allowed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose sizes and bit sketches allow their similarity."""
    own = sets.select("v", "size", "sketch")
    few = pairs.alias("p").join(own.alias("x"), F.expr("p.a = x.v")).join(own.alias("y"), F.expr("p.b = y.v"))
    return few.where(_allowed(percent, "sketch")).select("a", "b").distinct()


#: Whether sizes and bit sketches of x and y allow their similarity: symmetric difference <= (1-t)/(1+t) * (sum of sizes).
ALLOWED = """
    100 * least(x.size, y.size) >= {p} * greatest(x.size, y.size)
    AND aggregate(
            CASE WHEN size({x}) = size({y}) THEN zip_with({x}, {y}, (i, j) -> bit_count(i ^ j))
                 WHEN size({x}) > size({y}) THEN zip_with({half_x}, {y}, (i, j) -> bit_count(i ^ j))
                 ELSE zip_with({x}, {half_y}, (i, j) -> bit_count(i ^ j)) END,
            0L, (n, c) -> n + c) * (100 + {p}) <= (100 - {p}) * (x.size + y.size)"""


def _half(sketch):
    """SQL: the sketch of half as many bits."""
    half = f"cast(size({sketch}) / 2 AS int)"
    return f"zip_with(slice({sketch}, 1, {half}), slice({sketch}, {half} + 1, {half}), (i, j) -> i ^ j)"


def _allowed(percent, sketch):
    x, y = f"x.{sketch}", f"y.{sketch}"
    return ALLOWED.format(p=percent, x=x, y=y, half_x=_half(x), half_y=_half(y))


def copies_of(known: DataFrame) -> DataFrame:
    """(a, b): links from each document of ``known`` (doc_id, size, d1, d2) to one of a smaller id with an equal set, if there is one.

    Of a class of equal sets each of ``CLASS_PARTS`` parts finds its smallest id, and these find the class's, so that no
    class meets in one task.
    """
    same = ["size", "d1", "d2"]
    of_part = Window.partitionBy(*same, F.pmod(F.xxhash64("doc_id"), F.lit(CLASS_PARTS)))
    parts = known.select("doc_id", *same, F.min("doc_id").over(of_part).alias("first"))
    inner = parts.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    firsts = parts.where("doc_id = first").select("doc_id", *same).distinct()  # at most CLASS_PARTS of a class
    firsts = firsts.select(F.col("doc_id").alias("a"), F.min("doc_id").over(Window.partitionBy(*same)).alias("b")).where("a <> b")
    return inner.unionByName(firsts).distinct()


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text): all pairs of similarity >= percent linked."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed_docs = stored(docs.mapInArrow(trimmed(_sign(k)), "doc_id long, size long, d1 long, d2 long"), "signatures")
    known = signed_docs.where("doc_id IS NOT NULL AND size > 0")
    member = stored(copies_of(known), "copies")
    several = known.groupBy("doc_id").count().where("count > 1").select("doc_id")  # ids with more than one set send all
    copies = stored(member.select(F.col("a").alias("doc_id")).distinct().join(several, "doc_id", "left_anti"), "copies")

    # the sketches: of one document for each class of equal sets
    single = docs.where("doc_id IS NOT NULL").join(small(copies), "doc_id", "left_anti")
    lanes = single.mapInArrow(trimmed(_lanes(k, percent)), "lane long, v long")
    met = lanes.groupBy("lane").count().where("count > 1").select("lane")
    shared = stored(lanes.join(met, "lane"), "lanes")
    meeting = stored(shared.select("v").distinct(), "meeting")
    release(docs.sparkSession)
    links, labels = _similar(docs, shared, meeting, k, percent) if meeting.head(1) else (None, None)
    links = member if links is None else member.unionByName(links)

    out = signed_docs.select("doc_id", F.col("size").alias("n_shingles"))
    if not links.head(1):
        return out.withColumn("component_id", F.col("doc_id"))
    final = components(links, start=labels)
    release(docs.sparkSession)
    return out.join(final, out.doc_id == final.v, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _similar(docs, shared, meeting, k, percent):
    """Links (a, b) that connect, of the vertices ``meeting`` in the lanes ``shared``, all that are connected by similar pairs, and labels by some of them."""
    wanted = meeting.withColumnRenamed("v", "doc_id")
    sets = stored(docs.join(small(wanted), "doc_id", "left_semi").mapInArrow(trimmed(_whole_sets(k, percent)), SETS), "sets")
    labels = meeting.withColumn("component", F.col("v"))
    tried, links = [], []
    for turn in range(STAR_ROUNDS + 1):
        groups = shared.join(labels, "v")  # lanes whose members are not all connected yet
        mixed = groups.groupBy("lane").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(F.xxhash64("v", F.lit(turn)), "v", "component")).alias("c")).where("low <> high")
        groups = stored(groups.join(mixed, "lane").select("lane", "v", "component", F.col("c.v").alias("centre"), F.col("c.component").alias("central")), "groups")
        if turn < STAR_ROUNDS:  # every member with the one that comes first in this turn's order
            pairs = groups.where("component <> central").select(F.least("v", "centre").alias("a"), F.greatest("v", "centre").alias("b"))
        else:
            first = groups.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("lane")), 1, FIRST_LANES).alias("lanes"))  # of one document
            own = groups.select("lane", "v", "component").join(sets.select("v", "size", "coarse").join(first, "v"), "v")
            once = " AND coalesce(array_min(array_intersect(x.lanes, y.lanes)), x.lane) = x.lane"  # if they meet in one of these, there only
            pairs = own.alias("x").join(own.alias("y"), F.expr("x.lane = y.lane AND x.component < y.component AND" + _allowed(percent, "coarse") + once))
            pairs = pairs.select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b"))
        pairs = pairs.distinct()
        for known in tried:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = stored(allowed(pairs, sets, percent), "pairs")
        result = stored(verified(pairs, sets, percent), "verified")
        tried.append(result.select("a", "b"))
        links.append(result.where("similar").select("a", "b"))
        if turn < STAR_ROUNDS:  # those that are connected by now need not all have one label
            labels = components(links[-1], STAR_STEPS, labels)
        release(docs.sparkSession)
    return reduce(DataFrame.unionByName, links), labels
