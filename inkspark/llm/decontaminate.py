"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document, as search engines do: a shard covers some megabytes of text and holds, for each of
its terms, the ascending positions of its words, next to the words of each document and the columns that are kept.  Tasks
write shards one behind the other into files in the shared folder; the table of the index names file and place of each.  A
query (a window of consecutive item words) starts from the list of its rarest term in the shard, moved back by the term's
offset, and is intersected with the offset-adjusted lists of its other terms in order of rarity until it is empty or all
terms have matched.  So texts are read once however many queries there are, nothing but result rows leaves a task, no
shuffle is needed, and a hot document, source or passage cannot pile up in one place.  The index is deleted when the
results are stored.

The benchmark goes to the tasks in blocks of at most ``max_block`` windows, cut inside of items, too; one block is the
usual case, and more blocks are more passes over the index, never a larger broadcast.

Defined results: a null or wordless document has no words and no hits; a null or
wordless item has no windows; equal items both count; an empty benchmark leaves
all documents clean; an empty corpus gives no rows.  Rows are independent, so
repeated rows and null ids pass through as they are; a very long text is a shard of its own; clashing column names are
kept, as the operator's own begin with two underscores.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, scratch, stored, trimmed
from .fileblocks import opened, write
from .textkernel import ALNUM, U, chunks, column, hashes, words

WINDOW = 10
MAX_BLOCK = 200_000
#: bytes of text that one shard of the index covers; its arrays take some 40 bytes for each
SHARD = 2_000_000
#: bytes of a file of shards, and of shards that one task queries, about
FILE_BYTES = 16_000_000
TASK_BYTES = 64_000_000


def item_windows(text, width):
    """Windows of an item as rows of word hashes, and their length; an item of fewer words than ``width`` is one window."""
    data, at = column(pa.array([text], pa.string()))
    starts, ends, _ = words(data, at, ALNUM)
    h = hashes(data, starts, ends)
    length = min(width, len(h))
    return (np.lib.stride_tricks.sliding_window_view(h, length) if length else np.zeros((0, 1), U)), length


class Block:
    """Windows as rows of term numbers, -1 behind a short one's last; the terms' hashes, ascending; the item of each window."""

    def __init__(self, parts, width):
        self.owner = np.concatenate([np.full(len(rows), k, np.int64) for k, (_, rows, _) in enumerate(parts)] or [np.zeros(0, np.int64)])
        self.items = [item for item, _, _ in parts]
        self.vocabulary = np.unique(np.concatenate([rows.reshape(-1) for _, rows, _ in parts] or [np.zeros(0, U)]))
        self.windows = np.full((len(self.owner), width), -1, np.int64)
        at = 0
        for _, rows, length in parts:
            self.windows[at : at + len(rows), :length] = np.searchsorted(self.vocabulary, rows)
            at += len(rows)


def blocks_of(items, width, most):
    """Blocks of at most ``most`` windows of (item, text) pairs."""
    parts, held = [], 0
    for item, text in items:
        rows, length = item_windows(text or "", width)
        while len(rows):
            part, rows = rows[: most - held], rows[most - held :]
            parts.append((item if item is not None else "", part, length))
            held += len(part)
            if held == most:
                yield Block(parts, width)
                parts, held = [], 0
    if parts:
        yield Block(parts, width)


class Index:
    """Posting lists of a shard for the terms of a vocabulary."""

    def __init__(self, terms, bounds, positions, vocabulary):
        at = np.minimum(np.searchsorted(terms, vocabulary), max(0, len(terms) - 1))
        known = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
        self.first = np.where(known, bounds[at], 0)
        self.last = np.where(known, bounds[np.minimum(at + 1, len(bounds) - 1)], 0)
        self.positions = positions

    def list(self, term):
        return self.positions[self.first[term] : self.last[term]].astype(np.int64)

    def frequency(self, terms):
        return self.last[terms] - self.first[terms]

    def phrase(self, window):
        """Start positions at which the whole window occurs."""
        length = int((window >= 0).sum())
        terms = window[:length]
        order = np.argsort(self.frequency(terms), kind="stable")
        first = order[0]
        found = self.list(terms[first]) - first
        for k in order[1:]:
            if not len(found):
                return found
            other = self.list(terms[k])
            if not len(other):
                return other
            i = np.searchsorted(other, found + k)
            i[i == len(other)] = 0
            found = found[other[i] == found + k]
        return found

    def near(self, window, slop):
        """Start positions at which every term occurs within ``slop`` words of its place."""
        length = int((window >= 0).sum())
        terms = window[:length]
        order = np.argsort(self.frequency(terms), kind="stable")
        found = self.list(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                return found
            other = self.list(terms[k])
            found = found[np.searchsorted(other, found + k + slop, "right") > np.searchsorted(other, found + k - slop, "left")]
        return found


def posted(word_hashes):
    """(terms, bounds, positions): the ascending hashes, and the positions of each between its bounds, ascending."""
    order = np.argsort(word_hashes, kind="stable")
    ordered = word_hashes[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    return ordered[head], np.append(np.flatnonzero(head), len(ordered)), order.astype(np.uint32)


def matches(counts, terms, bounds, positions, block, slop=0):
    """(document, start, length, item) of all matches in a shard of documents of ``counts`` words."""
    nothing = np.zeros((0, 4), np.int64)
    if not len(block.windows) or not len(positions):
        return nothing
    index = Index(terms, bounds, positions, block.vocabulary)
    w = np.concatenate([[0], np.cumsum(counts)])
    lengths = (block.windows >= 0).sum(1)
    present = index.frequency(np.arange(len(block.vocabulary))) > 0
    out = []
    for i in np.flatnonzero((present[block.windows] | (block.windows < 0)).all(1)):
        found = index.near(block.windows[i], slop) if slop else index.phrase(block.windows[i])
        if len(found):
            length = int(lengths[i])
            found = found[(found >= 0) & (found + length <= len(positions))]
            doc = np.searchsorted(w, found, "right") - 1
            inside = found + length <= w[doc + 1]  # an occurrence never runs over a document's end
            found, doc = found[inside], doc[inside]
            out.append(np.stack([doc, found - w[doc], np.full(len(found), length), np.full(len(found), block.owner[i])], 1))
    return np.concatenate(out) if out else nothing


def _merged(ranges, flags_len):
    """Covered words of one doc as ascending disjoint [start, end, start, end, ...]."""
    hit = np.zeros(flags_len + 1, np.int64)
    np.add.at(hit, ranges[:, 0], 1)
    np.add.at(hit, ranges[:, 1], -1)
    inside = np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])
    return np.flatnonzero(inside[1:] != inside[:-1])


INDEX = "uri string, place long, bytes long"
FOUND = ", ranges array<array<long>>, items array<array<string>>"
PARTS = {"counts": np.int64, "terms": U, "bounds": np.int64, "positions": np.uint32}


def packed(kept, counts, terms, bounds, positions):
    """A shard as bytes: the kept columns of its documents, their words, terms, bounds and positions."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept.schema) as out:
        out.write_batch(kept)
    arrays = dict(zip(PARTS, (counts, terms, bounds, positions)))
    blobs = [sink.getvalue().to_pybytes(), *(arrays[c].astype(kind).tobytes() for c, kind in PARTS.items())]
    return zstandard.compress(b"".join(struct.pack("<q", len(b)) + b for b in blobs), 1)


def unpacked(data):
    """(reader of the kept columns, counts, terms, bounds, positions) of a shard's bytes."""
    data, blobs, at = memoryview(zstandard.decompress(data)), [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<q", data, at)
        blobs.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return pa.ipc.open_stream(pa.py_buffer(blobs[0])), *(np.frombuffer(b, kind) for b, kind in zip(blobs[1:], PARTS.values()))


def _indexer(keep, folder):
    def run(batches):
        held, size = [], 0

        def flush():
            uri, _ = write(folder, "shards.zst", held)
            lengths = [len(x) for x in held]
            return pa.RecordBatch.from_pydict({"uri": [uri] * len(held), "place": [sum(lengths[:i]) for i in range(len(held))], "bytes": lengths})

        for batch in batches:
            data, at = column(batch.column("__text"))
            kept = batch.select(keep)
            for i, j, d, a in chunks(data, at, SHARD):
                starts, ends, w = words(d, a, ALNUM)
                held.append(packed(kept.slice(i, j - i), np.diff(w), *posted(hashes(d, starts, ends))))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _matcher(block, slop, more, last, keep):
    """Queries of one block over the shards; ``more``: with what earlier blocks have found; ``last``: rows of documents come out."""

    def run(batches):
        for batch in batches:
            for k, (uri, place, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("uri", "place", "bytes")))):
                store, path = opened(uri)
                with store.open_input_file(path) as f:
                    kept, counts, terms, bounds, positions = unpacked(f.read_at(length, place))
                found = matches(counts, terms, bounds, positions, block, slop)
                found = found[np.argsort(found[:, 0], kind="stable")]
                cut = np.searchsorted(found[:, 0], np.arange(len(counts) + 1))
                ranges, items = [], []
                for x in range(len(counts)):
                    f = found[cut[x] : cut[x + 1]]
                    own = np.stack([f[:, 1], f[:, 1] + f[:, 2]], 1)
                    names = {block.items[i] for i in np.unique(f[:, 3])}
                    if more:
                        own = np.concatenate([own, np.array(batch.column("ranges")[k][x].as_py(), np.int64).reshape(-1, 2)])
                        names |= set(batch.column("items")[k][x].as_py())
                    ranges.append(_merged(own, int(counts[x])).tolist() if len(own) else [])
                    items.append(sorted(names))
                if not last:
                    nested = [pa.array([x], pa.list_(pa.list_(kind))) for x, kind in ((ranges, pa.int64()), (items, pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("uri", "place", "bytes")), *nested], names=["uri", "place", "bytes", "ranges", "items"])
                    continue
                columns = kept.read_next_batch().columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(ranges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=[*keep, "__n_words", "__ranges", "__items"])

    return run


def build_index(docs: DataFrame, folder: str, keep: list[str], text: str = "text") -> DataFrame:
    """A row for each shard of ``docs``: its file below ``folder``, its place there, and its bytes."""
    return stored(docs.select(*keep, F.col(text).alias("__text")).mapInArrow(trimmed(_indexer(keep, folder)), INDEX), "index")


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = 0, max_block: int = MAX_BLOCK, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs``, with ``__n_words``, ``__ranges`` and ``__items``.

    ``__ranges`` holds the words inside any match as ascending disjoint [start, end, start, end, ...], ``__items`` the
    ids of the matching items as sorted strings.  slop 0 matches exact phrases; with slop s every term of a window may
    be up to s words off its place.
    """
    spark, keep = docs.sparkSession, list(docs.columns) if keep is None else keep
    folder = scratch(spark, "shards")
    index = build_index(docs, folder, keep, text)
    n, size = index.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    found = index.repartition(max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, size // TASK_BYTES))))
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).toLocalIterator()
    fields = [T.StructField("__n_words", T.LongType()), T.StructField("__ranges", T.ArrayType(T.LongType())), T.StructField("__items", T.ArrayType(T.StringType()))]
    blocks = list(blocks_of(((r["i"], r["t"]) for r in items), width, max_block)) or [Block([], width)]
    for b, block in enumerate(blocks):
        last = b + 1 == len(blocks)
        schema = T.StructType([*(docs.schema[c] for c in keep), *fields]) if last else INDEX + FOUND
        found = found.mapInArrow(trimmed(_matcher(block, slop, b > 0, last, keep)), schema)
    out = stored(found, "found")
    discard(spark, folder)
    return out


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = 2, **options) -> DataFrame:
    """(doc_id, n_near, items): words of each document inside windows whose terms stand up to ``slop`` words off their places."""
    found = search(docs, benchmark, slop=slop, keep=["doc_id"], **options).where("size(__items) > 0")
    return found.select("doc_id", covered("__ranges").alias("n_near"), F.col("__items").alias("items"))


def covered(ranges: str):
    """Words inside [start, end, start, end, ...]."""
    return F.aggregate(ranges, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda x, e: F.when(x.s < 0, F.struct(x.n.alias("n"), e.alias("s"))).otherwise(F.struct((x.n + e - x.s).alias("n"), F.lit(-1).cast("long").alias("s"))), lambda x: x.n)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = search(docs, benchmark, keep=["doc_id"])
    found = found.withColumn("__n_hit", covered("__ranges"))
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
    )


def digest(items) -> str:
    """items_sha256 of a collection of ids."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
