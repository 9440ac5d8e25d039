"""Token-id files in patched frame-of-reference blocks.

File format (all integers little-endian; a file holds the documents of one id range, in order)::

    header   8s magic "PFORTOK1", u32 block length, u32 documents, u64 ids
    blocks   one after the other; block b holds ids [b*L, (b+1)*L) of the file's id stream, across documents:
             u32 minimum, u8 width, u8 unused, u16 exceptions,
             packed: count * width bits, least significant first, padded to whole bytes (id - minimum, low bits),
             exceptions: u16 place, then u32 (id - minimum), for values that need more bits than width
    index    u64 start of every block, and of the end of the last
    docs     i64 doc id, u8 null flag, u64 first id, u64 ids, for every document
    trailer  u64 start of index, u64 start of docs, 8s magic

The width of a block is that of its ``PERCENTILE`` largest value, so a few large
ids become exceptions instead of widening all.  The index lets a reader decode
any block, and so any document, on its own.

Defined results: null and empty texts have the end id only; documents with equal
ids are written in the order of their texts; no rows give no files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored, trimmed
from .fileblocks import write
from .textkernel import U, chunks, column, mix, powers

BLOCK = 4096
PERCENTILE = 90
END = 0
MAGIC = b"PFORTOK1"
#: bytes of text for each file; files are what is written, read and, if an executor is lost, redone
FILE_BYTES = 16_000_000
#: pieces that a worker remembers with their ids, before it forgets all
MEMO = 2_000_000


# ---------------------------------------------------------------- format


def _bits(value):
    return int(value).bit_length()


def pack_block(ids):
    """One block's bytes."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    width = _bits(np.partition(rest, k := (len(rest) - 1) * PERCENTILE // 100)[k])
    place = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    kept = rest & np.uint32((1 << width) - 1)
    kept[place] = 0
    if width:
        bits = np.unpackbits(kept.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        packed = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    else:
        packed = b""
    return b"".join((struct.pack("<IBBH", low, width, 0, len(place)), packed, place.astype("<u2").tobytes(), rest[place].astype("<u4").tobytes()))


def unpack_block(data, at, count):
    """Ids of the block that starts at byte ``at``."""
    low, width, _, n = struct.unpack_from("<IBBH", data, at)
    at += 8
    size = (count * width + 7) // 8
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: count * width].reshape(count, width)
        full = np.zeros((count, 32), np.uint8)
        full[:, :width] = bits
        out = np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)
    else:
        out = np.zeros(count, np.uint32)
    at += size
    place = np.frombuffer(data, "<u2", n, at)
    out[place] = np.frombuffer(data, "<u4", n, at + 2 * n)
    return out + np.uint32(low)


class Writer:
    """Byte strings of one file, from documents given in order."""

    def __init__(self, block=BLOCK):
        self.block, self.docs, self.total = block, [], 0
        self.parts, self.size, self.starts, self.rest = [], 24, [], np.zeros(0, np.uint32)

    def add(self, doc_id, ids):
        self.add_many([doc_id], np.asarray(ids, np.uint32), [len(ids)])

    def add_many(self, doc_ids, ids, counts):
        for d, n in zip(doc_ids, counts):
            self.docs.append((d, self.total, int(n)))
            self.total += int(n)
        ids = np.concatenate([self.rest, ids]) if len(self.rest) else ids
        whole = len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            self._put(ids[i : i + self.block])
        self.rest = ids[whole:].copy()

    def _put(self, ids):
        self.starts.append(self.size)
        self.parts.append(pack_block(ids))
        self.size += len(self.parts[-1])

    def finish(self):
        if len(self.rest):
            self._put(self.rest)
        index = np.array([*self.starts, self.size], "<u8").tobytes()
        docs = b"".join(struct.pack("<qBQQ", d if d is not None else 0, d is None, s, n) for d, s, n in self.docs)
        tail = struct.pack("<QQ8s", self.size, self.size + len(index), MAGIC)
        return [struct.pack("<8sIIQ", MAGIC, self.block, len(self.docs), self.total), *self.parts, index, docs, tail]


class Reader:
    """Random access to one file's documents."""

    def __init__(self, data):
        magic, self.block, n, self.total = struct.unpack_from("<8sIIQ", data, 0)
        index_at, docs_at, tail = struct.unpack_from("<QQ8s", data, len(data) - 24)
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a token-id file")
        self.data = data
        self.starts = np.frombuffer(data, "<u8", -(-self.total // self.block) + 1, index_at)
        self.docs = [(None if null else d, s, c) for d, null, s, c in struct.iter_unpack("<qBQQ", data[docs_at : docs_at + 25 * n])]

    def ids(self, start, count):
        """Ids [start, start + count) of the file's stream."""
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block
        got = [unpack_block(self.data, int(self.starts[b]), min(self.block, self.total - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(got)[start - first * self.block : start - first * self.block + count]

    def documents(self):
        """(doc id, start in the file, ids) of every document; decodes about a million ids at a time."""
        i = 0
        while i < len(self.docs):
            j, start = i, self.docs[i][1]
            while j < len(self.docs) and (j == i or self.docs[j][1] + self.docs[j][2] - start <= 1_000_000):
                j += 1
            end = self.docs[j - 1][1] + self.docs[j - 1][2]
            ids = self.ids(start, end - start)
            for d, s, n in self.docs[i:j]:
                yield d, s, ids[s - start : s - start + n]
            i = j


# ---------------------------------------------------------------- encoding

# Classes of the byte-level pattern (fixed values), for characters up to U+024F; texts with others go to the library whole.
WHITE, LETTER, NUMBER, OTHER, ODD = range(5)
ASCII = np.full(128, OTHER, np.uint8)
ASCII[[9, 10, 13, 32]] = WHITE
ASCII[48:58] = NUMBER
ASCII[65:91] = ASCII[97:123] = LETTER
ASCII[:9] = ASCII[[11, 12, 127]] = ASCII[14:32] = ODD
#: U+0080 to U+00FF
LATIN = np.full(128, LETTER, np.uint8)
LATIN[: 0x41 - 0x20] = ODD
LATIN[0x21:0x40] = OTHER
LATIN[[0x2A, 0x35, 0x3A]] = LETTER
LATIN[[0x32, 0x33, 0x39, 0x3C, 0x3D, 0x3E]] = NUMBER
LATIN[[0x57, 0x77]] = OTHER


def pieces(data, at):
    """(piece starts, piece offsets of the docs, flags of the docs for which the cut is not certain) of a chunk of whole docs.

    The pattern cuts between letters, numbers, other characters and white space; a blank goes with what follows it;
    of a run of other white space the last one stands alone unless the text ends; an apostrophe that begins a piece
    takes one of the endings s, t, m, d, re, ve, ll with it.
    """
    n = len(data)
    wide = np.concatenate([data, np.zeros(3, np.uint8)])
    kind = np.where(data < 128, ASCII[data & 127], np.uint8(ODD))
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    if len(lead):
        code = ((data[lead].astype(np.int32) & 31) << 6) | (wide[lead + 1] & 63)
        of = np.where(code < 256, LATIN[code & 127], np.where(code < 0x250, np.uint8(LETTER), np.uint8(ODD)))
        kind[lead] = of
        kind[lead + 1] = of
    first = np.zeros(n + 4, bool)
    first[at] = True  # a doc's first byte, and the end
    white, blank = kind == WHITE, data == 32
    before = np.concatenate([[False], white[:-1]])
    start = np.concatenate([[True], (kind[1:] != kind[:-1]) & ~blank[:-1]])
    start |= blank | first[:n]
    follows = np.concatenate([white[1:], [True]]) | first[1 : n + 1]  # white space or the end
    start |= white & ~follows & before & ~first[:n]
    touching = blank & (follows | before | first[:n])
    odd = (kind == ODD) | touching | ((data == 60) & (wide[1 : n + 1] == 124))
    flagged = np.zeros(len(at) - 1, bool)
    flagged[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = True
    mark = np.flatnonzero((data == 39) & start)
    if len(mark):
        one, two = wide[mark + 1], wide[mark + 2]
        inside = ~first[mark + 1]
        short = inside & np.isin(one, [115, 116, 109, 100])
        long = inside & ~first[mark + 2] & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        start[mark[short | long] + 1] = False
        ends = np.concatenate([mark[short] + 2, mark[long] + 3])
        start[ends[ends < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, at), flagged


def byte_letters():
    """The character by which the byte-level vocabulary writes each byte: printable ones as they are, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) if b in shown else chr(256 + sum(x not in shown for x in range(b))) for b in range(256)}


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Byte-level BPE never merges across the pieces that its pattern cuts, so a text's ids are those of its pieces, one
    after the other.  Pieces are found and hashed (64 bits) for a whole chunk of texts at once; the library encodes
    those that the worker has not met before.  Texts for which the cut is not certain go to the library whole.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.model._resize_cache(0)
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self._forget()

    def _forget(self):
        # of the pieces met: ascending hashes, and with them the place and number of their ids in ``flat``
        self.known, self.first = np.zeros(0, U), np.zeros(0, np.int64)
        self.count, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _learn(self, hashes_, raw):
        ids, count, tokenize, letters = [], [], self.model.tokenize, self.letters
        for piece in raw:
            got = tokenize(piece.decode("latin-1").translate(letters))
            count.append(len(got))
            ids += [t.id for t in got]
        count = np.array(count, np.int32)
        first = len(self.flat) + np.cumsum(count, dtype=np.int64) - count
        place = np.searchsorted(self.known, hashes_)
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
        self.known, self.first, self.count = np.insert(self.known, place, hashes_), np.insert(self.first, place, first), np.insert(self.count, place, count)

    def _plain(self, data, at, starts, cut):
        ends = np.append(starts[1:], len(data))
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
        h, where, back = np.unique(mix((total[ends] - total[starts]) * down[starts]), return_index=True, return_inverse=True)

        def unknown():
            place = np.searchsorted(self.known, h)
            place[place == len(self.known)] = 0
            return np.flatnonzero(self.known[place] != h) if len(self.known) else np.arange(len(h))

        new = unknown()
        if len(new):
            if len(self.known) + len(new) > MEMO:
                self._forget()
                new = unknown()
            raw = data.tobytes()
            self._learn(h[new], [raw[i:j] for i, j in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
        number = np.searchsorted(self.known, h)[back]
        size = self.count[number]
        sums = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ids = self.flat[np.repeat(self.first[number] - sums[:-1], size) + np.arange(sums[-1])]
        return ids, np.diff(sums[cut])

    def __call__(self, texts):
        """(ids of all texts one after the other, ids in each text) for an Arrow string array."""
        data, at = column(texts)
        ids, counts = [], []
        for i, j, d, a in chunks(data, at, 4_000_000):
            if not len(d):
                counts.append(np.zeros(j - i, np.int64))
                continue
            starts, cut, flagged = pieces(d, a)
            own, n = self._plain(d, a, starts, cut)
            if flagged.any():  # in their place, what the library makes of them
                which = np.flatnonzero(flagged)
                whole = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([d[a[k] : a[k + 1]].tobytes().decode() for k in which], add_special_tokens=False)]
                parts = np.split(own, np.cumsum(n)[:-1])
                for k, x in zip(which, whole):
                    parts[k] = x
                own, n = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
            ids.append(own)
            counts.append(n)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(counts) if counts else np.zeros(0, np.int64)


def default_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path):
    """One encoder for each worker process."""
    import os
    import sys

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.__dict__.setdefault("_inkspark_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


FILES = "part long, uri string, docs long, ids long"
DECODED = "part long, place long, doc_id long, first long, n_tokens long, ids_crc32 long"


def write_files(docs: DataFrame, folder: str, path: str | None = None, order: str = "doc_id", files: int | None = None, block: int = BLOCK) -> DataFrame:
    """Encodes ``docs`` (columns doc_id, text and ``order``) and writes token-id files into ``folder``; a row for each file.

    Files cover disjoint ascending ranges of ``order``: one range partition, sorted, is one file.  A worker holds one
    file's packed blocks and a few megabytes of texts at a time.
    """
    path = path or default_path()
    if files is None:
        total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-total // FILE_BYTES))

    def run(batches):
        from pyspark import TaskContext

        encode, writer, part = _encoder(path), Writer(block), TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                some = batch.slice(i, 2000)
                ids, counts = encode(some.column("text"))
                closed = np.insert(ids, np.cumsum(counts), END)
                writer.add_many(some.column("doc_id").to_pylist(), closed, (counts + 1).tolist())
        if writer.docs:
            uri, _ = write(folder, f"ids-{part:06d}", writer.finish())
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "docs": [len(writer.docs)], "ids": [writer.total]})

    keys = [order, F.xxhash64("text")] if order != "text" else [order]
    dealt = docs.select("doc_id", "text", *([order] if order != "doc_id" else [])).repartitionByRange(files, *keys).sortWithinPartitions(*keys, "text")
    return dealt.select("doc_id", "text").mapInArrow(trimmed(run), FILES)


def read_files(files: DataFrame) -> DataFrame:
    """Every document of the files that ``files`` names, decoded, with its place in its file and the crc32 of its ids."""

    def run(batches):
        from .fileblocks import opened

        for batch in batches:
            for part, uri in zip(batch.column("part").to_pylist(), batch.column("uri").to_pylist()):
                store, path = opened(uri)
                with store.open_input_file(path) as f:
                    reader = Reader(f.read())
                rows = [(part, k, d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for k, (d, s, x) in enumerate(reader.documents())]
                names = [c.split()[0] for c in DECODED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return files.repartition(max(1, files.count()), "part").mapInArrow(trimmed(run), DECODED)


def token_files(docs: DataFrame, path: str | None = None, order: str = "doc_id", folder: str | None = None) -> DataFrame:
    """The contract's digest columns, from files written in ascending ``order`` and read back: doc_id, start, n_tokens, ids_crc32."""
    from pyspark.sql import Window

    folder = folder or scratch(docs.sparkSession, "tokenids")
    files = stored(write_files(docs, folder, path, order), "tokenfiles")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = files.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    rows = read_files(files).join(F.broadcast(starts), "part")
    return rows.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
