"""WARC archives compressed with Zstandard (.warc.zst), written and read.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself Zstandard-compressed or not, and then one frame per record;
an archive without a dictionary starts with its first record.  The reader loads
the dictionary, decodes frame by frame, and checks of every record: that the
frame holds exactly one, the version line, that headers are well-formed and the
required ones present once, that Content-Length is the length of the block, that
the two line ends follow, and that block and payload digests agree.

Records of equal payloads of at least ``MIN_REVISIT`` bytes are one response,
that of the largest id, and revisits that refer to it and have no payload.

Archives are files of about ``ARCHIVE_BYTES`` of records in the shared folder,
written by the tasks that hold the rows, under names that no second attempt of
a task shares.

Defined results: a null html is an empty payload; pages with the same id are
records of the same name, and equal payloads of an id's rows are responses of
their own; a null id is named "null"; no pages give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored, trimmed
from .fileblocks import write

MIN_REVISIT = 1000
ARCHIVE_BYTES = 8_000_000
#: a payload of more records than this is hot; the most frequent ones, so many, need no shuffle
HOT, HOT_PAYLOADS = 1000, 500
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: the first records of an archive, up to these numbers, train its dictionary
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 300, 1_000_000, 32_768
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    """An archive or record that is not valid."""


# ---------------------------------------------------------------- records


def sha1_label(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers, block):
    """Bytes of one record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(value):
    """A header value on one line."""
    return " ".join(str(value or "").split())


def name_of(page_id):
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_record(page_id, url, payload, refers_to=None, revisit=False):
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name_of(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", sha1_label(payload)),
        ("X-Payload-Length", str(len(payload))),
    ]
    block = HTTP if revisit else HTTP + payload
    if revisit:
        headers += [("WARC-Refers-To", name_of(refers_to)), ("WARC-Profile", PROFILE)]
    return record([*headers, ("WARC-Block-Digest", sha1_label(block))], block)


def parse(data):
    """(headers with lower-case names, block) of one record's bytes, validated."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark:
        raise WarcError("no end of headers")
    try:
        first, *lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError("headers are not UTF-8") from e
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"not a WARC version: {first[:40]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or any(c in name for c in "()<>@,;\\\"/[]?={} \t"):
            raise WarcError(f"not a header: {line[:80]!r}")
        if name.lower() in headers and name.lower() != "warc-concurrent-to":
            raise WarcError(f"{name} occurs twice")
        headers[name.lower()] = value.strip()
    for name in REQUIRED:
        if not headers.get(name):
            raise WarcError(f"{name} is missing")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is not a number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length} does not agree with the record")
    block = rest[:length]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != sha1_label(block):
        raise WarcError("block digest does not agree")
    return headers, block


def payload_of(headers, block):
    """Payload of a response, validated against its digest; None for a revisit."""
    if headers["warc-type"] == "revisit":
        if not headers.get("warc-refers-to") or not headers.get("warc-profile"):
            raise WarcError("a revisit without profile or what it refers to")
        return None
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    if "warc-payload-digest" in headers and headers["warc-payload-digest"] != sha1_label(payload):
        raise WarcError("payload digest does not agree")
    return payload


# ---------------------------------------------------------------- archives


def train(records):
    """A dictionary for the records, or None if they are too few or too alike to train one."""
    import zstandard

    sample, size = [], 0
    for r in records[:SAMPLE_RECORDS]:
        sample.append(r[:20_000])
        size += len(sample[-1])
        if size > SAMPLE_BYTES:
            break
    if len(sample) < 20:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 10 + 256), sample).as_bytes()
    except zstandard.ZstdError:
        return None


def archive(records, dictionary=None, level=3):
    """Byte strings of an archive."""
    import zstandard

    plain = zstandard.ZstdCompressor(level=level)
    if dictionary:
        frame = plain.compress(dictionary)
        yield struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame
        plain = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    for r in records:
        yield plain.compress(r)


def frames(data):
    """Every record's bytes, one frame each, of an archive."""
    import zstandard

    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data, 0)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise WarcError("the dictionary frame is cut off")
        dictionary, at = bytes(data[8 : 8 + size]), 8 + size
        if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    view = memoryview(data)
    decoder = zstandard.ZstdDecompressor(**options)
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:  # other skippable frames hold no records
            at += 8 + size
            continue
        one = decoder.decompressobj()
        parts, step = [], at
        try:
            while not one.eof:
                if step >= len(data):
                    raise WarcError("a frame is cut off")
                parts.append(one.decompress(view[step : step + 65_536]))
                step = min(len(data), step + 65_536)
        except zstandard.ZstdError as e:
            raise WarcError(f"not a frame at byte {at}: {e}") from e
        at = step - len(one.unused_data)
        yield b"".join(parts)


def read(data):
    """(headers, payload or None) of every record of an archive."""
    for raw in frames(data):
        headers, block = parse(raw)
        yield headers, payload_of(headers, block)


# ---------------------------------------------------------------- Spark

WRITTEN = "uri string, records long, bytes long"
READ = "uri string, place long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def planned(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: the id of the response of which the row is a revisit, else null."""
    payload = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", "url", "html").withColumn("digest", F.when(F.octet_length(payload) >= MIN_REVISIT, F.sha1(F.encode(payload, "UTF-8"))))
    groups = sized.where("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeats = groups.where("first <> last")  # of null ids all are responses
    # payloads of very many records are told to all tasks; the others' records meet by digest, those without one need not
    most = repeats.where(F.col("n") > HOT).orderBy(F.desc("n"), "digest").limit(HOT_PAYLOADS).select("digest", "last").collect()
    hot = pages.sparkSession.createDataFrame([(r["digest"], r["last"]) for r in most], f"digest string, hot {pages.schema['page_id'].dataType.simpleString()}")
    told = sized.join(F.broadcast(hot), "digest", "left")  # at most HOT_PAYLOADS rows
    rest = told.where("digest IS NOT NULL AND hot IS NULL").join(repeats.select("digest", "last"), "digest", "left")
    rows = rest.unionByName(told.where("digest IS NULL OR hot IS NOT NULL").withColumn("last", F.col("hot")))
    return rows.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of ``rows`` (page_id, url, html, refers_to) into ``folder``; a row for each archive."""

    def run(batches):
        held, size = [], 0

        def flush():
            uri, n = write(folder, "pages.warc.zst", archive(held, train(held)))
            return pa.RecordBatch.from_pydict({"uri": [uri], "records": [len(held)], "bytes": [n]})

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                page_id, url, html, refers_to = (x.as_py() for x in row)
                held.append(page_record(page_id, url, (html or "").encode(), refers_to, refers_to is not None))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(trimmed(run), WRITTEN)


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives that ``archives`` (uri) names."""

    def number(name):
        text = name.removeprefix("<urn:x-page:").removesuffix(">")
        return None if text == "null" else int(text)

    def run(batches):
        from .fileblocks import opened

        names = [c.split()[0] for c in READ.split(", ")]
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                store, path = opened(uri)
                with store.open_input_file(path) as f:
                    data = f.read()
                rows = []
                for k, (headers, payload) in enumerate(read(data)):
                    revisit = payload is None
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    digest = base64.b32decode(digest).hex() if revisit else hashlib.sha1(payload).hexdigest()
                    length = int(headers["x-payload-length"]) if revisit else len(payload)
                    rows.append((uri, k, number(headers["warc-record-id"]), headers.get("warc-target-uri"), length, digest, headers["warc-type"], number(headers["warc-refers-to"]) if revisit else None))
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return archives.repartition(max(1, archives.count()), "uri").mapInArrow(trimmed(run), READ)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The contract's digest columns, from archives written and read back."""
    folder = folder or scratch(pages.sparkSession, "warc")
    archives = stored(write_archives(planned(pages), folder), "archives")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
