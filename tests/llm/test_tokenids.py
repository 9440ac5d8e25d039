import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspark.llm import tokenids as t


def brute(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(t.default_path())
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["corpus", "documents"])
def test_files_hold_what_the_library_gives(request, table):
    docs = request.getfixturevalue(table)
    got = [tuple(r) for r in t.token_files(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_nothing(nothing):
    assert t.token_files(nothing).collect() == []


def test_many_files_are_one_stream(documents):
    from inkspark.llm.common import scratch

    files = t.write_files(documents, scratch(documents.sparkSession, "t"), files=7, block=100)
    rows = t.read_files(files).collect()
    assert files.count() > 3 and len(rows) == documents.count()


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=300), max_size=6), st.integers(1, 64))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(docs, block):
    w = t.Writer(block)
    for i, ids in enumerate(docs):
        w.add(i, ids)
    got = list(t.Reader(b"".join(w.finish())).documents())
    assert [x.tolist() for _, _, x in got] == docs and [d for d, _, _ in got] == list(range(len(docs)))


@given(st.lists(st.text(st.sampled_from("ab'streuvlmd \n\t.,!9é×ªĀ日<|>"), max_size=40), max_size=8))
@settings(max_examples=300, deadline=None)
def test_pieces_agree_with_the_library(texts):
    import pyarrow as pa

    encoder = t._encoder(t.default_path())
    ids, counts = encoder(pa.array(texts, pa.string()))
    want = [encoder.library.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want or not texts


def test_outliers_are_exceptions():
    ids = np.array([5] * 95 + [2**31] * 5, np.uint32)
    assert len(t.pack_block(ids)) < 8 + 5 * 6 + 1
    assert t.unpack_block(t.pack_block(ids), 0, 100).tolist() == ids.tolist()
