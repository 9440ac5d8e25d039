"""Vectorised word, shingle and hash arithmetic over whole Arrow string columns.

The functions work on UTF-8 bytes as Arrow hands them over, so a batch costs a
few numpy passes instead of a Python loop over words.  Words are identified by
64-bit polynomial hashes (random odd base, modulo 2**64, finished by a
splitmix64 round).  Every doc is processed whole; batches are cut *between*
docs into chunks of about ``CHUNK`` bytes to bound memory.
"""

from __future__ import annotations

import numpy as np

CHUNK = 2_000_000
U = np.uint64
BASE = 0x9E6C_63D0_876A_68EB | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: odd multipliers for the positions of a shingle
POSITION = [pow(0xD6E8_FEB8_6659_FD93, i + 1, 1 << 64) | 1 for i in range(16)]

#: lower-cases A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: word bytes: all but blank and \t \n \v \f \r
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: word bytes: digits, letters and everything beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict = {}


def powers(n):
    """B**i and B**-i for i < n, modulo 2**64."""
    have = _powers.get("n", 0)
    if have < n:
        n = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            x = np.full(n, base, dtype=U)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mix(x):
    """splitmix64 finaliser."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column(array):
    """(bytes, offsets) of an Arrow string or binary array; null counts as empty."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    _, at, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(data, at, size=CHUNK):
    """(first doc, end doc, bytes, offsets) of runs of docs of about ``size`` bytes; a longer doc stays whole."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data, at, table=NOT_SPACE):
    """(starts, ends, word offsets of the docs): byte ranges of all words, none across docs."""
    n = len(data)
    inside = table[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    before[at[:-1][at[:-1] < n]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data, starts, ends):
    """64-bit hashes of the byte ranges, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((LOWER[data].astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingles(word, at, k):
    """(hashes, offsets) of the k-word shingles of each doc, in order; of fewer words, but not none, the whole as one."""
    n = len(word)
    counts = np.diff(at)
    value = np.zeros(n, U)
    for i in range(min(k, n)):
        value[: n - i] += word[i:] * U(POSITION[i])
    keep = np.ones(n, dtype=bool)
    for i in range(1, k):  # the last k-1 starts of a doc have no whole shingle
        keep[(at[1:] - i)[counts >= i]] = False
    for r in np.unique(counts[(counts > 0) & (counts < k)]):
        first = at[:-1][counts == r]
        whole = np.full(len(first), int(r) * 0x632BE59BD9B4E019 % (1 << 64), U)
        for i in range(int(r)):
            whole += word[first + i] * U(POSITION[i])
        value[first], keep[first] = whole, True
    sums = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=sums[1:])
    return mix(value[keep]), sums[at]


def signed(x):
    """uint64 as the int64 that Spark's long holds."""
    return np.asarray(x, U).view(np.int64)
