"""Vectorised text helpers shared by the operators of this subpackage.

They work on one Arrow string column at a time, inside a task. A column is cut
into blocks of whole documents of about ``BLOCK`` bytes, so the temporary numpy
arrays stay small whatever the batch holds; a document longer than a block is a
block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Bytes of text handled at once.
BLOCK = 1 << 20

_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: For a second hash of the same span, where its bytes can't be compared.
OTHER_BYTES = np.random.default_rng(20240502).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED = BYTES.copy()
_FOLDED[65:91] = BYTES[97:123]
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word (splitmix finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``m**i`` and ``m**-i`` modulo 2**64 for i below n (kept between calls up to a block's size)."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, BLOCK + (1 << 16))
    out = []
    for m in (_MULTIPLIER, _INVERSE):
        p = np.full(size, m, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size <= 4 * BLOCK:
        _powers[:] = out
    return out[0], out[1]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about ``size`` bytes together."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = last


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """n + 1 running sums, from which ``span_hash`` takes the hash of any span."""
    s = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(table[data] * powers(len(data))[0][: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal spans wherever they stand."""
    return (s[end] - s[start]) * powers(len(s))[1][start]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of bytes other than 0x20 and 0x09-0x0D.

    offsets: relative to data. Runs end at document borders.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    start = np.flatnonzero(inside & (~before | border))
    end = np.flatnonzero(before & (~inside | border))
    doc = np.searchsorted(offsets, start, "right") - 1
    return start, end, doc


def folded_word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of every word, A-Z folded to a-z."""
    start, end, doc = words(data, offsets)
    h = mix(span_hash(prefix_hash(data, _FOLDED), start, end) + (end - start).astype(np.uint64))
    return h, doc, start, end


_LANES = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingle_hashes(word: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of ``width`` words; of a shorter document, of all its words as one."""
    n = len(word)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=n_docs)
    m = max(n - width + 1, 0)
    h = np.zeros(m, np.uint64)
    for i in range(width):
        h += word[i : i + m] * _LANES[i]
    whole = doc[:m] == doc[width - 1 : width - 1 + m] if m else np.zeros(0, bool)
    h, d = mix(h[whole]), doc[:m][whole]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        first = np.searchsorted(doc, few)
        g = np.zeros(len(few), np.uint64)
        for i in range(width - 1):
            has = count[few] > i
            g[has] += word[first[has] + i] * _LANES[width + i]
        g = mix(g + count[few].astype(np.uint64))
        h, d = np.concatenate([h, g]), np.concatenate([d, few])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def squeezed(c: np.ndarray) -> bytes:
    """A column as differences, which repeated keys and rising places make small, compressed."""
    if c.dtype.kind in "iu" and c.dtype.itemsize > 1:
        c = np.diff(c, prepend=c.dtype.type(0))
    return zstandard.compress(c.tobytes(), 1)


def expanded(blob: bytes, kind: str) -> np.ndarray:
    c = np.frombuffer(zstandard.decompress(blob), kind)
    return np.cumsum(c, dtype=c.dtype) if c.dtype.kind in "iu" and c.dtype.itemsize > 1 else c
