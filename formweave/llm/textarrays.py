"""Word and shingle hashes of whole Arrow string batches, as array arithmetic.

A batch is one run of UTF-8 bytes.  Every byte maps to a random 64-bit number
and is scaled by a power of an odd base, so that the hash of any word is a
difference of two prefix sums; no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 20

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        if size > 8 * CHUNK:  # of one huge document: not worth keeping
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about CHUNK bytes: first, last + 1, bytes, offsets."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word, in order."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[raw]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[heads] = inside[heads]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    end[tails] = inside[tails]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word; with lower, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _BYTES)[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``width`` words; a document with fewer words gives its whole sequence."""
    counts = np.bincount(doc, minlength=n_docs)
    if len(words) >= width:
        n = len(words) - width + 1
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total = (total + words[j : j + n]) * _BASE
            total ^= total >> np.uint64(33)
        whole = doc[:n] == doc[width - 1 :]
        full, of = mix(total[whole]), doc[:n][whole]
    else:
        full, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        firsts = np.concatenate(([0], np.cumsum(counts)))[short]
        extra = np.empty(len(short), np.uint64)
        for k, (at, m) in enumerate(zip(firsts, counts[short], strict=True)):
            value = np.uint64(m)
            with np.errstate(over="ignore"):
                for w in words[at : at + m]:
                    value = (value ^ w) * _INVERSE
                    value ^= value >> np.uint64(33)
            extra[k] = value
        full, of = np.concatenate([full, mix(extra)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        full, of = full[order], of[order]
    return full, of


def distinct_sets(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' sorted sets, one after the other, and their offsets (n_docs + 1)."""
    counts = np.bincount(doc, minlength=n_docs)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    hashes = hashes.copy()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        hashes[a:b].sort()
    if len(hashes):
        fresh = np.empty(len(hashes), bool)
        fresh[0] = True
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        hashes, doc = hashes[fresh], doc[fresh]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n_docs))))


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of documents: first, last + 1, the sorted shingle sets and their offsets."""
    raw, offsets = text_bytes(column)
    for first, last, part, at in chunks(raw, offsets):
        starts, ends, doc = word_spans(part, at)
        hashes, of = shingle_hashes(word_hashes(part, starts, ends), doc, last - first, width)
        yield first, last, *distinct_sets(hashes, of, last - first)
