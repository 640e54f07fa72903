"""Whole text columns as flat byte arrays, for operators that work on Arrow batches with numpy.

Everything here is linear in the bytes of one block of documents. A block is cut at document
borders, so memory follows the largest document or ``BLOCK_BYTES``, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document makes a block of its own.
BLOCK_BYTES = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd and 5 mod 8, so its powers have the longest cycle
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
CONTINUES = (np.arange(256) & 0xC0) == 0x80

#: A second modulus: strings built so that every base fails modulo 2**64 differ modulo a prime.
PRIME, PRIME_BASE = (1 << 31) - 1, 1_482_350_267

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_prime_powers = {"up": np.ones(1, np.int64), "down": np.ones(1, np.int64)}


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, document borders and the mask of non-null rows of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[borders[0]:borders[-1]], borders - borders[0], valid


def blocks(data: np.ndarray, borders: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, document after the last, bytes, borders from 0) of each block."""
    first, n = 0, len(borders) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(borders, borders[first] + limit, "right")) - 1)
        yield first, last, data[borders[first]:borders[last]], borders[first:last + 1] - borders[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the whole word."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def powers(n: int, which: str = "up") -> np.ndarray:
    """The first ``n`` powers of the base, or of its inverse modulo 2**64."""
    if len(_powers[which]) < n:
        out = np.full(max(n, BLOCK_BYTES + 64), BASE if which == "up" else INVERSE, np.uint64)
        out[0] = 1
        _powers[which] = np.multiply.accumulate(out)
    return _powers[which][:n]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix polynomial sums; entry i covers the first i symbols."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(len(symbols)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the symbols lo..hi-1, equal for equal strings wherever they stand; its low bits are weak, so mix it."""
    return (prefix[hi] - prefix[lo]) * powers(len(prefix), "down")[lo]


def prime_powers(n: int, which: str = "up") -> np.ndarray:
    """The first ``n`` powers of the second base, or of its inverse, modulo the prime."""
    base = PRIME_BASE if which == "up" else pow(PRIME_BASE, -1, PRIME)
    out = _prime_powers[which]
    while len(out) < n:
        out = np.concatenate((out, out * pow(base, len(out), PRIME) % PRIME))
    _prime_powers[which] = out
    return out[:n]


def span_keys(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit keys of the byte strings lo..hi-1, from two polynomial hashes with different moduli and the length."""
    first = mix(span_hash(prefix_hash(data), lo, hi))
    sums = np.zeros(len(data) + 1, np.int64)  # 2**31 bytes of less than 2**31 each stay below 2**63
    np.cumsum((data.astype(np.int64) + 1) * prime_powers(len(data)) % PRIME, out=sums[1:])
    second = (sums[hi] - sums[lo]) % PRIME * prime_powers(len(data) + 1, "down")[lo] % PRIME
    return first ^ mix(second.astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64))


def words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of bytes that are no separator; no word crosses documents."""
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[borders] = True
    begin = inside & np.concatenate(([True], ~inside[:-1])) if len(data) else inside
    begin |= inside & edge[:-1]
    end = inside & np.concatenate((~inside[1:], [True])) if len(data) else inside
    end |= inside & edge[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(borders, starts, "right") - 1


def runs_of(sorted_ids: np.ndarray, n: int) -> np.ndarray:
    """Borders of each id 0..n-1 in a sorted id array."""
    return np.searchsorted(sorted_ids, np.arange(n + 1))


def windows(hashes: np.ndarray, document: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first index of every run of ``size`` neighbours that lies in one document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total *= BASE
        total += hashes[k:k + n]
    at = np.flatnonzero(document[:n] == document[size - 1:size - 1 + n])
    return mix(total[at]), at


def spans(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after another."""
    total = int(lengths.sum())
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(total) - first
