"""Vectorised word and word-sequence hashes over UTF-8 texts (numpy, inside tasks).

Hashes are sums of per-byte or per-word 64-bit values times powers of an odd base,
modulo 2**64, then mixed; the same words give the same hash on any machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and ``BASE ** -i`` for i up to ``n`` at least."""
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        one = np.ones(1, np.uint64)
        _POWERS[:] = [np.cumprod(np.concatenate([one, np.full(size, b, np.uint64)])) for b in (BASE, INVERSE)]
    return _POWERS[0], _POWERS[1]


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums of ``values[i] * BASE ** i``, from 0."""
    up, _ = powers(len(values))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:len(values)])])


def between(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of ``values[start:end]`` from ``run = sums(values)``, wherever it lies."""
    _, down = powers(len(run))
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * BASE)


def word_hashes(text: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each word of ``text``."""
    raw = np.frombuffer(text, np.uint8)
    gap = np.concatenate([[True], SPACE[raw], [True]])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # whole words of about CHUNK bytes at a time
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        part = raw[starts[i]:ends[j - 1]]
        run = sums(BYTE[LOWER[part] if lower else part])
        out[i:j] = between(run, starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out, starts, ends


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null is empty."""
    return pc.fill_null(column, "").cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def doc_words(texts: list[bytes], lower: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of each text, hashed in runs of about CHUNK bytes."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        hashes, starts, _ = word_hashes(b" ".join(texts[i:j]), lower)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        cut = np.searchsorted(starts, begin)
        for k in range(i, j):
            yield k, hashes[cut[k - i]:cut[k - i + 1]]
        i = j
