"""Content-defined chunking with a gear hash, and fixed chunking."""

from __future__ import annotations

import functools

import numpy as np


@functools.lru_cache
def _gear() -> tuple[int, ...]:
    return tuple(int(x) for x in np.random.default_rng(20261103).integers(0, 1 << 64, 256, dtype=np.uint64))


@functools.lru_cache
def _masks(target: int) -> tuple[int, int]:
    """A strict and a loose mask: two bits more and two fewer than the target size asks for."""
    bits = target.bit_length() - 1
    places = np.random.default_rng(1234567).permutation(np.arange(16, 64)).tolist()
    return sum(1 << p for p in places[: bits + 2]), sum(1 << p for p in places[: bits - 2])


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte as if it had begun long before: sum of gear[b] << age over the last 64 bytes."""
    g = np.array(_gear(), np.uint64)[data]
    out = g.copy()
    span = 1
    while span < 64:  # h(i) over 2k bytes = h(i) over k bytes + (h(i - k) over k bytes << k)
        shifted = np.zeros_like(out)
        shifted[span:] = out[:-span] << np.uint64(span)
        out = out + shifted
        span *= 2
    return out


def cdc(data: bytes, target: int = 8192) -> list[tuple[int, int]]:
    """(offset, length) of chunks of a quarter to eight times the target size.

    The hash starts anew at each chunk's smallest size; from the target size on
    the loose mask counts. A rest up to the smallest size is one chunk.
    """
    a = np.frombuffer(data, np.uint8)
    n, least, most = len(a), target // 4, target * 8
    strict, loose = (np.uint64(m) for m in _masks(target))
    warm = gear_hashes(a)
    hit_strict, hit_loose = np.flatnonzero(warm & strict == 0), np.flatnonzero(warm & loose == 0)
    gear = _gear()
    out, start = [], 0
    while n - start > least:
        begin, normal, end = start + least, min(n, start + target), min(n, start + most)
        cut = None
        h = 0
        for i in range(begin, min(begin + 64, end)):  # the hash has seen fewer than 64 bytes yet
            h = (h << 1) + gear[a[i]] & 0xFFFFFFFFFFFFFFFF
            if not h & int(strict if i < normal else loose):
                cut = i + 1
                break
        if cut is None:
            for hits, low, high in ((hit_strict, begin + 64, normal), (hit_loose, max(begin + 64, normal), end)):
                k = np.searchsorted(hits, low)
                if low < high and k < len(hits) and hits[k] < high:
                    cut = int(hits[k]) + 1
                    break
        cut = cut or end
        out.append((start, cut - start))
        start = cut
    if start < n:
        out.append((start, n - start))
    return out


def fixed(data: bytes, size: int) -> list[tuple[int, int]]:
    return [(i, min(size, len(data) - i)) for i in range(0, len(data), size)]
