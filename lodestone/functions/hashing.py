"""BLAKE3 in pure Python, for container checks on workers; the class-free form of the public specification."""

from __future__ import annotations

import struct

# Fixed values of the specification: initial state, message order, flags.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF


def _compress(chain: tuple[int, ...], block: bytes, counter: int, size: int, flags: int) -> list[int]:
    m = list(struct.unpack("<16I", block))
    v = [*chain, *_IV[:4], counter & _MASK, counter >> 32, size, flags]

    def mix(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for word, first, second in ((x, 16, 12), (y, 8, 7)):
            v[a] = v[a] + v[b] + word & _MASK
            t = v[d] ^ v[a]
            v[d] = (t >> first | t << 32 - first) & _MASK
            v[c] = v[c] + v[d] & _MASK
            t = v[b] ^ v[c]
            v[b] = (t >> second | t << 32 - second) & _MASK

    for r in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[k] for k in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def blake3(data: bytes) -> bytes:
    """32 bytes. Some MB/s at most: for footers and small payloads."""
    chunks = [data[i : i + 1024] for i in range(0, len(data), 1024)] or [b""]
    nodes: list[tuple[tuple[int, ...], bytes, int, int, int]] = []
    for n, chunk in enumerate(chunks):
        chain: tuple[int, ...] = _IV
        blocks = [chunk[i : i + 64] for i in range(0, len(chunk), 64)] or [b""]
        for i, block in enumerate(blocks):
            flags = _START * (i == 0) | _END * (i == len(blocks) - 1)
            last = (chain, block.ljust(64, b"\0"), n, len(block), flags)
            if i < len(blocks) - 1:
                chain = tuple(_compress(*last))
        nodes.append(last)

    def parent(a: int, b: int) -> tuple[tuple[int, ...], bytes, int, int, int]:
        if b - a == 1:
            return nodes[a]
        half = 1 << (b - a - 1).bit_length() - 1
        pair = _compress(*parent(a, a + half)) + _compress(*parent(a + half, b))
        return _IV, struct.pack("<16I", *pair), 0, 64, _PARENT

    chain, block, counter, size, flags = parent(0, len(nodes))
    return struct.pack("<8I", *_compress(chain, block, counter, size, flags | _ROOT))


def checksum64(payload: bytes) -> int:
    """First 8 bytes of the digest as a number; 0 is kept for unchecked."""
    return int.from_bytes(blake3(payload)[:8], "little")
