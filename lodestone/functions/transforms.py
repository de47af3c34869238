"""Reversible byte transforms: delta, byte planes, run lengths, columnar CSV; and chains of them."""

from __future__ import annotations

import numpy as np

MAX_STEPS = 8
CSV_MARK = 0x43


class TransformError(ValueError):
    """A transform can't be applied or undone."""


def delta(data: bytes, width: int) -> bytes:
    """Differences of little-endian numbers, modulo their width; bytes beyond the last whole number stay."""
    n = len(data) // width * width
    v = np.frombuffer(data[:n], f"<u{width}")
    return (v - np.concatenate([v[:0], np.zeros(min(1, len(v)), v.dtype), v[:-1]])).tobytes() + data[n:]


def undo_delta(data: bytes, width: int) -> bytes:
    n = len(data) // width * width
    v = np.frombuffer(data[:n], f"<u{width}")
    return np.cumsum(v, dtype=v.dtype).tobytes() + data[n:]


def byte_split(data: bytes, width: int) -> bytes:
    """All first bytes of the numbers, then all second ones, and so on."""
    n = len(data) // width * width
    return np.frombuffer(data[:n], np.uint8).reshape(-1, width).T.tobytes() + data[n:]


def undo_byte_split(data: bytes, width: int) -> bytes:
    n = len(data) // width * width
    return np.frombuffer(data[:n], np.uint8).reshape(width, -1).T.tobytes() + data[n:]


def rle(data: bytes) -> bytes:
    """PackBits: 257 - n and a byte for a run of n (2 to 128), n - 1 and the bytes for a literal of n (1 to 128)."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    size = np.diff(np.r_[start, len(a)])
    out = bytearray()
    literal = bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for b, n in zip(a[start].tolist(), size.tolist()):
        if n < 3:
            literal.extend(bytes([b]) * n)
            continue
        flush()
        while n > 1:
            k = min(n, 128)
            out += bytes([257 - k, b])
            n -= k
        if n:
            literal.append(b)
    flush()
    return bytes(out)


def undo_rle(data: bytes, most: int | None = None) -> bytes:
    out = bytearray()
    i = 0
    while i < len(data):
        c = data[i]
        if c == 128:
            raise TransformError("control byte 128")
        n, step = (c + 1, c + 2) if c < 128 else (257 - c, 2)
        if i + step > len(data):
            raise TransformError("cut short")
        out += data[i + 1 : i + 1 + n] if c < 128 else data[i + 1 : i + 2] * n
        if most is not None and len(out) > most:
            raise TransformError("larger than allowed")
        i += step
    return bytes(out)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise TransformError("bad number")
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def csv_columnar(data: bytes, delimiter: bytes) -> bytes:
    """Fields of an even table column by column, after their lengths."""
    ended = data.endswith(b"\n")
    rows = [line.split(delimiter) for line in (data[:-1] if ended else data).split(b"\n")]
    if len({len(r) for r in rows}) != 1:
        raise TransformError("rows of unlike length")
    columns = list(zip(*rows))
    head = bytes([CSV_MARK]) + delimiter + bytes([ended]) + _varint(len(rows)) + _varint(len(columns))
    lengths = b"".join(_varint(len(f)) for c in columns for f in c)
    return head + lengths + b"".join(f for c in columns for f in c)


def undo_csv_columnar(data: bytes) -> bytes:
    if len(data) < 5 or data[0] != CSV_MARK:
        raise TransformError("no columnar table")
    delimiter, ended = data[1:2], data[2]
    n_rows, at = _read_varint(data, 3)
    n_columns, at = _read_varint(data, at)
    if n_rows * n_columns > len(data):
        raise TransformError("more fields than bytes")
    lengths = []
    for _ in range(n_rows * n_columns):
        n, at = _read_varint(data, at)
        lengths.append(n)
    if at + sum(lengths) != len(data):
        raise TransformError("lengths don't match")
    fields = []
    for n in lengths:
        fields.append(data[at : at + n])
        at += n
    rows = (delimiter.join(fields[c * n_rows + r] for c in range(n_columns)) for r in range(n_rows))
    return b"\n".join(rows) + b"\n" * ended


def apply(data: bytes, steps: list[tuple[str, int]], delimiter: bytes = b",") -> tuple[bytes, list[tuple[str, int, int]]]:
    """Run a chain of (transform, width); also the steps with the length each was given."""
    if len(steps) > MAX_STEPS:
        raise TransformError("too many steps")
    done = []
    for name, width in steps:
        done.append((name, width, len(data)))
        if name == "delta":
            data = delta(data, width)
        elif name == "byte_split":
            data = byte_split(data, width)
        elif name == "rle":
            data = rle(data)
        elif name == "csv_columnar":
            data = csv_columnar(data, delimiter)
        else:
            raise TransformError(f"unknown transform {name}")
    return data, done


def invert(data: bytes, done: list[tuple[str, int, int]]) -> bytes:
    """Undo a chain; every step must give back the length that was noted."""
    if len(done) > MAX_STEPS:
        raise TransformError("too many steps")
    for name, width, length in reversed(done):
        if name == "delta":
            data = undo_delta(data, width)
        elif name == "byte_split":
            data = undo_byte_split(data, width)
        elif name == "rle":
            data = undo_rle(data, length)
        elif name == "csv_columnar":
            data = undo_csv_columnar(data)
        else:
            raise TransformError(f"unknown transform {name}")
        if len(data) != length:
            raise TransformError("length doesn't match")
    return data
