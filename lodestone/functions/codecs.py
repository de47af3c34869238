"""Lossless codecs with output limits."""

from __future__ import annotations

import bz2
import lzma
import zlib

import pyarrow as pa
import zstandard

#: Codec, lowest, highest and default level, takes a dictionary, other names.
CATALOG: list[tuple[str, int, int, int, bool, str]] = [
    ("stored", 0, 0, 0, False, "none passthrough raw"),
    ("lz4", 0, 0, 0, False, "ultra_fast"),
    ("deflate", 0, 9, 6, False, "zlib gzip flate"),
    ("zstd", -7, 22, 10, True, ""),
    ("bzip2", 1, 9, 9, False, "bz2"),
    ("brotli", 0, 11, 11, False, ""),
    ("xz", 0, 9, 6, False, "lzma lzma2"),
]
_XZ_MEMORY = 256 * 1024 * 1024


class CodecError(ValueError):
    """A payload can't be decoded within its limit, or a level is out of range."""


def named(name: str) -> str:
    for codec, *_, other in CATALOG:
        if name == codec or name in other.split():
            return codec
    raise CodecError(f"unknown codec {name}")


def checked_level(codec: str, level: int | None) -> int:
    _, low, high, default, *_ = next(c for c in CATALOG if c[0] == codec)
    if level is None:
        return default
    if not low <= level <= high:
        raise CodecError(f"{codec} has levels {low} to {high}")
    return level


def label(codec: str, level: int) -> str:
    high = next(c[2] for c in CATALOG if c[0] == codec)
    return f"{codec}:{level}" if high > 0 else codec


_zstd: dict[tuple[int, bool, bytes], zstandard.ZstdCompressor] = {}


def _compressor(level: int, far: bool, dictionary: bytes) -> zstandard.ZstdCompressor:
    """One for each worker and setting."""
    key = (level, far, dictionary)
    if key not in _zstd:
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=True, **({"enable_ldm": True} if far else {}))
        _zstd[key] = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return _zstd[key]


def encode(data: bytes, codec: str, level: int | None = None, dictionary: bytes = b"") -> bytes:
    level = checked_level(codec, level)
    if codec == "stored":
        return data
    if codec == "lz4":
        return len(data).to_bytes(4, "little") + (pa.Codec("lz4_raw").compress(data, asbytes=True) if data else b"")
    if codec == "deflate":
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()
    if codec == "zstd":
        return _compressor(level, level >= 10 and len(data) > 1 << 20, dictionary).compress(data)
    if codec == "bzip2":
        return bz2.compress(data, level)
    if codec == "brotli":
        return pa.Codec("brotli", level).compress(data, asbytes=True)
    return lzma.compress(data, preset=level)


def decode(data: bytes, codec: str, most: int, dictionary: bytes = b"", length: int | None = None) -> bytes:
    """At most ``most`` bytes come out; anything that would be larger is refused. brotli needs the true ``length``."""
    try:
        if codec == "stored":
            out = data
        elif codec == "lz4":
            size = int.from_bytes(data[:4], "little")
            if len(data) < 4 or size > most or size > 255 * max(1, len(data) - 4) + 16:
                raise CodecError("lz4 size isn't plausible")
            out = pa.Codec("lz4_raw").decompress(data[4:], size, asbytes=True) if size else b""
        elif codec == "deflate":
            out = zlib.decompressobj(-15).decompress(data, most + 1)
        elif codec == "zstd":
            held = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, max_window_size=1 << 31)
            with held.stream_reader(data) as reader:
                out = reader.read(most + 1)
        elif codec == "bzip2":
            out = bz2.BZ2Decompressor().decompress(data, most + 1)
        elif codec == "brotli":
            if length is None or length > most:
                raise CodecError("larger than allowed")
            out = pa.Codec("brotli").decompress(data, length, asbytes=True) if length else b""
        elif codec == "xz":
            out = lzma.LZMADecompressor(memlimit=_XZ_MEMORY).decompress(data, most + 1)
        else:
            raise CodecError(f"unknown codec {codec}")
    except CodecError:
        raise
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, pa.ArrowException, ValueError) as e:
        raise CodecError(f"{codec}: {e}") from e
    if len(out) > most:
        raise CodecError("larger than allowed")
    return out


def patch(old: bytes, new: bytes, level: int = 3) -> bytes:
    """``new`` compressed with ``old`` as what came before it."""
    window = min(27, max(21, (len(old) + len(new)).bit_length()))
    params = zstandard.ZstdCompressionParameters.from_level(level, window_log=window, enable_ldm=True)
    held = zstandard.ZstdCompressionDict(old, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if old else None
    return zstandard.ZstdCompressor(compression_params=params, dict_data=held).compress(new)


def unpatch(old: bytes, delta: bytes, most: int) -> bytes:
    held = zstandard.ZstdCompressionDict(old, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if old else None
    with zstandard.ZstdDecompressor(dict_data=held, max_window_size=1 << 27).stream_reader(delta) as reader:
        out = reader.read(most + 1)
    if len(out) > most:
        raise CodecError("larger than allowed")
    return out


def probe_positions(n: int, pieces: int = 4, size: int = 1024) -> list[int]:
    """Starts of sample pieces, spread evenly over n bytes."""
    return [max(0, min(n - size, (2 * p + 1) * n // (2 * pieces) - size // 2)) for p in range(pieces)]


def looks_incompressible(block: bytes) -> bool:
    """Whether zstd-1 leaves 98 % or more of four samples of 1 KiB (of all of a short block)."""
    sample = block if len(block) <= 4096 else b"".join(block[p : p + 1024] for p in probe_positions(len(block)))
    return bool(sample) and len(encode(sample, "zstd", 1)) * 100 >= len(sample) * 98


def train_dictionary(samples: list[bytes]) -> bytes | None:
    """A zstd dictionary from at least 12 samples and 48 KiB, an eighth of them in size (4 to 112 KiB); else none."""
    samples = [s[: 64 * 1024] for s in samples]
    total = sum(map(len, samples))
    if len(samples) < 12 or total < 48 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(max(total // 8, 4 * 1024), 112 * 1024), samples).as_bytes()
    except zstandard.ZstdError:
        return None
