"""Containers of compressed objects: sealed envelopes and block files with random access.

An envelope is one JSON header and one payload with a 64-bit checksum. A block
file is a header, the blocks' payloads, a footer with the block table, and a
trailer that points to the footer; it is read from its end.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import codecs, transforms
from ..functions.hashing import blake3, checksum64
from ..plans import planner

HEADER = b"LODB\x04\x00\x00"
TRAILER = struct.Struct("<QQQ")
ENVELOPE = b"LODE\x03"
#: Error codes of readers, in the order in which they are checked.
ERRORS = ("too_short", "bad_magic", "bad_trailer", "bad_footer", "footer_checksum", "bad_table", "unknown_plan", "payload_hash", "decode", "length", "too_large", "fidelity")
MOST_FOOTER, MOST_PLANS, LOG2_RANGE = 64 << 20, 65_536, (12, 26)


class ContainerError(ValueError):
    def __init__(self, code: str, what: str = ""):
        super().__init__(f"{code}: {what}" if what else code)
        self.code = code


def kind(data: bytes) -> str | None:
    """Which of the two a file is, by its first bytes."""
    return "blocks" if data.startswith(HEADER[:4]) else "envelope" if data.startswith(ENVELOPE[:4]) else None


def is_envelope(content: Column) -> Column:
    """The same for a column: whether contents are envelopes."""
    return F.substring(content, 1, 4) == F.lit(ENVELOPE[:4])


def seal(data: bytes, label: str, name: str = "", delimiter: bytes = b",") -> bytes:
    payload, done = planner.run_plan(data, label, delimiter)
    steps, *_ = planner.parsed(label)
    before = len(transforms.apply(data, steps, delimiter)[0])
    head = {"name": name, "plan": label, "steps": done, "length": len(data), "before": before, "checksum": checksum64(payload), "digest": blake3(data).hex()}
    text = json.dumps(head, separators=(",", ":")).encode()
    return ENVELOPE + struct.pack("<I", len(text)) + text + payload


def unseal(sealed: bytes, most: int = 1 << 30) -> bytes:
    if len(sealed) < len(ENVELOPE) + 4:
        raise ContainerError("too_short")
    if not sealed.startswith(ENVELOPE):
        raise ContainerError("bad_magic")
    (n,) = struct.unpack_from("<I", sealed, len(ENVELOPE))
    start = len(ENVELOPE) + 4
    try:
        head = json.loads(sealed[start : start + n])
        payload = sealed[start + n :]
        length, before = int(head["length"]), int(head["before"])
    except (ValueError, KeyError, TypeError) as e:
        raise ContainerError("bad_footer") from e
    if head.get("checksum") and checksum64(payload) != head["checksum"]:
        raise ContainerError("payload_hash")
    if max(length, before) > most:
        raise ContainerError("too_large")
    try:
        data = planner.restore(payload, head["plan"], [tuple(s) for s in head["steps"]], length, before=before)
    except (ValueError, KeyError, TypeError) as e:
        raise ContainerError("decode", str(e)) from e
    if head.get("digest") and blake3(data).hex() != head["digest"]:
        raise ContainerError("fidelity")
    return data


@dataclass
class Block:
    index: int
    offset: int
    stored_len: int
    original_len: int
    plan: str
    digest: str


def pack_block(block: bytes, label: str = "zstd:3") -> tuple[bytes, str]:
    """Payload and plan of a block: stored where nothing is gained or a probe sees nothing to gain."""
    if label == "stored" or codecs.looks_incompressible(block):
        return block, "stored"
    payload, _ = planner.run_plan(block, label)
    return (payload, label) if len(payload) < len(block) else (block, "stored")


def write_blocks(blocks: Iterator[bytes], log2_size: int, label: str = "zstd:3", name: str = "") -> bytes:
    """A block file; all blocks but the last have 2 ** log2_size bytes."""
    if not LOG2_RANGE[0] <= log2_size <= LOG2_RANGE[1]:
        raise ContainerError("bad_table", "block size")
    out, table, plans, at, short = [HEADER], [], {}, len(HEADER), False
    for block in blocks:
        if short or not 0 < len(block) <= 1 << log2_size:
            raise ContainerError("bad_table", "only the last block may be short")
        short = len(block) < 1 << log2_size
        payload, plan = pack_block(block, label)
        table.append((len(payload), len(block), plans.setdefault(plan, len(plans)), blake3(payload)[:16].hex()))
        out.append(payload)
        at += len(payload)
    footer = json.dumps({"name": name, "log2": log2_size, "length": sum(t[1] for t in table), "plans": list(plans), "blocks": table}, separators=(",", ":")).encode()
    return b"".join([*out, footer, TRAILER.pack(at, len(footer), checksum64(footer))])


def read_table(data: bytes) -> tuple[dict, list[Block]]:
    """Footer and block table, checked, without touching any payload."""
    if len(data) < len(HEADER) + TRAILER.size:
        raise ContainerError("too_short")
    if not data.startswith(HEADER):
        raise ContainerError("bad_magic")
    at, size, check = TRAILER.unpack(data[-TRAILER.size :])
    if at < len(HEADER) or size > MOST_FOOTER or at + size != len(data) - TRAILER.size:
        raise ContainerError("bad_trailer")
    text = data[at : at + size]
    if checksum64(text) != check:
        raise ContainerError("footer_checksum")
    try:
        footer = json.loads(text)
        rows, plans, log2 = footer["blocks"], footer["plans"], footer["log2"]
    except (ValueError, KeyError) as e:
        raise ContainerError("bad_footer") from e
    if not LOG2_RANGE[0] <= log2 <= LOG2_RANGE[1] or len(plans) > MOST_PLANS:
        raise ContainerError("bad_table")
    out, place = [], len(HEADER)
    for i, (stored, original, plan, digest) in enumerate(rows):
        if not 0 < original <= 1 << log2 or original < 1 << log2 and i < len(rows) - 1 or not 0 < stored <= original:
            raise ContainerError("bad_table", f"block {i}")
        if plan >= len(plans):
            raise ContainerError("unknown_plan", f"block {i}")
        out.append(Block(i, place, stored, original, plans[plan], digest))
        place += stored
    if place != at or sum(b.original_len for b in out) != footer["length"]:
        raise ContainerError("bad_table", "sums")
    return footer, out


def read_block(data: bytes, block: Block) -> bytes:
    """One block, without reading any other."""
    payload = data[block.offset : block.offset + block.stored_len]
    if blake3(payload)[:16].hex() != block.digest:
        raise ContainerError("payload_hash", f"block {block.index}")
    steps, *_ = planner.parsed(block.plan)
    try:
        done = [(n, w, block.original_len) for n, w in steps]
        return planner.restore(payload, block.plan, done, block.original_len)
    except ValueError as e:
        raise ContainerError("decode", f"block {block.index}") from e


def corrupted(data: bytes) -> list[int]:
    """Numbers of the blocks that can't be read."""
    _, blocks = read_table(data)
    out = []
    for b in blocks:
        try:
            read_block(data, b)
        except ContainerError:
            out.append(b.index)
    return out
