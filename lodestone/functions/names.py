"""Small values: labels of block objects, room for packed blocks, zstd windows, anonymous ids."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def block_label(plan: Column) -> Column:
    """How an object of blocks is called after its main plan: a prefix, and dashes for colons."""
    return F.concat(F.lit("blocos:"), F.replace(plan, F.lit(":"), F.lit("-")))


def packed_room(size: Column) -> Column:
    """Bytes to set aside for a packed block: an eighth more, and a page."""
    return size + F.floor(size / 8).cast("long") + 4096


def window_log(log2: Column) -> Column:
    """A window size that zstd takes: 17 to 31 bits."""
    return F.least(F.greatest(log2, F.lit(17)), F.lit(31))


def frame_window(content: Column) -> Column:
    """Window of a zstd frame in bytes, from its header; null for other contents.

    After the magic number a descriptor byte: bit 5 says that the window is the
    content's size, in a field whose width bits 6 and 7 give, behind a
    dictionary id whose width bits 0 and 1 give. Else one byte has the window:
    five bits of exponent over 10, three of eighths.
    """
    at = lambda i: F.conv(F.hex(F.substring(content, i + 1, 1)), 16, 10).cast("long")
    flags = at(4)
    single, size_flag = F.floor(flags / 32) % 2 == 1, F.floor(flags / 64)
    power = F.pow(F.lit(2.0), F.floor(at(5) / 8) + 10).cast("long")
    by_window = power + F.floor(power / 8).cast("long") * (at(5) % 8)
    start = F.when(flags % 4 == 3, 4).otherwise(flags % 4) + 5
    width = F.when(size_flag == 0, 1).when(size_flag == 1, 2).when(size_flag == 2, 4).otherwise(8)
    size = sum((F.when(width > i, F.conv(F.hex(F.substring(content, (start + 1 + i).cast("int"), F.lit(1))), 16, 10).cast("decimal(20,0)") * (1 << (8 * i))).otherwise(0) for i in range(8)), F.lit(0))
    by_size = (size + F.when(size_flag == 1, 256).otherwise(0)).cast("long")
    return F.when((F.octet_length(content) > 5) & (F.substring(content, 1, 4) == F.unhex(F.lit("28B52FFD"))), F.when(single, by_size).otherwise(by_window))


def anonymous_id(salt: bytes, tag: str):
    """A column function: eight bytes of a keyed BLAKE2b over a tag, a zero byte and the value, in hexadecimal."""

    @F.pandas_udf("string")
    def made(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.blake2b(tag.encode() + b"\0" + v.encode(), key=salt, digest_size=8).hexdigest())

    return made
