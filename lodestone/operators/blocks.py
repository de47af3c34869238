"""Operators on whole contents and blocks: round trips, probes, chunks, deltas, sampling, containers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chunking, codecs, transforms
from ..sources import container


def _per_row(df: DataFrame, columns: list, schema: str, make: Callable[..., list[tuple]]) -> DataFrame:
    """Rows that ``make`` gives for the values of each row."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([out for row in frame.itertuples(index=False) for out in make(*row)], columns=names)

    return df.select(*columns).mapInPandas(run, schema)


def transform_round_trips(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """For each content and transform: sizes, and whether the inverse gives the content back."""
    chains = [[("delta", w)] for w in (1, 2, 4, 8)] + [[("byte_split", w)] for w in (2, 4, 8)] + [[("rle", 0)], [("delta", 8), ("byte_split", 8)], [("byte_split", 8), ("rle", 0)]]

    def make(key: int, data: bytes) -> list[tuple]:
        out = []
        for chain in chains:
            made, done = transforms.apply(bytes(data), chain)
            out.append((key, ">".join(f"{n}:{w}" if w else n for n, w in chain), len(data), len(made), transforms.invert(made, done) == data))
        return out

    return _per_row(df, [F.col(id_col), F.col(content_col).cast("binary")], "id long, chain string, size long, made long, ok boolean", make)


def codec_round_trips(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """For each content and codec of the catalog at its default level: size, and whether it decodes."""
    levels = {c[0]: c[3] for c in codecs.CATALOG}

    def make(key: int, data: bytes) -> list[tuple]:
        out = []
        for codec, level in levels.items():
            packed = codecs.encode(bytes(data), codec, level)
            out.append((key, codecs.label(codec, level), len(data), len(packed), codecs.decode(packed, codec, len(data), length=len(data)) == data))
        return out

    return _per_row(df, [F.col(id_col), F.col(content_col).cast("binary")], "id long, codec string, size long, packed long, ok boolean", make)


def probe_blocks(blocks: DataFrame) -> DataFrame:
    """(id, block, chunk) to what the probe says, and what zstd-3 really leaves."""

    def make(key: int, block: int, chunk: bytes) -> list[tuple]:
        return [(key, block, len(chunk), codecs.looks_incompressible(bytes(chunk)), len(codecs.encode(bytes(chunk), "zstd", 3)))]

    return _per_row(blocks, ["id", "block", "chunk"], "id long, block int, size long, incompressible boolean, packed long", make)


def cdc_chunks(df: DataFrame, id_col: str, content_col: str, target: int = 8192) -> DataFrame:
    """Content-defined chunks: id, offset, length, digest."""
    def make(key: int, data: bytes) -> list[tuple]:
        data = bytes(data)
        return [(key, a, n, hashlib.sha256(data[a : a + n]).hexdigest()) for a, n in chunking.cdc(data, target)]

    return _per_row(df, [F.col(id_col), F.col(content_col).cast("binary")], "id long, offset long, length long, digest string", make)


def delta_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old, new) to the size of ``new`` alone and as a delta to ``old``, and whether it is given back."""
    schema = ", ".join(f"{k} long" for k in keys) + ", size long, alone long, delta long, ok boolean"

    def make(*row) -> list[tuple]:
        old, new = bytes(row[-2]), bytes(row[-1])
        patch = codecs.patch(old, new)
        return [(*row[:-2], len(new), len(codecs.encode(new, "zstd", 3)), len(patch), codecs.unpatch(old, patch, len(new)) == new)]

    return _per_row(pairs, [*keys, "old", "new"], schema, make)


def sample_blocks(blocks: DataFrame, class_col: str, id_cols: list[str], budget: dict[str, int] | int, seed: int = 0) -> DataFrame:
    """Blocks with equal chance in their class, about ``budget`` of each; the choice is a digest's, so reruns agree."""
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *id_cols), 11) / F.lit(float(1 << 53))
    counts = blocks.groupBy(class_col).agg(F.count("*").alias("_n"))
    want = F.lit(budget) if isinstance(budget, int) else F.coalesce(*[F.when(F.col(class_col) == c, F.lit(n)) for c, n in budget.items()], F.lit(0))
    return blocks.join(F.broadcast(counts), class_col).where(unit < want / F.col("_n")).drop("_n")


def bootstrap_ratio(rows: DataFrame, class_col: str, unit_cols: list[str], numerator: str, denominator: str, rounds: int = 200, seed: int = 0) -> DataFrame:
    """Ratio of sums by class with a 95 % interval from Poisson weights.

    A weight depends on the unit, the round and the seed alone, so partitioning
    doesn't matter: units count 0, 1, 2, ... times by a digest.
    """
    exact = rows.groupBy(class_col).agg((F.sum(numerator) / F.sum(denominator)).alias("ratio"), F.count("*").alias("units"))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("round"), *unit_cols), 11) / F.lit(float(1 << 53))
    limits, p, total = [], np.exp(-1.0), 0.0
    for k in range(12):
        total += p
        limits.append(float(total))
        p /= k + 1
    weight = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x <= F.col("u")))
    drawn = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("u", unit).withColumn("w", weight)
    each = drawn.groupBy(class_col, "round").agg((F.sum(F.col("w") * F.col(numerator)) / F.sum(F.col("w") * F.col(denominator))).alias("r"))
    ends = each.groupBy(class_col).agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"))
    return exact.join(ends, class_col)


def pair_allocation(counts: DataFrame, class_col: str, n_col: str, total: int, least: int = 5) -> DataFrame:
    """How many pairs of each class to take: at least ``least`` (or all there are), the rest in proportion."""
    everything = counts.agg(F.sum(F.least(F.lit(least), F.col(n_col))).alias("_given"), F.sum(F.greatest(F.col(n_col) - least, F.lit(0))).alias("_left"))
    rows = counts.crossJoin(F.broadcast(everything))
    more = F.when(F.col("_left") > 0, F.floor((total - F.col("_given")) * F.greatest(F.col(n_col) - least, F.lit(0)) / F.col("_left"))).otherwise(0)
    return rows.withColumn("take", F.least(F.col(n_col), F.least(F.lit(least), F.col(n_col)) + F.greatest(more, F.lit(0)))).drop("_given", "_left")


def write_block_files(df: DataFrame, id_col: str, content_col: str, log2_size: int = 12, label: str = "zstd:3") -> DataFrame:
    """Each content as a block file: id, size, packed (binary)."""

    def make(key: int, data: bytes) -> list[tuple]:
        data = bytes(data)
        return [(key, len(data), container.write_blocks((data[a : a + n] for a, n in chunking.fixed(data, 1 << log2_size)), log2_size, label))]

    return _per_row(df, [F.col(id_col), F.col(content_col).cast("binary")], "id long, size long, packed binary", make)


def block_table(files: DataFrame) -> DataFrame:
    """The block tables of block files (id, packed); a file that can't be read gives one row with its error."""

    def make(key: int, packed: bytes) -> list[tuple]:
        try:
            _, blocks = container.read_table(bytes(packed))
        except container.ContainerError as e:
            return [(key, None, None, None, None, None, e.code)]
        return [(key, b.index, b.offset, b.stored_len, b.original_len, b.plan, None) for b in blocks]

    return _per_row(files, ["id", "packed"], "id long, block int, offset long, stored_len long, original_len long, plan string, error string", make)


def packed(df: DataFrame, id_col: str, content_col: str, codec: str, level: int) -> DataFrame:
    """Each content by one codec: id, size, packed."""

    def make(key: int, data: bytes) -> list[tuple]:
        return [(key, len(data), codecs.encode(bytes(data), codec, level))]

    return _per_row(df, [F.col(id_col), F.col(content_col).cast("binary")], "id long, size long, packed binary", make)


def trained_dictionaries(df: DataFrame, class_col: str, content_col: str, order_col: str, most: int = 8 << 20) -> DataFrame:
    """A dictionary for each class with samples enough: class, id (class and digest), content.

    A class's samples are its first ones by a digest of their place, each 64 KiB
    at most, up to ``most`` bytes together, so a task holds no more than those.
    """
    size = F.least(F.octet_length("content"), F.lit(64 * 1024)).cast("long")
    rows = df.select(F.col(class_col).alias("class"), F.xxhash64(order_col).alias("at"), F.substring(F.col(content_col).cast("binary"), 1, 64 * 1024).alias("content")).withColumn("size", size)
    # how far the digests reach that fill the room, from counts of 1,024 parts of their range
    part = F.shiftrightunsigned("at", 54)
    upto = F.sum("bytes").over(W.partitionBy("class").orderBy("part"))
    parts = rows.groupBy("class", part.alias("part")).agg(F.sum("size").alias("bytes")).withColumn("upto", upto).where((F.col("upto") - F.col("bytes")) < most).groupBy("class").agg(F.max("part").alias("last"))
    rows = rows.join(F.broadcast(parts), "class").where(part <= F.col("last"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at"])
        frame = frame[frame["size"].cumsum() <= most]
        made = codecs.train_dictionary([bytes(x) for x in frame["content"]])
        name = frame["class"].iloc[0] if len(frame) else ""
        return pd.DataFrame([(name, f"{name}.{hashlib.sha256(made).hexdigest()[:16]}", made)] if made else [], columns=["class", "id", "content"])

    return rows.groupBy("class").applyInPandas(run, "class string, id string, content binary")


def resolved(dictionaries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The dictionaries with the ids ``wanted`` (class, id) whose content has the digest that the id names."""
    sound = F.substring(F.sha2("content", 256), 1, 16) == F.element_at(F.split("id", "[.]"), -1)
    return dictionaries.where(sound).join(F.broadcast(wanted.select("id")), "id").select("class", "id", "content")


def dictionary_round_trips(df: DataFrame, id_col: str, class_col: str, content_col: str, known: dict[str, bytes], level: int = 3) -> DataFrame:
    """Each content packed with its class's dictionary and opened again: id, class, size, alone, packed, ok."""

    def make(key: int, klass: str, data: bytes) -> list[tuple]:
        data, held = bytes(data), known[klass]
        made = codecs.encode(data, "zstd", level, held)
        return [(key, klass, len(data), len(codecs.encode(data, "zstd", level)), len(made), codecs.decode(made, "zstd", len(data), held, len(data)) == data)]

    return _per_row(df, [F.col(id_col), F.col(class_col), F.col(content_col).cast("binary")], "id long, class string, size long, alone long, packed long, ok boolean", make)


def sealed(df: DataFrame, id_col: str, content_col: str, label: str) -> DataFrame:
    """Each content in an envelope, opened again: id, envelope, restored."""

    def make(key: int, data: bytes) -> list[tuple]:
        data = bytes(data)
        made = container.seal(data, label)
        return [(key, made, container.unseal(made) == data)]

    return _per_row(df, [F.col(id_col), F.col(content_col).cast("binary")], "id long, envelope binary, restored boolean", make)
