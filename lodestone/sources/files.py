"""File sources: inventory without contents, contents, vault layout, generators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the largest content that Spark's file source takes.
MOST_CONTENT = (1 << 31) - 16


def inventory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, name, size and time of all files; contents aren't read, as the column is pruned."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "modificationTime")


def contents(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, length, content and skipped (why a content is null) of all files.

    Contents over ``most`` bytes aren't read, but their rows stay and say so. A
    row holds 2 GiB at most, so that is the limit where none is given.
    """
    most = min(most if most is not None else MOST_CONTENT, MOST_CONTENT)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = rows.where(F.col("length") <= most).select("path", "length", "content", F.lit(None).cast("string").alias("skipped"))
    return small.unionByName(rows.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("skipped")))


def windows(content: Column, size: int = 16 * 1024, large: int = 1 << 20) -> Column:
    """Start of a content, and where it is large its middle and end as well."""
    n = F.octet_length(content)
    middle = F.substring(content, F.floor((n - size) / 2).cast("int") + 1, F.lit(size))
    return F.when(n > large, F.array(F.substring(content, 1, size), middle, F.substring(content, n - size + 1, F.lit(size)))).otherwise(F.array(F.substring(content, 1, size)))


def vault_path(digest: Column) -> Column:
    """Where an object lies: two levels of its digest's first bytes."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.concat(digest, F.lit(".bin")))


def unindexed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Objects found in the vault that the index doesn't know."""
    found = files.withColumn("object_hash", F.regexp_extract("name", "^([0-9a-f]{64})", 1)).where("object_hash != ''")
    return found.join(index, "object_hash", "left_anti")


def newest_dictionary(dictionaries: DataFrame) -> DataFrame:
    """The latest dictionary of each class whose content matches its name."""
    sound = dictionaries.where(F.substring(F.sha2("content", 256), 1, 16) == F.element_at(F.split("id", "[.]"), -1))
    return sound.groupBy("class").agg(F.max_by("id", F.struct("mtime", "id")).alias("id"))


_KINDS = ("logs", "csv", "ndjson", "f32", "i64", "random")


def _lines(text: str, size: int) -> bytes:
    """Whole lines of at most ``size`` characters together."""
    return text[: text.rfind("\n", 0, size) + 1].encode()


def _made(kind: str, seed: int, size: int) -> bytes:
    r = np.random.default_rng(seed)
    n = max(1, size // 8)
    if kind == "logs":
        users, status = r.zipf(1.3, n) % 1000, r.choice([200, 200, 200, 404, 500], n)
        return _lines("".join(f"2024-01-01T{i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z host{u % 7} GET /p/{u} {s}\n" for i, (u, s) in enumerate(zip(users, status))), size)
    if kind == "csv":
        q, p = r.integers(1, 13, n), r.integers(100, 10_000, n)
        return _lines("".join(f"{i},2024-01-{1 + i % 28:02d},{a},{b / 100:.2f}\n" for i, (a, b) in enumerate(zip(q, p))), size)
    if kind == "ndjson":
        return _lines("".join(f'{{"ts":{1_700_000_000 + i},"level":"info","user":{u}}}\n' for i, u in enumerate(r.integers(0, 500, n))), size)
    if kind == "f32":
        t = np.arange(size // 4)
        return (np.sin(t / 50) * 20 + r.normal(0, 0.1, len(t))).round(2).astype("<f4").tobytes()
    if kind == "i64":
        return (1_700_000_000_000 + np.cumsum(1 + r.exponential(40, size // 8).astype(int))).astype("<i8").tobytes()
    return r.bytes(size)


def synthetic(spark: SparkSession, count: int, size: int = 64 * 1024, seed: int = 0) -> DataFrame:
    """``count`` made-up objects of all kinds: id, kind, content. A row depends on its id and the seed alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kinds = [_KINDS[i % len(_KINDS)] for i in frame["id"]]
            yield pd.DataFrame({"id": frame["id"], "kind": kinds, "content": [_made(k, seed * 1_000_003 + int(i), size) for i, k in zip(frame["id"], kinds)]})

    return spark.range(count).mapInPandas(run, "id long, kind string, content binary")
