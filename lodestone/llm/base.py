"""Shared pieces: intermediate tables, byte-level word scanning, 64-bit hashing and counting."""

from __future__ import annotations

import contextlib
import ctypes
import logging
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy step works on; longer texts are taken alone.
STEP_BYTES = 1 << 18
#: Bytes of rows that a Python worker gets at once, at most (one row at least).
BATCH_BYTES = 4 << 20
#: Bytecodes of a method that Spark makes for several operators at once, at most; beyond, each operator has its own.
METHOD_BYTES = 1000
_BATCH, _CLEANUP = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_METHOD = "spark.sql.codegen.hugeMethodLimit"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is unset, a local session gets a folder of this machine;
    on a cluster that is an error, as executors would not see it.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lodestone-")
        logging.getLogger(__name__).warning("spark.checkpoint.dir is unset; intermediate tables go to %s", path)
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers BATCH_BYTES at once, at most: texts differ in length, so a count of rows bounds nothing."""
    now = spark.conf.get(_BATCH).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


@contextlib.contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark makes no method longer than METHOD_BYTES for a whole stage: what the JIT compiler holds outside the heap goes with a method's length."""
    before = spark.conf.get(_METHOD)
    spark.conf.set(_METHOD, str(min(int(before), METHOD_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(_METHOD, before)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage with files that survive a lost executor, and gives
    the planner true sizes. The shuffle files of the write go with its end.
    Zstandard closes its buffers by itself; Snappy leaves them, outside the heap,
    to a collection that may come late.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` made. Nothing that is still to be computed may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id as long and the text with null as empty; other columns go."""
    in_small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can; workers live longer than tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unused(df: DataFrame, n: int) -> list[str]:
    """Names that none of the columns of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return [name for i in range(n + len(taken)) if (name := f"_c{i}") not in taken][:n]


# --- text as bytes -----------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _BYTE[_LOWER]
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least ``n`` of them."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, STEP_BYTES), base, U64)
        got[0] = 1
        got = np.cumprod(got, dtype=U64)
        if n <= 4 * STEP_BYTES:
            _powers[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Words (runs of non-space bytes) of consecutive texts.

    ``start``/``end`` are byte places in ``data``, ``first[i]:first[i+1]`` are
    the words of text ``i``; ``hash`` identifies a word, lower-casing A-Z when
    ``fold`` is set.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(data):
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            full = offsets[1:] > offsets[:-1]
            before[offsets[:-1][full]] = False
            after[offsets[1:][full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.fold = fold

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        n = len(self.data)
        total = np.zeros(n + 1, U64)
        np.cumsum((_FOLDED if self.fold else _BYTE)[self.data] * power(_BASE, n)[:n], out=total[1:])
        raw = (total[self.end] - total[self.start]) * power(_INVERSE, n)[self.start]
        return mix(raw + (self.end - self.start).astype(U64) * U64(_BASE))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of the whole sequence where it is shorter."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    last = len(hashes) - n + 1
    out = hashes[:last] + U64(n)
    for i in range(1, n):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[i : last + i]
    return mix(out)


def steps(texts: pa.Array, most: int = STEP_BYTES):
    """(first row, row after the last, bytes, offsets) over a string column, some ``most`` bytes at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b, whole[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        a = b


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


class Repeated:
    """Finds digests that come three times or more in a run of many, in room of a fixed size."""

    def __init__(self, room: int):
        self.room, self.size = np.empty(room, U64), 0

    def add(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes distinct values up; yields (digests, counts) of each run that they fill."""
        while len(values):
            n = min(len(values), len(self.room) - self.size)
            self.room[self.size : self.size + n] = values[:n]
            self.size += n
            values = values[n:]
            if self.size == len(self.room):
                yield self.take()

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(digests, counts) of the run so far, which ends."""
        own = self.room[: self.size]
        own.sort()
        self.size = 0
        third = np.flatnonzero(own[2:] == own[:-2])
        keys = np.unique(own[third])
        return keys, np.searchsorted(own, keys, "right") - np.searchsorted(own, keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
