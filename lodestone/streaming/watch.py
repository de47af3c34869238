"""Watching a directory: what is new, changed, touched or gone, against a table of what was seen.

A file source remembers paths, so it never sees a file that is rewritten in
place. Each round therefore lists the directory anew and compares size and
time with the seen table; contents are only read where those differ, and those
of files that still grow are left for a later round.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEEN = "path string, size long, mtime timestamp, object_hash string"


def allowed(name: Column) -> Column:
    """Not hidden, no backup, no half-written file."""
    return ~name.rlike(r"^[.~]") & ~name.rlike(r"(?i)\.(tmp|part|partial|crdownload|swp)$")


def compare(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Each present file's state against the seen table: new, same, or candidate (size or time differ)."""
    before = seen.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("object_hash").alias("_hash"))
    state = F.when(F.col("_hash").isNull(), "new").when(F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime")), "same").otherwise("candidate")
    return listing.join(before, "path", "left").withColumn("state", state).drop("_size", "_mtime")


def run_round(spark: SparkSession, directory: str, seen: DataFrame, steady: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One round: (events, new seen table). Events are new, changed and gone; a file only touched is none.

    The listing reads no contents; those of files that differ are read one by
    one, as streams, so a file of any size is taken. ``steady`` (path, size), as
    of ``stable``, holds back files that are still being written: they stay as
    they were seen.
    """
    files = spark.read.format("binaryFile").load(directory).withColumnsRenamed({"length": "size", "modificationTime": "mtime"})
    listing = files.select("path", "size", "mtime").where(allowed(F.element_at(F.split("path", "/"), -1)))
    state = compare(listing, seen)
    if steady is not None:
        state = state.join(steady.select("path", "size", F.lit(True).alias("_steady")), ["path", "size"], "left")
        state = state.withColumn("state", F.when((F.col("state") != "same") & F.col("_steady").isNull(), "waits").otherwise(F.col("state"))).drop("_steady")
    wanted = state.where("state IN ('new', 'candidate')").select("path", "size", "mtime", "_hash", "state")
    read = with_digest(wanted)
    gone = seen.join(listing.select("path"), "path", "left_anti")
    events = read.where("state = 'new' OR object_hash != _hash").select("path", "object_hash", F.when(F.col("state") == "new", "new").otherwise("changed").alias("event"))
    events = events.unionByName(gone.select("path", "object_hash", F.lit("gone").alias("event")))
    kept = state.where("state = 'same'").select("path", "size", "mtime", F.col("_hash").alias("object_hash"))
    waiting = seen.join(state.where("state = 'waits'").select("path"), "path", "left_semi")
    return events, kept.unionByName(read.select("path", "size", "mtime", "object_hash")).unionByName(waiting.select("path", "size", "mtime", "object_hash"))


def with_digest(paths: DataFrame) -> DataFrame:
    """``paths`` with the SHA-256 of each file's content as ``object_hash``, read piece by piece through Arrow's file systems."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(object_hash=[_digest(p) for p in frame["path"]])

    return paths.mapInPandas(run, paths.schema.simpleString()[7:-1].replace(":", " ") + ", object_hash string")


def _digest(path: str, piece: int = 1 << 20) -> str:
    if path.startswith("file:") or "://" not in path:
        system, inner = pa_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, inner = pa_fs.FileSystem.from_uri(quote(path, safe="/:"))
    digest = hashlib.sha256()
    with system.open_input_stream(inner) as f:
        while block := f.read(piece):
            digest.update(block)
    return digest.hexdigest()


def empty_seen(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SEEN)


def watch(spark: SparkSession, directory: str, state_dir: str, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 2, rounds: int | None = None):
    """A streaming query whose every trigger runs one round.

    The seen table of round n lies in ``state_dir``/n; a round that is run again
    after a failure reads table n - 1 and gives the same events.
    """

    def one(_: DataFrame, epoch: int) -> None:
        before = f"{state_dir}/{epoch - 1}"
        seen = spark.read.schema(SEEN).parquet(before) if epoch else empty_seen(spark)
        events, after = run_round(spark, directory, seen)
        after.write.mode("overwrite").parquet(f"{state_dir}/{epoch}")
        sink(events, epoch)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    query = ticks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
    if rounds is not None:
        while query.isActive and ((query.lastProgress or {}).get("batchId", -1)) < rounds - 1:
            query.awaitTermination(1)
        query.stop()
    return query


def stable(samples: DataFrame, need: int = 3, order: str = "taken_ms") -> DataFrame:
    """Files whose last ``need`` sampled sizes are equal. ``samples``: path, size, taken_ms."""
    last = samples.groupBy("path").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(order, "size")))), 1, need).alias("s"))
    sizes = F.array_distinct(F.transform("s", lambda x: x["size"]))
    return last.where((F.size("s") == need) & (F.size(sizes) == 1)).select("path", F.get(sizes, F.lit(0)).alias("size"))


def running_totals(events: DataFrame) -> DataFrame:
    """Ledger totals of a stream of events, for update mode."""
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event-time windows with a watermark; an extension that the inventory of operators doesn't ask for."""
    return events.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late).groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("events"))


def local_listing(spark: SparkSession, directory: str) -> DataFrame:
    """path, size and time in nanoseconds of a local directory; links aren't followed. For tests and single machines."""
    rows = []
    for e in os.scandir(directory):
        if e.is_file(follow_symlinks=False):
            s = e.stat(follow_symlinks=False)
            rows.append((e.path, s.st_size, s.st_mtime_ns))
    return spark.createDataFrame(rows, T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime_ns", T.LongType())]))
