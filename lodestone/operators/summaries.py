"""Summaries of measurements: ratios, errors, timings, phases, defaults by class, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slow_ratio(rows: DataFrame, class_col: str, slow: str, fast: str, original: str) -> DataFrame:
    """Ratio of a slow codec, by class: what it leaves against a fast one where both ran, times what the fast one leaves of all."""
    both = F.col(slow).isNotNull()
    each = rows.groupBy(class_col).agg(F.sum(F.when(both, F.col(slow))).alias("s"), F.sum(F.when(both, F.col(fast))).alias("f"), F.sum(fast).alias("all"), F.sum(original).alias("o"), F.count_if(both).alias("sampled"))
    return each.select(class_col, "sampled", F.round(F.col("s") / F.col("f") * (F.col("all") / F.col("o")), 9).alias("ratio"))


def weighted_ratio(rows: DataFrame, bytes_col: str, ratio_col: str) -> DataFrame:
    """One ratio for a whole dataset: that of its classes, by bytes."""
    return rows.agg(F.round(F.sum(F.col(bytes_col) * F.col(ratio_col)) / F.sum(bytes_col), 9).alias("ratio"), F.sum(bytes_col).alias("bytes"))


def errors_by_file(rows: DataFrame, file_col: str, predicted: str, sizes: str) -> DataFrame:
    """Bytes that wrong choices cost, for each file, dearest first."""
    low, chosen = F.array_min(sizes), F.get(F.col(sizes), F.col(predicted))
    each = rows.groupBy(file_col).agg(F.count("*").alias("blocks"), F.sum(chosen - low).alias("extra"), F.sum(low).alias("best"))
    return each.select(file_col, "blocks", "extra", F.round(F.col("extra") / F.col("best"), 9).alias("regret")).orderBy(F.desc("extra"), file_col)


def timings(runs: DataFrame, keys: list[str], bytes_col: str, ms_col: str) -> DataFrame:
    """Median, least and most MB/s over repetitions."""
    rate = F.col(bytes_col) / 1e6 / (F.col(ms_col) / 1000)
    return runs.where(F.col(ms_col) > 0).groupBy(*keys).agg(F.count("*").alias("runs"), F.round(F.median(rate), 6).alias("median"), F.round(F.min(rate), 6).alias("least"), F.round(F.max(rate), 6).alias("most"))


def read_by_phase(reads: DataFrame, phase: str, read: str, total: int | Column) -> DataFrame:
    """Bytes that each phase read, and their share of all there are."""
    share = F.round(F.sum(read) / (F.lit(total) if isinstance(total, int) else total), 9)
    return reads.groupBy(phase).agg(F.count("*").alias("files"), F.sum(read).alias("bytes"), share.alias("share"))


def with_default(rows: DataFrame, table: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """``rows`` with the value that a small table has for their key, or a default."""
    return rows.join(F.broadcast(table.select(key, value)), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def class_info(classes: DataFrame, parts: dict[str, tuple[DataFrame, dict[str, float]]], key: str = "class") -> DataFrame:
    """Everything known of each class: columns of several tables, with defaults where a table doesn't name it."""
    out = classes.select(key)
    for table, defaults in parts.values():
        out = out.join(table.select(key, *defaults), key, "left").fillna(defaults)
    return out


def copies(groups: DataFrame, class_col: str = "class") -> DataFrame:
    """Per class: groups of equal files, mean and most copies. ``groups``: class, copies, redundant_bytes."""
    return groups.groupBy(class_col).agg(F.count("*").alias("groups"), F.round(F.avg("copies"), 6).alias("mean_copies"), F.max("copies").alias("most_copies"), F.sum("redundant_bytes").alias("redundant_bytes"))


def largest_groups(groups: DataFrame, top: int = 10) -> DataFrame:
    return groups.orderBy(F.desc("redundant_bytes"), "first").limit(top)


def whole_file_dedup(files: DataFrame, hash_col: str, size_col: str) -> DataFrame:
    """Files and bytes, how many of them differ, and the ratio of bytes."""
    each = files.groupBy(hash_col, size_col).agg(F.count("*").alias("n"))
    return each.agg(
        F.sum("n").alias("files"), F.count("*").alias("unique_files"), F.sum(F.col("n") * F.col(size_col)).alias("bytes"), F.sum(size_col).alias("unique_bytes"),
        F.round(F.sum(F.col("n") * F.col(size_col)) / F.sum(size_col), 6).alias("ratio"),
    )


def marginal_cost(new_chunks: DataFrame, category: str, packed: str) -> DataFrame:
    """Bytes that a new version adds, by what became of the file they lie in."""
    return new_chunks.groupBy(category).agg(F.count("*").alias("chunks"), F.sum(packed).alias("added"))


def dedup_gate(strategies: DataFrame, baseline: str, entry_bytes: int = 40, least: float = 0.05) -> DataFrame:
    """Whether a strategy beats the baseline by enough, its index counted. ``strategies``: set, strategy, stored, entries."""
    rows = strategies.withColumn("total", F.col("stored") + F.col("entries") * entry_bytes)
    base = rows.where(F.col("strategy") == baseline).select("set", F.col("total").alias("base"))
    gain = 1 - F.col("total") / F.col("base")
    return rows.where(F.col("strategy") != baseline).join(base, "set").select("set", "strategy", "total", F.round(gain, 9).alias("gain"), (gain >= least).alias("passes"))


def bootstrap_by_file(rows: DataFrame, group: str, file_col: str, numerator: str, denominator: str, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """Ratio of sums with a 95 % interval: as many files as there are are drawn again and again, each with all its rows.

    Files are summed first, so a group's task holds two numbers a file.
    """
    files = rows.groupBy(group, file_col).agg(F.sum(numerator).cast("double").alias("n"), F.sum(denominator).cast("double").alias("d"))

    def run(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        own = pd.concat(list(frames)).sort_values(file_col) if not isinstance(frames, pd.DataFrame) else frames.sort_values(file_col)
        n, d = own["n"].to_numpy(), own["d"].to_numpy()
        r = np.random.default_rng(seed)
        drawn = [(n[i].sum() / d[i].sum()) for i in (r.integers(0, len(n), len(n)) for _ in range(rounds)) if d[i].sum() > 0]
        low, high = np.quantile(drawn, [0.025, 0.975]) if drawn else (np.nan, np.nan)
        return pd.DataFrame([(own[group].iloc[0], len(n), n.sum() / d.sum() if d.sum() else np.nan, low, high)], columns=[group, "files", "ratio", "low", "high"])

    kind = rows.schema[group].dataType.simpleString()
    return files.groupBy(group).applyInPandas(run, f"{group} {kind}, files long, ratio double, low double, high double")
