"""Choosing a transform for a block: features, rules, models, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codecs, transforms
from ..functions.content import entropy, match_rate

FEATURES = ["h0", "h1", "nd", "fz", "fp", "fmax", "run", "hd1", "hd2", "hd4", "hd8", "hp4", "hp8", "ac2", "ac4", "ac8", "cr2", "cr4", "cr8", "pr", "lenfrac"]
#: Candidates of a block: no transform, deltas, planes, both; each packed by zstd-3.
CANDIDATES = ["", "delta:1", "delta:2", "delta:4", "delta:8", "byte_split:4", "byte_split:8", "delta:4>byte_split:4", "delta:8>byte_split:8"]


def sampled(block: bytes, size: int, pieces: int = 1) -> np.ndarray:
    """The first bytes, or equal pieces spread over the block, each starting at a multiple of 8."""
    a = np.frombuffer(block, np.uint8)
    if pieces == 1 or len(a) <= size:
        return a[:size]
    q = size // pieces
    return np.concatenate([a[(s := (len(a) - q) * i // (pieces - 1) // 8 * 8) : s + q] for i in range(pieces)])


def features(block: bytes, granularity: int, size: int = 4096, pieces: int = 4) -> list[float]:
    a = sampled(block, size, pieces)
    n = len(a)
    if n < 16:
        return [0.0] * (len(FEATURES) - 1) + [len(block) / granularity]
    counts = np.bincount(a, minlength=256)
    before = a[:-1] >> 3
    joint = np.bincount(before.astype(np.int64) * 256 + a[1:], minlength=32 * 256).reshape(32, 256).astype(float)
    rows = joint.sum(1, keepdims=True)
    share = np.divide(joint, rows, out=np.zeros_like(joint), where=rows > 0)
    h1 = float(-(joint * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum() / (n - 1))
    deltas = [entropy(np.frombuffer(transforms.delta(a.tobytes(), w), np.uint8)) for w in (1, 2, 4, 8)]
    planes = [float(np.mean([entropy(a[i : n // w * w : w]) for i in range(w)])) for w in (4, 8)]
    x = a - a.mean()
    power = float((x * x).sum())
    relation = [float((x[w:] * x[:-w]).sum() / power) if power else 1.0 for w in (2, 4, 8)]
    printable = counts[[9, 10, 13, *range(32, 127)]].sum() / n
    runs = 1 + np.count_nonzero(a[1:] != a[:-1])
    packed = len(codecs.encode(a[:4096].tobytes(), "zstd", 1)) / min(n, 4096)
    return [entropy(a), h1, np.count_nonzero(counts) / 256, counts[0] / n, printable, counts.max() / n, float(np.log2(n / runs)), *deltas, *planes, *(match_rate(a, w) for w in (2, 4, 8)), *relation, packed, len(block) / granularity]


def labelled(blocks: DataFrame, granularity: int) -> DataFrame:
    """(id, block, chunk) with features, the size by each candidate, and the smallest's number.

    Blocks are dealt over all cores, however few contents or files they come
    from; their places and order are the same in every run.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, block, chunk in zip(frame["id"], frame["block"], frame["chunk"]):
                data = bytes(chunk)
                sizes = []
                for c in CANDIDATES:
                    steps = [(t.split(":")[0], int(t.split(":")[1])) for t in c.split(">")] if c else []
                    sizes.append(min(len(data), len(codecs.encode(transforms.apply(data, steps)[0], "zstd", 3))))
                out.append((key, block, len(data), [float(f) for f in features(data, granularity)], sizes, int(np.argmin(sizes))))
            yield pd.DataFrame(out, columns=["id", "block", "size", "features", "sizes", "best"])

    spark = blocks.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.select("id", "block", "chunk").repartition(parts, "id", "block").sortWithinPartitions("id", "block", "chunk")
    return dealt.mapInPandas(run, "id long, block int, size long, features array<double>, sizes array<long>, best int")


def tolerant(rows: DataFrame, within: float = 0.005) -> DataFrame:
    """Whether each candidate is as good as the best within so much, and what a wrong one costs at most."""
    low = F.array_min("sizes")
    return rows.withColumn("fine", F.transform("sizes", lambda s: s <= low * (1 + within))).withColumn("weight", (F.array_max("sizes") - low) / F.greatest(low, F.lit(1)))


def manual_rule(f: Column) -> Column:
    """The candidate whose entropy drop is largest, if it is half a bit; none for what looks random."""
    at = {n: F.get(f, F.lit(i)) for i, n in enumerate(FEATURES)}
    drops = [("hd1", 1), ("hd2", 2), ("hd4", 3), ("hd8", 4), ("hp4", 5), ("hp8", 6)]
    best = F.array_max(F.array(*[F.struct((at["h0"] - at[n]).alias("drop"), F.lit(-i).alias("i")) for n, i in drops]))
    return F.when(at["h0"] > 7.9, 0).when(best["drop"] >= 0.5, -best["i"]).otherwise(0)


def probe_rule(f: Column) -> Column:
    """Whether a block should be stored: the probe leaves over 98 %."""
    return F.get(f, F.lit(FEATURES.index("pr"))) > 0.98


def cross_validated(rows: DataFrame, group: Column, folds: int = 3, model: str = "tree") -> DataFrame:
    """Predictions for each block by a model that saw none of its group's fold.

    The rows are kept once made: every fold's fit and predictions read them again.
    """
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds))).withColumn("vector", array_to_vector("features")).withColumn("y", F.col("best").cast("double"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    out = None
    for k in range(folds):
        known = rows.where(F.col("fold") != k)
        learner = DecisionTreeClassifier(featuresCol="vector", labelCol="y", weightCol="weight", maxDepth=6, minInstancesPerNode=10, maxBins=24) if model == "tree" else LogisticRegression(featuresCol="vector", labelCol="y", weightCol="weight", regParam=0.01, maxIter=50)
        found = learner.fit(known).transform(rows.where(F.col("fold") == k)).withColumn("predicted", F.col("prediction").cast("int"))
        out = found if out is None else out.unionByName(found)
    return out.drop("vector", "y", "rawPrediction", "probability", "prediction", "fold")


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, class_col: str, truth: str, predicted: str, sizes: str, within: float = 0.005) -> DataFrame:
    """Share of blocks with the best candidate, and with one that is as good within so much; by class and overall."""
    chosen = F.get(F.col(sizes), F.col(predicted))
    marked = rows.withColumns({"_hit": (F.col(truth) == F.col(predicted)).cast("int"), "_fine": (chosen <= F.array_min(sizes) * (1 + within)).cast("int")})
    return marked.rollup(class_col).agg(F.count("*").alias("blocks"), F.round(F.avg("_hit"), 6).alias("strict"), F.round(F.avg("_fine"), 6).alias("tolerant"))


def regret(rows: DataFrame, keys: list[str], chosen: Column, sizes: str) -> DataFrame:
    """How much larger the chosen candidates come out than the best ones, and how much smaller than none."""
    return rows.groupBy(*keys).agg(F.sum(chosen).alias("bytes"), F.sum(F.array_min(sizes)).alias("best"), F.sum(F.get(F.col(sizes), F.lit(0))).alias("plain")).select(
        *keys, "bytes", "best", F.round((F.col("bytes") - F.col("best")) / F.col("best"), 6).alias("regret"), F.round(1 - F.col("bytes") / F.col("plain"), 6).alias("gain")
    )


def oracle_distribution(rows: DataFrame, class_col: str, truth: str) -> DataFrame:
    return rows.groupBy(class_col, truth).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(class_col)), 6))


def stop_rule(evaluated: DataFrame, most_regret: float = 0.01, least_gain: float = 0.01, most_cost: float = 0.02) -> DataFrame:
    """Whether a model is good enough: little regret, real gain, little cost. ``evaluated``: regret, gain, cost."""
    return evaluated.withColumn("enough", (F.col("regret") <= most_regret) & (F.col("gain") >= least_gain) & (F.col("cost") <= most_cost))
