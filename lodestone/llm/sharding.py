"""Sharding by a hypergeometric communication matrix, in DataFrame functions only.

Rows fall into source blocks. For each block it is drawn how many of its rows
go to each shard: multivariate hypergeometric draws without replacement from
the shards' capacities, so that each shard gets exactly its size. A block's
rows are permuted and dealt by those counts; after the exchange, each shard's
rows are permuted again. Every placement of rows is then equally likely.

All draws come from digests of the row and a seed: a task that is run again
does the same again. A row's digest covers all columns that the caller names;
rows alike in all of them are interchangeable and share a block. Null columns,
null ids, empty and very long texts are values like any other; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import stored, unused

#: Source blocks (rows of the matrix) and buckets in which a shard's rows are permuted, at least; rows that each should hold; and as many of either at most.
BLOCKS, BUCKETS, BLOCK_ROWS, MOST_BLOCKS = 256, 64, 50_000, 4_096


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) from a digest."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _log_factorial(n: Column) -> Column:
    """Logarithm of n!: Stirling's series at n + 8, less the factors between."""
    x = n.cast("double") + F.lit(8.0)
    series = (x + 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    product = F.lit(1.0)
    for i in range(1, 9):
        product = product * (n.cast("double") + F.lit(float(i)))
    return series - F.log(product)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` may name it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(total: Column, good: Column, drawn: Column, unit: Column) -> Column:
    """How many of ``good`` among ``total`` are in a random draw of ``drawn``: inversion at ``unit``.

    The sum runs over the support, or where that is wide over 12 standard
    deviations around the mean, beyond which lies less than 1e-30.
    """
    n, k, m = (c.cast("double") for c in (total, good, drawn))
    mean = F.when(n > 0, m * k / n).otherwise(0.0)
    spread = F.when(n > 1, F.sqrt(mean * (1 - k / n) * (n - m) / (n - 1))).otherwise(0.0)

    def bounds(v: Column) -> Column:
        return F.struct(
            F.greatest(F.lit(0).cast("long"), drawn + good - total, F.floor(v["mean"] - 12 * v["spread"] - 12)).alias("low"),
            F.least(good, drawn, F.ceil(v["mean"] + 12 * v["spread"] + 12)).alias("high"),
            unit.alias("unit"),
        )

    def summed(b: Column) -> Column:
        low, high = b["low"], b["high"]
        logs = _log_choose(good, low) + _log_choose(total - good, drawn - low) - _log_choose(total, drawn)

        def step(s: Column, i: Column) -> Column:
            x = i.cast("double")
            more = s["p"] * (k - x + 1) * (m - x + 1) / (x * (n - k - m + x))
            return F.when(
                s["sum"] <= b["unit"],
                let(more, lambda p: F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), i.alias("x"))),
            ).otherwise(s)

        first = let(F.exp(logs), lambda p: F.struct(p.alias("p"), p.alias("sum"), low.alias("x")))
        return F.when(low < high, F.aggregate(F.sequence(low + 1, high), first, step, lambda s: s["x"])).otherwise(low)

    return let(let(F.struct(mean.alias("mean"), spread.alias("spread")), bounds), summed)


def communication_matrix(counts: DataFrame, shards: int, seed: int, draw: Callable = hypergeometric) -> DataFrame:
    """(block, upto): upto[s] is how many of the block's rows go to shards 0 to s.

    ``counts`` has one row (block, n) for each of a fixed number of blocks, so
    the one row in which they are gathered has a fixed size.
    """
    one = counts.agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("blocks"))
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    capacity = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(total / shards) + F.when(s < total % shards, 1).otherwise(0))

    def one_block(state: Column, b: Column) -> Column:
        left = F.aggregate(state["capacity"], F.lit(0).cast("long"), lambda a, c: a + c)

        def one_shard(s: Column, i: Column) -> Column:
            def drawn(good: Column) -> Column:
                return let(
                    draw(s["total"], good, s["need"], _unit(F.lit(seed), b["block"], i)),
                    lambda x: F.struct(
                        (s["total"] - good).alias("total"),
                        (s["need"] - x).alias("need"),
                        F.concat(s["row"], F.array(x)).alias("row"),
                    ),
                )

            return let(F.get(state["capacity"], i), drawn)

        first = F.struct(left.alias("total"), b["n"].alias("need"), F.array().cast("array<long>").alias("row"))
        row = F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), first, one_shard, lambda s: s["row"])
        made = F.named_struct(F.lit("block"), b["block"], F.lit("row"), row)
        return let(
            made,
            lambda m: F.struct(
                F.zip_with(state["capacity"], m["row"], lambda c, x: c - x).alias("capacity"),
                F.concat(state["out"], F.array(m)).alias("out"),
            ),
        )

    none = F.array().cast("array<struct<block:int,row:array<bigint>>>")
    rows = F.aggregate("blocks", F.struct(capacity.alias("capacity"), none.alias("out")), one_block, lambda s: s["out"])
    upto = F.transform("m.row", lambda _, i: F.aggregate(F.slice("m.row", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    return one.select(F.explode(rows).alias("m")).select("m.block", upto.alias("upto"))


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 0, key_cols: list[str] | None = None) -> DataFrame:
    """``df`` with ``shard`` (sizes at most one apart) and ``slot`` (gapless from 0 in each shard).

    ``key_cols`` (all columns by default) feed the digests; they should tell
    rows apart. Columns of ``df`` named shard or slot are replaced; any other
    names are kept as they are.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    keys = [F.col(f"`{c}`") for c in (key_cols or df.columns)]
    block, first, second, place_, upto, bucket, nth_, before_ = unused(df, 8)
    # blocks and buckets of a size that one task holds, but no more than the matrix has room for
    n = df.count()
    blocks = min(MOST_BLOCKS, max(BLOCKS, math.ceil(n / BLOCK_ROWS)))
    buckets = min(MOST_BLOCKS, max(BUCKETS, math.ceil(n / shards / BLOCK_ROWS)))
    rows = df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), *keys), F.lit(blocks)).cast("int").alias(block),
        F.xxhash64(F.lit(seed), F.lit("first"), *keys).alias(first),
        F.xxhash64(F.lit(seed), F.lit("second"), *keys).alias(second),
    )
    counts = rows.groupBy(F.col(block).alias("block")).agg(F.count("*").alias("n"))
    # of a bounded size: MOST_BLOCKS rows of ``shards`` numbers
    matrix = F.broadcast(stored(communication_matrix(counts, shards, seed)).toDF(block, upto))
    place = F.row_number().over(W.partitionBy(block).orderBy(first, second))
    dealt = (
        rows.withColumn(place_, place)
        .join(matrix, block)
        .withColumn("shard", F.size(F.filter(upto, lambda u: u < F.col(place_))))
        .withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), second), F.lit(buckets)).cast("int"))
        .drop(block, first, place_, upto)
    )
    dealt = stored(dealt)
    sizes = dealt.groupBy("shard", bucket).agg(F.count("*").alias(nth_))
    before = F.coalesce(F.sum(nth_).over(W.partitionBy("shard").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # of a bounded size: ``shards`` times MOST_BLOCKS rows
    start = F.broadcast(sizes.select("shard", bucket, before.alias(before_)))
    nth = F.row_number().over(W.partitionBy("shard", bucket).orderBy(second))
    placed = dealt.withColumn(nth_, nth).join(start, ["shard", bucket]).withColumn("slot", F.col(before_) + F.col(nth_) - 1)
    return placed.select(*[F.col(f"`{c}`") for c in kept], "shard", "slot")
