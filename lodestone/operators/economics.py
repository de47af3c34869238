"""Economics of storage policies: value, optimum, margins, recompression, client model.

All work on small tables of measurements: class, mode, config, saved (share of
bytes saved), comp and decomp (MB/s of one core). Prices are in dollars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Published measurements, as ratio and MB/s of compression and decompression.
MEASURED: list[tuple[str, str, str, float, float, float]] = [
    ("mix_real", "whole", "stored", 1.00, 12706, 11526), ("mix_real", "whole", "zlib-6", 2.55, 38, 410), ("mix_real", "whole", "zstd-1", 2.36, 609, 1634),
    ("mix_real", "whole", "zstd-3", 2.60, 372, 1439), ("mix_real", "whole", "zstd-9", 2.85, 91, 1493), ("mix_real", "whole", "zstd-19", 3.09, 4, 1161),
    ("mix_real", "whole", "xz-9e", 3.31, 3, 137), ("mix_real", "whole", "bzip2-9", 3.20, 22, 51),
    ("mix_real", "1MiB", "stored", 1.00, 13781, 11811), ("mix_real", "1MiB", "zlib-6", 2.54, 39, 407), ("mix_real", "1MiB", "zstd-1", 2.35, 596, 1707),
    ("mix_real", "1MiB", "zstd-3", 2.57, 378, 1611), ("mix_real", "1MiB", "zstd-9", 2.75, 98, 1736), ("mix_real", "1MiB", "zstd-19", 2.95, 7, 1581),
    ("mix_real", "1MiB", "xz-9e", 3.16, 5, 135), ("mix_real", "1MiB", "bzip2-9", 3.17, 22, 51),
    ("texto", "whole", "stored", 1.00, 12829, 12249), ("texto", "whole", "zstd-1", 2.86, 461, 1640), ("texto", "whole", "zstd-3", 3.24, 323, 1325),
    ("texto", "whole", "zstd-9", 3.71, 74, 1585), ("texto", "whole", "zstd-19", 4.32, 4, 1234), ("texto", "whole", "xz-9e", 4.37, 3, 204), ("texto", "whole", "bzip2-9", 4.51, 22, 53),
    ("texto", "1MiB", "stored", 1.00, 14400, 11546), ("texto", "1MiB", "zstd-1", 2.84, 451, 1711), ("texto", "1MiB", "zstd-3", 3.18, 325, 1632),
    ("texto", "1MiB", "zstd-9", 3.55, 79, 1777), ("texto", "1MiB", "zstd-19", 3.93, 6, 1740), ("texto", "1MiB", "xz-9e", 3.99, 5, 193), ("texto", "1MiB", "bzip2-9", 4.42, 22, 54),
]
CORE_HOUR = {"cloud": 0.0446, "onprem": 0.0135}
GB_MONTH = {"s3_standard": 0.023, "b2": 0.00695, "glacier_ir": 0.004, "onprem": 0.002}
READS = {"hot": 10.0, "warm": 1.0, "cold": 0.1}
MONTHS, REDUNDANCY, MONTHLY_GB, PEAK, CORES = 60.0, 1.0, 5e6, 4.0, 64
#: MB/s of one core for an hour, in GB.
GB_HOUR = 3.6
#: MB/s of 5 PB in a month of 30 days.
FLOW = 5e15 / (30 * 86400) / 1e6
#: Measured efficiency of N cores (compression).
EFFICIENCY = [(1, 1.0), (8, 0.95), (16, 0.64), (32, 0.42)]


def measurements(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(*m[:3], *map(float, m[3:])) for m in MEASURED], "class string, mode string, config string, ratio double, comp double, decomp double")
    return rows.withColumn("saved", 1 - 1 / F.col("ratio"))


def _table(spark: SparkSession, values: dict[str, float], key: str, value: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(values.items()), f"{key} string, {value} double"))


def scenarios(spark: SparkSession) -> DataFrame:
    """CPU by storage by read tier."""
    return _table(spark, CORE_HOUR, "cpu", "core_hour").crossJoin(_table(spark, GB_MONTH, "storage", "gb_month")).crossJoin(_table(spark, READS, "tier", "reads"))


def efficiency(cores: Column, points: list[tuple[int, float]] = EFFICIENCY) -> Column:
    """Piecewise linear in the number of cores, constant outside the points."""
    out = F.lit(points[-1][1])
    for (n0, e0), (n1, e1) in reversed(list(zip(points, points[1:]))):
        out = F.when(cores <= n1, F.lit(e0) + F.lit(e1 - e0) * (cores - n0) / F.lit(float(n1 - n0))).otherwise(out)
    return F.when(cores <= points[0][0], F.lit(points[0][1])).otherwise(out)


def cores_needed(flow: Column, speed: Column, points: list[tuple[int, float]] = EFFICIENCY, rounds: int = 200) -> Column:
    """Cores that carry a flow, where each core's share falls with their number: fixed point of n = flow / (speed e(n))."""
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        F.struct((flow / speed).alias("n"), F.lit(False).alias("done")),
        lambda s, _: F.when(s["done"], s).otherwise(
            F.struct((flow / (speed * efficiency(s["n"], points))).alias("n"), (F.abs(flow / (speed * efficiency(s["n"], points)) - s["n"]) < 1e-9).alias("done"))
        ),
    )
    return state["n"]


def cost_gb(core_hour: Column, speed: Column, share: float = 1.0) -> Column:
    return core_hour / (speed * F.lit(share * GB_HOUR))


def net_values(rows: DataFrame) -> DataFrame:
    """Net value of storing a GB by each config, in each scenario."""
    grid = rows.crossJoin(scenarios(rows.sparkSession))
    stored = F.col("config") == "stored"
    grid = grid.withColumn("value", F.greatest(F.col("saved"), F.lit(0.0)) * F.col("gb_month") * MONTHS * REDUNDANCY)
    grid = grid.withColumn("comp_cost", F.when(stored, 0.0).otherwise(cost_gb(F.col("core_hour"), F.col("comp"))))
    grid = grid.withColumn("read_cost", F.when(stored | (F.col("saved") <= 0), 0.0).otherwise(cost_gb(F.col("core_hour"), F.col("decomp"))))
    grid = grid.withColumn("net", F.col("value") - F.col("comp_cost") - F.col("reads") * F.col("read_cost"))
    return grid.withColumn("cores_at_peak", F.when(stored, 0.0).otherwise(FLOW * PEAK / F.col("comp")))


_CELL = ["class", "mode", "cpu", "storage", "tier"]


def optimum(net: DataFrame, most_cores: int | None = None) -> DataFrame:
    """The config of highest net value in each scenario; among those that fit so many cores at the peak."""
    rows = net.where(F.ceil(F.col("cores_at_peak") - 1e-9) <= most_cores) if most_cores else net
    best = F.row_number().over(W.partitionBy(*_CELL).orderBy(F.desc("net"), "config"))
    return rows.withColumn("_nth", best).where("_nth = 1").select(*_CELL, "config", "net", "cores_at_peak")


def pareto(rows: DataFrame, speed: str = "comp") -> DataFrame:
    """Configs that no other of their class and mode beats in saving or speed without losing in the other."""
    other = rows.select("class", "mode", *[F.col(c).alias(f"o_{c}") for c in ("saved", speed)])
    worse = (F.col("o_saved") >= F.col("saved")) & (F.col(f"o_{speed}") >= F.col(speed)) & ((F.col("o_saved") > F.col("saved")) | (F.col(f"o_{speed}") > F.col(speed)))
    left, right = rows.alias("l"), other.alias("r")
    return left.join(right, (F.col("l.class") == F.col("r.class")) & (F.col("l.mode") == F.col("r.mode")) & worse, "left_anti")


def marginal_steps(net: DataFrame) -> DataFrame:
    """From each config to the next by saving: what the step gains in storage and costs in CPU."""
    w = W.partitionBy(*_CELL).orderBy(F.greatest("saved", F.lit(0.0)), F.desc("comp"), "config")
    cost = F.col("comp_cost") + F.col("reads") * F.col("read_cost")
    rows = net.withColumn("cost", cost).withColumns({"from": F.lag("config").over(w), "value0": F.lag("value").over(w), "cost0": F.lag("cost").over(w)}).where("`from` IS NOT NULL")
    gain, more = F.col("value") - F.col("value0"), F.col("cost") - F.col("cost0")
    return rows.select(*_CELL, "from", F.col("config").alias("to"), gain.alias("gain"), more.alias("cost"), (gain - more).alias("net_gain"), (gain - more > 0).alias("worth"))


def recompression(rows: DataFrame, origins: list[str], targets: list[str], left_months: float = 24.0, share: float = EFFICIENCY[-1][1]) -> DataFrame:
    """Months after which moving from one config to another has paid, and reads that the rest of the life allows."""
    one = rows.where(F.col("config").isin(origins)).select("class", "mode", F.col("config").alias("origin"), F.col("saved").alias("s0"), F.col("decomp").alias("d0"))
    two = rows.where(F.col("config").isin(targets)).select("class", "mode", F.col("config").alias("target"), F.col("saved").alias("s1"), F.col("decomp").alias("d1"), F.col("comp").alias("c1"))
    grid = one.join(two, ["class", "mode"]).where("origin != target").crossJoin(scenarios(rows.sparkSession))
    zero = F.lit(0.0)
    grid = grid.withColumns({
        "saving": F.greatest("s1", zero) - F.greatest("s0", zero),
        "repack": cost_gb(F.col("core_hour"), F.col("d0"), share) + cost_gb(F.col("core_hour"), F.col("c1"), share),
        "read_change": cost_gb(F.col("core_hour"), F.col("d1"), share) - cost_gb(F.col("core_hour"), F.col("d0"), share),
    })
    grid = grid.withColumn("gain_month", F.col("saving") * F.col("gb_month") * REDUNDANCY)
    rest = F.col("gain_month") - F.col("reads") / MONTHS * F.col("read_change")
    gross = F.col("gain_month") * left_months - F.col("repack")
    pays = (rest > 0) & (F.col("saving") > 0)
    most = F.when(F.col("saving") <= 0, F.lit(None)).when(gross <= 0, 0.0).when(F.col("read_change") <= 0, F.lit(float("inf"))).otherwise(gross / F.col("read_change"))
    return grid.select(
        "class", "mode", "origin", "target", "cpu", "storage", "tier", "saving", "repack", "gain_month",
        F.when(pays, F.col("repack") / rest).alias("months"), pays.alias("pays"), most.alias("most_reads"),
    )


def block_penalty(rows: DataFrame) -> DataFrame:
    """How much larger blocks come out than whole files, for the same config."""
    whole = rows.where("mode = 'whole'").select("class", "config", F.col("ratio").alias("whole_ratio"))
    found = rows.where("mode != 'whole' AND config != 'stored'").join(whole, ["class", "config"])
    return found.select("class", "mode", "config", "ratio", "whole_ratio", ((F.col("whole_ratio") / F.col("ratio") - 1) * 100).alias("larger_pct"))


def dictionary_gain(rows: DataFrame) -> DataFrame:
    """With against without a dictionary: ``rows`` has class, config, with_dictionary, original, compressed."""
    each = rows.groupBy("class", "config").agg(
        *[F.sum(F.when(F.col("with_dictionary") == w, F.col(c))).alias(f"{c}_{n}") for w, n in ((False, "without"), (True, "with")) for c in ("original", "compressed")]
    )
    return each.select("class", "config", ((F.col("compressed_without") / F.col("compressed_with") - 1) * 100).alias("ratio_gain_pct"), ((1 - F.col("compressed_with") / F.col("compressed_without")) * 100).alias("smaller_pct"))


def throughput(files: DataFrame) -> DataFrame:
    """Per class, and over all real files: ratio of sums. ``files``: class, config, synthetic, original, compressed, comp_s, decomp_s."""
    real = files.where("NOT synthetic").withColumn("class", F.lit("mix_real"))
    rows = files.unionByName(real).groupBy("class", "config").agg(*[F.sum(c).alias(c) for c in ("original", "compressed", "comp_s", "decomp_s")], F.count("*").alias("files"))
    return rows.select(
        "class", "config", "files", (F.col("original") / F.col("compressed")).alias("ratio"), (1 - F.col("compressed") / F.col("original")).alias("saved"),
        (F.col("original") / 1e6 / F.col("comp_s")).alias("comp"), (F.col("original") / 1e6 / F.col("decomp_s")).alias("decomp"),
    )


def client_model(rows: DataFrame, kept: list[float], moves: list[tuple[float, int]], reads: list[int], gb: float = MONTHLY_GB) -> DataFrame:
    """Storage and movement saved against CPU spent in a month, over scenarios of what is kept, moved and read."""
    spark = rows.sparkSession
    grid = rows.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in kept], "kept double")))
    grid = grid.crossJoin(F.broadcast(spark.createDataFrame(moves, "move_gb double, passes int"))).crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in reads], "reads int")))
    grid = grid.crossJoin(_table(spark, CORE_HOUR, "cpu", "core_hour")).crossJoin(_table(spark, GB_MONTH, "storage", "gb_month"))
    stored = F.col("config") == "stored"
    cpu = F.when(stored, 0.0).otherwise(gb * cost_gb(F.col("core_hour"), F.col("comp")) + gb * F.col("reads") * cost_gb(F.col("core_hour"), F.col("decomp")))
    grid = grid.withColumns({
        "storage_saved": F.col("saved") * F.col("kept") * gb * F.col("gb_month") * MONTHS,
        "movement_saved": F.col("saved") * gb * F.col("move_gb") * F.col("passes"),
        "cpu_spent": cpu,
    })
    keys = ["class", "mode", "config", "kept", "move_gb", "passes", "reads", "cpu", "storage"]
    return grid.select(*keys, "storage_saved", "movement_saved", "cpu_spent", (F.col("storage_saved") + F.col("movement_saved") - F.col("cpu_spent")).alias("net"))


def policy(rows: DataFrame, classes: DataFrame, *, storage: str = "s3_standard", cpu: str = "cloud", kept: float = 0.9, reads: float = 3.0, age: float = 3.0, sync: str = "zstd-3", later: tuple[str, ...] = ("zstd-19", "xz-9e")) -> DataFrame:
    """Each class: stored, compressed at once, or also recompressed later, whichever is worth most.

    ``classes``: class, share of the volume, dup (share that dedup takes). A
    class is compressed if that is worth more than nothing; recompressed to the
    target of highest net value among those that pay within the life left.
    """
    price, hour = GB_MONTH[storage], CORE_HOUR[cpu]
    one = rows.where(F.col("config") == sync).select("class", "mode", F.col("saved").alias("s"), F.col("comp").alias("c"), F.col("decomp").alias("d"))
    base = one.join(F.broadcast(classes), "class").withColumn("gb", F.lit(MONTHLY_GB) * F.col("share"))
    cpu_cost = F.col("gb") * (cost_gb(F.lit(hour), F.col("c")) + F.lit(reads) * cost_gb(F.lit(hour), F.col("d")))
    dedup = F.col("dup") * F.col("gb") * kept * price * MONTHS
    base = base.withColumn("stored_value", dedup).withColumn("sync_value", (1 - (1 - F.col("dup")) * (1 - F.col("s"))) * F.col("gb") * kept * price * MONTHS - cpu_cost)
    left = max(0.0, MONTHS - age)
    two = rows.where(F.col("config").isin(*later)).select("class", "mode", F.col("config").alias("target"), F.col("saved").alias("s1"), F.col("comp").alias("c1"), F.col("decomp").alias("d1"))
    grid = base.join(two, ["class", "mode"], "left")
    repack = (1 - F.col("dup")) * (cost_gb(F.lit(hour), F.col("d")) + cost_gb(F.lit(hour), F.col("c1")))
    rest = (F.col("s1") - F.col("s")) * (1 - F.col("dup")) * price - F.lit(reads / (kept * MONTHS)) * (cost_gb(F.lit(hour), F.col("d1")) - cost_gb(F.lit(hour), F.col("d")))
    pays = (rest > 0) & (F.col("s1") > F.col("s")) & (repack / rest < left) & (rest * left - repack > 0)
    grid = grid.withColumn("later_value", F.when(pays, rest * left - repack))
    chosen = grid.groupBy("class", "mode", "stored_value", "sync_value", "s").agg(F.max(F.when(F.col("later_value").isNotNull(), F.struct("later_value", "target"))).alias("best"))
    name = F.when((F.col("sync_value") <= F.col("stored_value")) | (F.col("s") <= 0), "stored").when(F.col("best").isNull(), sync).otherwise(F.concat(F.lit(sync + " then "), F.col("best.target")))
    return chosen.select("class", "mode", name.alias("policy"), "stored_value", "sync_value", F.col("best.later_value").alias("later_value"))


def onprem_price(capex: float = 15000, cores: int = 64, years: float = 3, use: float = 0.7, watts: float = 5, pue: float = 1.5, kwh: float = 0.10) -> float:
    """Dollars for an hour of a core of one's own."""
    return capex / cores / (years * 8760 * use) + watts / 1000 * pue * kwh


def break_even(scenario: DataFrame) -> DataFrame:
    """GB after which fixed costs are earned back; null where a GB earns nothing.

    ``scenario``: name, saving, gb_month, months, gpu_hour, enc_gb_hour, dec_gb_hour, reads, cpu_hour, base_gb_hour, training, research, model_gb.
    """
    margin = F.expr("saving * gb_month * months - (gpu_hour / enc_gb_hour - cpu_hour / base_gb_hour) - reads * gpu_hour / dec_gb_hour")
    rows = scenario.withColumn("margin", margin)
    return rows.select("name", "margin", F.when(F.col("margin") > 0, F.expr("(training + research + model_gb * gb_month * months) / margin")).alias("break_even_gb"))
