"""Ledger and billing: totals, quotes, grants, idempotency, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import GIB

#: Price defaults (cents) and histogram bounds (milliseconds).
SHARE_PERCENT, REFERENCE_CENTS = 30, 12
EFFORT_CENTS = {"fast": 150, "balanced": 400, "max": 1600}
LATENCY_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0)


def percent_saved(saved: Column, total: Column) -> Column:
    return F.when(total > 0, saved / total * 100).otherwise(0.0)


def totals(ledger: DataFrame) -> DataFrame:
    """Per tenant: events, sums over all operations, and the compress operations and dedup hits among them."""
    return ledger.groupBy("tenant_id").agg(
        F.count("*").alias("events"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_saved").alias("bytes_saved"),
        F.sum("cpu_ms").alias("cpu_ms"), F.count_if(F.col("operation") == "compress").alias("compress_events"),
        F.count_if(F.col("dedup_scope") == "tenant").alias("tenant_dedup_hits"),
    )


def by_operation(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("operation").agg(
        F.count("*").alias("events"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_saved").alias("bytes_saved")
    ).orderBy("operation")


def by_effort(ledger: DataFrame) -> DataFrame:
    rows = ledger.where("operation = 'compress'").groupBy("effort")
    return rows.agg(F.count("*").alias("events"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_saved").alias("bytes_saved")).orderBy("effort")


def lifetime(ledger: DataFrame) -> DataFrame:
    """One row over all compress events; savings from what went in and out."""
    rows = ledger.where("operation = 'compress'").agg(F.count("*").alias("events"), F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_in"), F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_out"))
    return rows.withColumn("savings_pct", F.round(F.when(F.col("bytes_in") > 0, (1 - F.col("bytes_out") / F.col("bytes_in")) * 100).otherwise(0.0), 6))


def _line(tenant: str, bytes_: Column, unit: Column) -> list[Column]:
    quantity = bytes_ / F.lit(GIB)
    return [F.round(quantity, 4).alias("quantity"), F.round(unit, 4).alias("unit"), F.round(quantity * unit * 1e6).cast("long").alias("micro_cents")]


def quote_savings(ledger: DataFrame, share: int = SHARE_PERCENT, reference: int = REFERENCE_CENTS) -> DataFrame:
    """Savings plan: one line for each tenant, a share of the reference price of what was saved. Money is in whole micro-cents."""
    saved = ledger.where("operation = 'compress'").groupBy("tenant_id").agg(F.sum("bytes_saved").alias("saved"))
    rows = saved.select("tenant_id", *_line("tenant_id", F.col("saved"), F.lit(reference * share / 100.0)))
    return rows.withColumn("cents", F.round(F.col("micro_cents") / 1e6).cast("long"))


def quote_ingested(ledger: DataFrame, prices: dict[str, int] = EFFORT_CENTS) -> DataFrame:
    """Ingest plan: a line for each effort, summed for each tenant; an unknown effort costs as balanced."""
    unit = F.coalesce(*[F.when(F.col("effort") == e, F.lit(float(p))) for e, p in prices.items()], F.lit(float(prices["balanced"])))
    lines = ledger.where("operation = 'compress'").groupBy("tenant_id", "effort").agg(F.sum("bytes_in").alias("ingested"))
    lines = lines.select("tenant_id", "effort", *_line("tenant_id", F.col("ingested"), unit))
    rows = lines.groupBy("tenant_id").agg(F.count("*").alias("lines"), F.sum("micro_cents").alias("micro_cents"))
    return rows.withColumn("cents", F.round(F.col("micro_cents") / 1e6).cast("long"))


def price_config(tenants: DataFrame) -> DataFrame:
    """Tenants with their prices from JSON: absent fields take their defaults, text that is no JSON takes all, an unknown plan is savings_share."""
    parsed = F.from_json("price_config", "share_percent double, reference_cents double, fast double, balanced double, max double")
    rows = tenants.withColumn("_p", parsed)
    default = {"share_percent": SHARE_PERCENT, "reference_cents": REFERENCE_CENTS, **EFFORT_CENTS}
    prices = [F.coalesce(F.col(f"_p.{k}"), F.lit(float(v))).alias(k) for k, v in default.items()]
    plan = F.when(F.col("plan").isin("savings_share", "ingested_gb"), F.col("plan")).otherwise("savings_share")
    return rows.select("id", plan.alias("plan"), *prices)


def recent(ledger: DataFrame, limit: int = 100) -> DataFrame:
    """The newest events; the limit stays between 1 and 1000, the id settles ties."""
    return ledger.orderBy(F.desc("occurred_at_ms"), F.desc("event_id")).limit(min(max(limit, 1), 1000))


def grants_page(grants: DataFrame, search: str | None = None, limit: int = 100) -> DataFrame:
    """Grants, last updated first, whose name holds ``search`` literally."""
    rows = grants.where(F.contains("name", F.lit(search))) if search else grants
    return rows.orderBy(F.desc("updated_ord"), "object_hash").limit(min(max(limit, 1), 1000))


def after_delete(grants: DataFrame, deleted: DataFrame, purge: bool = False) -> DataFrame:
    """Grants after one deletion each in ``deleted`` (tenant_id, object_hash): a reference less, or gone with the last one."""
    hit = deleted.select("tenant_id", "object_hash", F.lit(1).alias("hit")).distinct()
    rows = grants.join(hit, ["tenant_id", "object_hash"], "left")
    left = F.when(F.col("hit").isNull(), F.col("refs")).when(F.lit(purge), F.lit(0)).otherwise(F.col("refs") - 1)
    return rows.withColumn("refs", left).where("refs > 0").drop("hit")


def orphans(objects: DataFrame, grants: DataFrame) -> DataFrame:
    """Objects on which no tenant holds a grant any more."""
    return objects.select("object_hash", "original_size").distinct().join(grants, "object_hash", "left_anti")


def readable(objects: DataFrame, grants: DataFrame) -> DataFrame:
    """Objects that their asking tenant holds a grant on."""
    return objects.join(grants, ["tenant_id", "object_hash"], "left_semi")


def usable_keys(keys: DataFrame, now_ms: int) -> DataFrame:
    return keys.where(F.col("revoked_at_ms").isNull() & (F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms)))


def has_scope(scopes: Column, scope: str) -> Column:
    """Whether a comma-separated list holds a scope; admin holds all."""
    listed = F.split(scopes, ",")
    return F.array_contains(listed, scope) | F.array_contains(listed, "admin")


def authenticated(requests: DataFrame, keys: DataFrame, tenants: DataFrame, now_ms: int) -> DataFrame:
    """Requests with a usable key of an active tenant; a key reads prefix_id_secret, its secret is held by digest."""
    part = F.split("key", "_", 3)
    asked = requests.withColumn("key_id", F.get(part, F.lit(1))).withColumn("key_hash", F.sha2(F.get(part, F.lit(2)), 256))
    active = tenants.where("active = 1").select(F.col("id").alias("tenant_id"))
    return asked.join(usable_keys(keys, now_ms), ["key_id", "key_hash"]).join(active, "tenant_id")


def idempotent(events: DataFrame, key: str = "idempotency_key", order: str = "event_id") -> DataFrame:
    """The first event for each tenant and key; events without a key all stay."""
    first = F.row_number().over(W.partitionBy("tenant_id", key).orderBy(order))
    keyed = events.where(F.col(key).isNotNull()).withColumn("_nth", first).where("_nth = 1").drop("_nth")
    return keyed.unionByName(events.where(F.col(key).isNull()))


def replayed(events: DataFrame, key: str = "idempotency_key", order: str = "event_id") -> DataFrame:
    """Events that repeat a key, with the id of the event whose result they are answered with."""
    w = W.partitionBy("tenant_id", key).orderBy(order)
    rows = events.where(F.col(key).isNotNull()).withColumn("first_event_id", F.first(order).over(w))
    return rows.where(F.col(order) != F.col("first_event_id"))


def latency_histogram(events: DataFrame, value: str = "cpu_ms", bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Counts and running counts of le-buckets, for each operation; NaN and negative values are left out."""
    spark = events.sparkSession
    slot = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value)))
    counted = events.where((F.col(value) >= 0) & ~F.isnan(value)).groupBy("operation", slot.alias("slot")).agg(F.count("*").alias("n"))
    names = [*(f"{b:g}" for b in bounds), "+Inf"]
    slots = spark.createDataFrame(list(enumerate(names)), "slot int, le string")
    frame = events.select("operation").distinct().crossJoin(F.broadcast(slots))
    rows = frame.join(counted, ["operation", "slot"], "left").fillna(0, ["n"])
    return rows.withColumn("cumulative", F.sum("n").over(W.partitionBy("operation").orderBy("slot"))).select("operation", "le", "n", "cumulative")


def codec_usage(used: DataFrame, catalog: DataFrame) -> DataFrame:
    """How often each codec of the catalog was used, zero where it wasn't."""
    counts = used.groupBy("codec").agg(F.count("*").alias("n"))
    return catalog.select("codec").join(counts, "codec", "left").select("codec", F.coalesce("n", F.lit(0)).alias("n"))


def prometheus(histogram: DataFrame, name: str = "operation_ms") -> DataFrame:
    """A histogram as lines of Prometheus text."""
    return histogram.select(F.format_string(name + '_bucket{operation="%s",le="%s"} %d', "operation", "le", "cumulative").alias("line"))
