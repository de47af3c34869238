"""Tenants and their tables: counts, listings, changes of state, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts(tenants: DataFrame, keys: DataFrame, grants: DataFrame) -> DataFrame:
    """How many keys and grants each tenant has, zero where there are none."""
    n_keys = keys.groupBy(F.col("tenant_id").alias("id")).agg(F.count("*").alias("keys"))
    n_grants = grants.groupBy(F.col("tenant_id").alias("id")).agg(F.count("*").alias("grants"))
    return tenants.select("id").join(n_keys, "id", "left").join(n_grants, "id", "left").fillna(0, ["keys", "grants"])


def listed(tenants: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys with their places: tenants from the oldest on, a tenant's keys from the newest on."""
    place = F.dense_rank().over(W.orderBy("created_at_ms", "id"))  # one row for each tenant
    first = tenants.select(F.col("id").alias("tenant_id"), place.alias("tenant_place"))
    nth = F.row_number().over(W.partitionBy("tenant_id").orderBy(F.desc("created_at_ms"), "key_id"))
    return keys.join(first, "tenant_id").withColumn("key_place", nth)


def upserted(state: DataFrame, changes: DataFrame, keys: list[str], order: str, kind: str = "op") -> DataFrame:
    """``state`` after ``changes``: rows of its columns with an order and a kind, upsert or delete; the last change of a key holds."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in changes.columns]), F.col(order)).alias("row"))
    kept = state.join(last.select(*keys), keys, "left_anti")
    new = last.where(F.col(f"row.{kind}") != "delete").select(*[F.col(f"row.{c}").alias(c) for c in state.columns])
    return kept.unionByName(new)


def snapshots(events: DataFrame, every_ms: int = 60_000) -> DataFrame:
    """State of the whole service at the end of each interval that has events: running bytes in and out, and events."""
    at = (F.floor(F.col("occurred_at_ms") / every_ms) * every_ms + every_ms).cast("long")
    each = events.groupBy(at.alias("at_ms")).agg(F.sum("bytes_in").alias("b_in"), F.sum("bytes_out").alias("b_out"), F.count("*").alias("n"))
    # days add up by themselves, so that no window holds all intervals
    day = F.floor(F.col("at_ms") / 86_400_000)
    each = each.withColumn("day", day)
    days = each.groupBy("day").agg(*[F.sum(c).alias(f"d_{c}") for c in ("b_in", "b_out", "n")])
    earlier = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select("day", *[F.coalesce(F.sum(f"d_{c}").over(earlier), F.lit(0)).alias(f"d_{c}") for c in ("b_in", "b_out", "n")])
    own = W.partitionBy("day").orderBy("at_ms")
    rows = each.join(F.broadcast(days), "day")
    return rows.select("at_ms", *[(F.col(f"d_{c}") + F.sum(c).over(own)).alias(name) for c, name in (("b_in", "total_in"), ("b_out", "essence_out"), ("n", "events"))])
