"""Driver tables, and the ledger, object and grant tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GIB = float(1 << 30)
#: Half-open billing window in epoch milliseconds: 2024-01-01 to 2024-01-15 UTC.
WINDOW_FROM, WINDOW_TO = 1_704_067_200_000, 1_705_276_800_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds of a zone-less timestamp, cut down; no session zone takes part."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / F.lit(1000)).cast("long")


def dedup_scope(tenant: str, object_hash: str, order: str) -> Column:
    """tenant if the tenant had the object before, global if anyone had, else none."""
    mine = F.row_number().over(W.partitionBy(tenant, object_hash).orderBy(order))
    anyones = F.row_number().over(W.partitionBy(object_hash).orderBy(order))
    return F.when(mine > 1, "tenant").when(anyones > 1, "global").otherwise("none")


def ledger(events: DataFrame) -> DataFrame:
    """Usage events: one row for each event, in the columns of a usage ledger."""
    operation = (
        F.when(F.col("event_type") == "purchase", "compress").when(F.col("event_type") == "view", "read")
        .when(F.col("event_type") == "click", "analyze").when(F.col("event_type") == "signup", "decompress").otherwise("delete")
    )
    compress = F.col("operation") == "compress"
    rows = events.select(
        F.col("event_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 8).cast("string")).alias("tenant_id"),
        operation.alias("operation"),
        F.sha2("props", 256).alias("object_hash"),
        F.round(F.col("value") * 1_000_000).cast("long").alias("b"),
        F.col("value").alias("cpu_ms"),
        epoch_ms(F.col("ts")).alias("occurred_at_ms"),
    )
    rows = rows.withColumn("bytes_saved", F.when(compress, F.floor(F.col("b") * (F.col("event_id") % 10) / 10)).otherwise(0).cast("long"))
    rows = rows.select(
        "event_id", "tenant_id", "operation", "object_hash", "cpu_ms", "occurred_at_ms", "bytes_saved",
        F.when(compress, F.get(F.array(F.lit("fast"), F.lit("balanced"), F.lit("max")), (F.col("event_id") % 3).cast("int"))).otherwise("").alias("effort"),
        F.when(F.col("operation") == "delete", 0).otherwise(F.col("b")).cast("long").alias("bytes_in"),
        F.when(F.col("operation") == "delete", 0).otherwise(F.col("b") - F.col("bytes_saved")).cast("long").alias("bytes_out"),
    )
    return rows


def with_scope(ledger_rows: DataFrame) -> DataFrame:
    """The ledger with dedup_scope, which only compress rows have."""
    stored = ledger_rows.where("operation = 'compress'").withColumn("dedup_scope", dedup_scope("tenant_id", "object_hash", "event_id"))
    return stored.unionByName(ledger_rows.where("operation != 'compress'").withColumn("dedup_scope", F.lit("none")))


def in_window(rows: DataFrame, start: int = WINDOW_FROM, end: int = WINDOW_TO, tenant: str | None = None) -> DataFrame:
    rows = rows.where((F.col("occurred_at_ms") >= start) & (F.col("occurred_at_ms") < end))
    return rows.where(F.col("tenant_id") == tenant) if tenant else rows


def default_window(now_ms: int, days: int = 30, start: int | None = None, end: int | None = None) -> tuple[int, int]:
    """Missing ends of a window: up to now, and back 1 to 366 days; never reversed."""
    end = now_ms + 1 if end is None else end
    start = end - min(max(days, 1), 366) * 86_400_000 if start is None else start
    return min(start, end), end


def window_columns(now: Column, days: Column) -> list[Column]:
    """The same for columns: start_ms and end_ms of a window without ends."""
    end = (now + 1).cast("long")
    return [(end - F.least(F.greatest(days, F.lit(1)), F.lit(366)) * 86_400_000).cast("long").alias("start_ms"), end.alias("end_ms")]


def objects(documents: DataFrame) -> DataFrame:
    """Texts as objects of tenants: tenant_id, ord, name, original_size, object_hash."""
    return documents.select(
        F.col("source").alias("tenant_id"), F.col("doc_id").alias("ord"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.octet_length("text").cast("long").alias("original_size"), F.sha2("text", 256).alias("object_hash"),
    )


def grants(object_rows: DataFrame) -> DataFrame:
    """One row for each tenant and object: how often, first name, first and last place."""
    return object_rows.groupBy("tenant_id", "object_hash").agg(
        F.count("*").alias("refs"), F.min_by("name", "ord").alias("name"), F.max("original_size").alias("original_size"),
        F.min("ord").alias("created_ord"), F.max("ord").alias("updated_ord"),
    )


#: The same in DuckDB's SQL, as common table expressions.
LEDGER_SQL = """
base AS (SELECT event_id, 't' || (user_id % 8)::VARCHAR AS tenant_id,
  CASE event_type WHEN 'purchase' THEN 'compress' WHEN 'view' THEN 'read' WHEN 'click' THEN 'analyze' WHEN 'signup' THEN 'decompress' ELSE 'delete' END AS operation,
  sha256(props) AS object_hash, round(value * 1000000)::BIGINT AS b, value AS cpu_ms, epoch_us(ts) // 1000 AS occurred_at_ms FROM events),
saved AS (SELECT *, CASE WHEN operation = 'compress' THEN floor(b * (event_id % 10) / 10)::BIGINT ELSE 0 END AS bytes_saved FROM base),
ledger AS (SELECT event_id, tenant_id, operation, object_hash, cpu_ms, occurred_at_ms, bytes_saved,
  CASE WHEN operation = 'compress' THEN ['fast', 'balanced', 'max'][(event_id % 3)::INT + 1] ELSE '' END AS effort,
  CASE WHEN operation = 'delete' THEN 0 ELSE b END AS bytes_in, CASE WHEN operation = 'delete' THEN 0 ELSE b - bytes_saved END AS bytes_out FROM saved)
"""
IN_WINDOW_SQL = f"occurred_at_ms >= {WINDOW_FROM} AND occurred_at_ms < {WINDOW_TO}"
OBJECTS_SQL = """
objects AS (SELECT source AS tenant_id, doc_id AS ord, 'doc-' || doc_id::VARCHAR || '.txt' AS name,
  strlen(text) AS original_size, sha256(text) AS object_hash FROM documents)
"""
GRANTS_SQL = OBJECTS_SQL + """,
grants AS (SELECT tenant_id, object_hash, count(*) AS refs, arg_min(name, ord) AS name, max(original_size) AS original_size,
  min(ord) AS created_ord, max(ord) AS updated_ord FROM objects GROUP BY 1, 2)
"""
