"""Further queries: accounts, names, files, signatures, families, summaries, dictionaries. Registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content, dataset, names
from ..operators import accounts, models, summaries
from ..operators import blocks as blk
from ..operators import economics as eco
from ..operators import inventory as inv
from ..operators import ledger as led
from ..sources import container, files
from ..sources import tables as src
from ..sources.tables import GRANTS_SQL, LEDGER_SQL, OBJECTS_SQL
from ..streaming import watch
from . import planner
from .registry import query

NOW = 1_000_000

# --- accounts: customers as keys of eight tenants ---------------------------------

_KEYS_SQL = """keys AS (SELECT c_custkey, 'k' || c_custkey::VARCHAR AS key_id, 't' || (c_custkey % 8)::VARCHAR AS tenant_id, sha256('secret' || c_custkey::VARCHAR) AS key_hash, CASE c_custkey % 3 WHEN 0 THEN 'read,compress' WHEN 1 THEN 'admin' ELSE 'read' END AS scopes,
  CASE WHEN c_custkey % 7 = 0 THEN c_custkey * 1000 END AS expires_at_ms, CASE WHEN c_custkey % 11 = 0 THEN c_custkey END AS revoked_at_ms, c_custkey % 100 AS created_at_ms FROM customer)"""
_TENANTS_SQL = "tenants AS (SELECT 't' || i::VARCHAR AS id, CASE WHEN i = 5 THEN 0 ELSE 1 END AS active, (i * 37 % 10)::BIGINT AS created_at_ms FROM generate_series(0, 8) g(i))"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return src.load(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("k"), k).alias("key_id"), F.concat(F.lit("t"), k % 8).alias("tenant_id"), F.sha2(F.concat(F.lit("secret"), k), 256).alias("key_hash"),
        F.when(k % 3 == 0, "read,compress").when(k % 3 == 1, "admin").otherwise("read").alias("scopes"),
        F.when(k % 7 == 0, k * 1000).alias("expires_at_ms"), F.when(k % 11 == 0, k).alias("revoked_at_ms"), (k % 100).alias("created_at_ms"),
    )


def _tenants(spark: SparkSession) -> DataFrame:
    return spark.range(9).select(F.concat(F.lit("t"), F.col("id")).alias("id"), F.when(F.col("id") == 5, 0).otherwise(1).alias("active"), (F.col("id") * 37 % 10).alias("created_at_ms"))


@query(f"WITH {_KEYS_SQL} SELECT key_id, list_contains(string_split(scopes, ','), 'compress') OR list_contains(string_split(scopes, ','), 'admin') AS may_compress FROM keys WHERE revoked_at_ms IS NULL AND (expires_at_ms IS NULL OR expires_at_ms > {NOW})")
def usable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return led.usable_keys(_keys(spark, sf_dir), NOW).select("key_id", led.has_scope(F.col("scopes"), "compress").alias("may_compress"))


@query(f"""WITH {_KEYS_SQL}, {_TENANTS_SQL}, asked AS (SELECT c_custkey AS request, 'k' || c_custkey::VARCHAR AS key_id, sha256('secret' || (c_custkey + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END)::VARCHAR) AS key_hash FROM customer)
  SELECT request, key_id, tenant_id FROM asked JOIN keys USING (key_id, key_hash) JOIN tenants ON tenant_id = id WHERE active = 1 AND revoked_at_ms IS NULL AND (expires_at_ms IS NULL OR expires_at_ms > {NOW})""")
def authenticated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by all keys, some with a wrong secret."""
    k = F.col("c_custkey")
    asked = src.load(spark, sf_dir, "customer").select(k.alias("request"), F.concat(F.lit("pre_k"), k, F.lit("_secret"), k + F.when(k % 13 == 0, 1).otherwise(0)).alias("key"))
    return led.authenticated(asked, _keys(spark, sf_dir), _tenants(spark), NOW).select("request", "key_id", "tenant_id")


@query(f"""WITH {_KEYS_SQL}, {_TENANTS_SQL}, {GRANTS_SQL}, g AS (SELECT 't' || (updated_ord % 8)::VARCHAR AS tenant_id FROM grants)
  SELECT id, (SELECT count(*) FROM keys k WHERE k.tenant_id = t.id) AS keys, (SELECT count(*) FROM g WHERE g.tenant_id = t.id) AS grants FROM tenants t""")
def tenant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = src.grants(src.objects(src.load(spark, sf_dir, "documents"))).withColumn("tenant_id", F.concat(F.lit("t"), F.col("updated_ord") % 8))
    return accounts.counts(_tenants(spark), _keys(spark, sf_dir), held)


@query(f"""WITH {_KEYS_SQL}, {_TENANTS_SQL} SELECT key_id, tenant_id, dense_rank() OVER (ORDER BY t.created_at_ms, id)::BIGINT AS tenant_place, row_number() OVER (PARTITION BY tenant_id ORDER BY k.created_at_ms DESC, key_id)::BIGINT AS key_place
  FROM keys k JOIN (SELECT * FROM tenants WHERE id IN (SELECT tenant_id FROM keys)) t ON tenant_id = id""")
def listed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = _tenants(spark).join(_keys(spark, sf_dir).select(F.col("tenant_id").alias("id")).distinct(), "id", "left_semi")
    return accounts.listed(tenants, _keys(spark, sf_dir)).select("key_id", "tenant_id", F.col("tenant_place").cast("long").alias("tenant_place"), F.col("key_place").cast("long").alias("key_place"))


@query("""WITH s AS (SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey % 2 = 0),
  c AS (SELECT o_custkey AS id, o_totalprice AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, o_totalprice DESC) AS n FROM orders)
  SELECT id, value FROM s WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, value FROM c WHERE n = 1 AND op <> 'delete'""")
def upserted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of customers after changes that come with their orders."""
    state = src.load(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    changes = src.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 5 == 0, "delete").otherwise("upsert").alias("op"), F.struct("o_orderkey", "o_totalprice").alias("at"))
    return accounts.upserted(state, changes, ["id"], "at")


@query(f"""WITH {LEDGER_SQL}, e AS (SELECT (occurred_at_ms // 60000 * 60000 + 60000)::BIGINT AS at_ms, sum(bytes_in) AS i, sum(bytes_out) AS o, count(*) AS n FROM ledger GROUP BY 1)
  SELECT at_ms, (sum(i) OVER w)::BIGINT AS total_in, (sum(o) OVER w)::BIGINT AS essence_out, (sum(n) OVER w)::BIGINT AS events FROM e WINDOW w AS (ORDER BY at_ms)""")
def service_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.snapshots(src.ledger(src.load(spark, sf_dir, "events")))


@query(f"""WITH {LEDGER_SQL}, k AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE object_hash END AS key FROM ledger), n AS (SELECT *, min(event_id) OVER (PARTITION BY tenant_id, key) AS first_event_id FROM k WHERE key IS NOT NULL)
  SELECT event_id, first_event_id FROM n WHERE event_id <> first_event_id""")
def replayed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.ledger(src.load(spark, sf_dir, "events")).withColumn("idempotency_key", F.when(F.col("event_id") % 5 != 0, F.col("object_hash")))
    return led.replayed(rows).select("event_id", "first_event_id")


@query(f"""WITH {OBJECTS_SQL}, g AS (SELECT DISTINCT tenant_id, object_hash FROM objects WHERE ord % 3 <> 0) SELECT ord, object_hash FROM objects JOIN g USING (tenant_id, object_hash)""")
def readable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.objects(src.load(spark, sf_dir, "documents"))
    return led.readable(rows, src.grants(rows.where("ord % 3 != 0"))).select("ord", "object_hash")


@query(f"WITH {LEDGER_SQL}, w AS (SELECT 1706000000000 + event_id AS now, event_id % 400 AS days FROM events) SELECT now, days, (now + 1 - least(greatest(days, 1), 366) * 86400000)::BIGINT AS start_ms, now + 1 AS end_ms FROM w WHERE days IN (0, 1, 30, 366, 399)")
def default_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that a request without ends means."""
    w = src.load(spark, sf_dir, "events").select((F.lit(1706000000000) + F.col("event_id")).alias("now"), (F.col("event_id") % 400).alias("days")).where("days IN (0, 1, 30, 366, 399)")
    return w.select("now", "days", *src.window_columns(F.col("now"), F.col("days")))


# --- names and ids ------------------------------------------------------------------

_ODD_SQL = "odd AS (SELECT doc_id, sha256(text) AS h, CASE doc_id % 6 WHEN 0 THEN sha256(text) || '.syntra' WHEN 1 THEN upper(sha256(text)) || '_part.bin' WHEN 2 THEN 'short' WHEN 3 THEN 'a/b\\c/' || lang WHEN 4 THEN '' ELSE 'x' || chr(9) || source END AS name FROM documents)"


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, d = F.sha2("text", 256), F.col("doc_id") % 6
    name = F.when(d == 0, F.concat(h, F.lit(".syntra"))).when(d == 1, F.concat(F.upper(h), F.lit("_part.bin"))).when(d == 2, "short").when(d == 3, F.concat(F.lit("a/b\\c/"), "lang")).when(d == 4, "").otherwise(F.concat(F.lit("x\t"), "source"))
    return src.load(spark, sf_dir, "documents").select("doc_id", h.alias("h"), name.alias("name"))


@query(f"""WITH {_ODD_SQL} SELECT doc_id, CASE WHEN regexp_matches(name, '^[0-9a-fA-F]{{64}}(_.*)?(\\.[a-z]+)?$') THEN lower(substr(name, 1, 64)) END AS object_id, regexp_matches(name, '^[A-Za-z0-9._-]{{1,64}}$') AS is_tenant,
  coalesce(nullif(substr(regexp_replace(regexp_replace(name, '^.*[/\\\\]', ''), '[[:cntrl:]]', '', 'g'), 1, 255), ''), 'unnamed') AS safe, substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.bin' AS vault FROM odd""")
def checked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names, ids and digests become before they are used."""
    n = F.col("name")
    return _odd(spark, sf_dir).select("doc_id", content.valid_object_id(n).alias("object_id"), content.valid_tenant_id(n).alias("is_tenant"), content.safe_name(n).alias("safe"), files.vault_path(F.col("h")).alias("vault"))


@query("SELECT class, CASE WHEN class IN ('pre_compressed', 'media', 'incompressible') THEN '' ELSE lower(class) END AS key FROM (VALUES " + ", ".join(f"('{c}')" for c in content.CLASSES) + ") v(class)")
def dictionary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in content.CLASSES], "class string")
    return rows.select("class", content.dictionary_key(F.col("class")).alias("key"))


@query("""SELECT doc_id, 'blocos:' || ['stored', 'zstd-3', 'xz-6'][(doc_id % 3)::INT + 1] AS label, (strlen(text) + strlen(text) // 8 + 4096)::BIGINT AS room, least(greatest(doc_id % 40, 17), 31)::BIGINT AS window_log FROM documents""")
def block_names_and_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = F.get(F.array(F.lit("stored"), F.lit("zstd:3"), F.lit("xz:6")), (F.col("doc_id") % 3).cast("int"))
    return src.load(spark, sf_dir, "documents").select("doc_id", names.block_label(plan).alias("label"), names.packed_room(F.octet_length("text").cast("long")).alias("room"), names.window_log(F.col("doc_id") % 40).cast("long").alias("window_log"))


@query("SELECT count(*) AS texts, 0::BIGINT AS wrong FROM documents")
def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows read from the headers of zstd frames, against the sizes that went in: the wrong ones are counted."""
    rows = blk.packed(src.load(spark, sf_dir, "documents"), "doc_id", "text", "zstd", 3)
    found = rows.select("size", names.frame_window(F.col("packed")).alias("window"))
    return found.agg(F.count("*").alias("texts"), F.count_if(F.col("window").isNull() | (F.col("window") < F.least(F.col("size"), F.lit(1 << 17)))).alias("wrong"))


@query("SELECT count(*) AS names, count(DISTINCT source) AS ids FROM documents")
def anonymous_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = src.load(spark, sf_dir, "documents").select(names.anonymous_id(b"salt", "source")(F.col("source")).alias("id"))
    return ids.agg(F.count("*").alias("names"), F.count_distinct("id").alias("ids"))


# --- files ---------------------------------------------------------------------------


@query("""WITH h AS (SELECT page_id, hex(encode(html)) AS h, strlen(html) AS n FROM pages)
  SELECT page_id, CASE WHEN n > 4096 THEN 3 ELSE 1 END AS windows, sha256(CASE WHEN n > 4096 THEN unhex(substr(h, 1, 512) || substr(h, ((n - 256) // 2) * 2 + 1, 512) || substr(h, (n - 256) * 2 + 1, 512)) ELSE unhex(substr(h, 1, 512)) END) AS digest FROM h""")
def content_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, middle and end of long pages, the start of others."""
    w = files.windows(F.col("html").cast("binary"), 256, 4096)
    return src.load(spark, sf_dir, "pages").select("page_id", F.size(w).alias("windows"), w.alias("w")).select(
        "page_id", "windows", F.sha2(F.unhex(F.array_join(F.transform("w", lambda x: F.hex(x)), "")), 256).alias("digest")
    )


@query(f"""WITH {OBJECTS_SQL} SELECT DISTINCT object_hash FROM objects WHERE object_hash NOT IN (SELECT object_hash FROM objects WHERE ord % 3 = 0)""")
def unindexed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a vault whose index holds a third of the documents."""
    rows = src.objects(src.load(spark, sf_dir, "documents"))
    vault = rows.select(F.concat("object_hash", F.lit(".bin")).alias("name")).distinct()
    return files.unindexed(vault, rows.where("ord % 3 = 0").select("object_hash").distinct()).select("object_hash")


@query("""WITH d AS (SELECT lang AS class, doc_id AS mtime, lang || '.' || CASE WHEN doc_id % 4 = 0 THEN '0000000000000000' ELSE substr(sha256(text), 1, 16) END AS id, doc_id % 4 <> 0 AS sound FROM documents)
  SELECT class, arg_max(id, (mtime, id)) AS id FROM d WHERE sound GROUP BY 1""")
def newest_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as dictionaries of their language; every fourth one's name doesn't match its content."""
    digest = F.when(F.col("doc_id") % 4 == 0, "0" * 16).otherwise(F.substring(F.sha2("text", 256), 1, 16))
    return files.newest_dictionary(src.load(spark, sf_dir, "documents").select(F.col("lang").alias("class"), F.col("doc_id").alias("mtime"), F.concat_ws(".", "lang", digest).alias("id"), F.col("text").cast("binary").alias("content")))


@query("SELECT count(*) AS envelopes, count(*) AS sniffed, count(*) AS restored FROM documents")
def envelopes_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text sealed in an envelope, told by its first bytes, and opened again."""
    rows = blk.sealed(src.load(spark, sf_dir, "documents"), "doc_id", "text", "zstd:3")
    return rows.agg(F.count("*").alias("envelopes"), F.count_if(container.is_envelope(F.col("envelope"))).alias("sniffed"), F.count_if("restored").alias("restored"))


@query("SELECT count(*) AS objects, 36::BIGINT AS kinds_times_seeds, true AS repeatable FROM range(36)")
def synthetic_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up objects of all kinds, made twice: a row depends on its id and the seed alone."""
    one, two = (files.synthetic(spark, 36, 4096, 7).repartition(n).select("id", F.sha2("content", 256).alias(f"d{n}")) for n in (2, 5))
    return one.join(two, "id").agg(F.count("*").alias("objects"), F.count_distinct("d2").alias("kinds_times_seeds"), F.every(F.col("d2") == F.col("d5")).alias("repeatable"))


@query("""WITH o AS (SELECT doc_id // 2 AS path, sha256(text) AS old FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id // 2 AS path, sha256(text) AS digest, strlen(text) AS size FROM documents WHERE doc_id % 2 = 1)
  SELECT path, digest, old AS old_digest, size FROM n JOIN o USING (path) WHERE digest <> old""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.load(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("path"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    return inv.changed_pairs(rows.where("doc_id % 2 = 0").drop("size"), rows.where("doc_id % 2 = 1").drop("doc_id"), "path", "digest").select("path", "digest", "old_digest", "size")


# --- signatures and classes -----------------------------------------------------------

_HEADS = [(bytes(at) + magic, fmt, klass) for at, magic, fmt, klass in dataset.SIGNATURES] + [
    (b"BZh9", "bzip2", "container_comprimido"), (b"BZh0", None, None), (bytes(257) + b"ustar", "tar", None), (b"%PDF-1.7", "pdf", None), (b"RIFF0000WAVE", "wav", None), (b"RIFF0000WEBP", "webp", "imagem_audio_video"),
    (b"RIFF0000AVI ", "avi", "imagem_audio_video"), (b"0000ftypheic", "heif", "imagem_audio_video"), (b"0000ftypisom", "iso_bmff", "imagem_audio_video"), (b"II*\0", "tiff", None), (b"MM\0*", "tiff", None), (b"BM1234", None, None),
    (b"MZ" + bytes(58) + b"\x40\0\0\0" + b"PE\0\0", "pe", "binario"), (b"MZ" + bytes(80), None, None), (b"plain text", None, None), (b"", None, None),
]


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a signature set before them."""
    heads = spark.createDataFrame([(i, bytearray(h)) for i, (h, *_) in enumerate(_HEADS)], "head int, magic binary")
    pages = src.load(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % len(_HEADS)).cast("int").alias("head"), "html")
    tail = F.when(F.col("head") == len(_HEADS) - 1, F.unhex(F.lit(""))).otherwise(F.lit(b"q q q q q q q q"))
    return pages.join(F.broadcast(heads), "head").select("page_id", "head", F.concat("magic", tail).alias("content"))


@query("SELECT page_id, format, class FROM pages JOIN (VALUES " + ", ".join(f"({i}, {repr(f) if f else 'NULL'}, {repr(c) if c else 'NULL'})" for i, (_, f, c) in enumerate(_HEADS)) + f") v(head, format, class) ON page_id % {len(_HEADS)} = head")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _heads(spark, sf_dir).withColumn("s", dataset.signature(F.col("content"), F.lit("")))
    return rows.select("page_id", "s.format", "s.class")


@query("SELECT page_id, coalesce(mime, 'text/plain') AS mime FROM pages LEFT JOIN (VALUES " + ", ".join(f"({i}, '{dataset.MIME_OF_FORMAT.get(f, 'text/plain')}')" for i, (_, f, _) in enumerate(_HEADS)) + f") v(head, mime) ON page_id % {len(_HEADS)} = head")
def mime_by_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of pages by their first bytes; all count as printable."""
    return _heads(spark, sf_dir).select("page_id", dataset.mime_by_magic(F.col("content"), F.lit(1.0)).alias("mime"))


@query()
def dataset_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen classes over whole documents, pages, conversation turns and made-up binary objects, with the reason for each."""
    ending = F.element_at(F.array(*map(F.lit, ["txt", "dat", "log", ""])), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = src.load(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), ending.alias("ending"), F.col("text").cast("binary").alias("content"))
    rows = rows.unionByName(src.load(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id").alias("name"), F.lit("").alias("ending"), F.col("html").cast("binary").alias("content")))
    rows = rows.unionByName(files.synthetic(spark, 60, 16_384).select(F.concat(F.lit("made-"), "id").alias("name"), F.lit("").alias("ending"), "content"))
    return rows.withColumn("c", dataset.dataset_class(F.col("content"), F.col("ending"))).select("name", "c.class", "c.reason", F.round("c.corrected", 6).alias("corrected"), F.round("c.printable", 6).alias("printable"))


# --- families --------------------------------------------------------------------------


@query()
def family_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of pages found in three passes, in natural order of their addresses."""
    rows = src.load(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length("html").cast("long").alias("size"))
    found = inv.families_greedy(rows, inv.family_keys(F.col("path")), "page_id", F.struct(inv.natural_key(F.col("path")), "page_id"), "size")
    return found.select("page_id", "pass", "family", F.col("chain").cast("long").alias("chain"), F.col("position").cast("long").alias("position"), "versions")


# --- dedup and summaries -----------------------------------------------------------------


@query(f"""WITH {OBJECTS_SQL}, u AS (SELECT object_hash, original_size, count(*) AS n FROM objects GROUP BY 1, 2)
  SELECT sum(n)::BIGINT AS files, count(*) AS unique_files, sum(n * original_size)::BIGINT AS bytes, sum(original_size)::BIGINT AS unique_bytes, round(sum(n * original_size)::DOUBLE / sum(original_size), 6) AS ratio FROM u""")
def whole_file_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.whole_file_dedup(src.objects(src.load(spark, sf_dir, "documents")), "object_hash", "original_size")


_GROUPS_SQL = "g AS (SELECT sha256(text) AS h, min(doc_id) AS first, arg_min(lang, doc_id) AS class, count(*) AS copies, (count(*) - 1) * strlen(any_value(text)) AS redundant_bytes FROM documents GROUP BY 1 HAVING count(*) > 1)"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("size")).agg(F.min("doc_id").alias("first"), F.min_by("lang", "doc_id").alias("class"), F.count("*").alias("copies"))
    return rows.where("copies > 1").withColumn("redundant_bytes", (F.col("copies") - 1) * F.col("size"))


@query(f"WITH {_GROUPS_SQL} SELECT class, count(*) AS groups, round(avg(copies), 6) AS mean_copies, max(copies) AS most_copies, sum(redundant_bytes)::BIGINT AS redundant_bytes FROM g GROUP BY 1")
def copies_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.copies(_groups(spark, sf_dir))


@query(f"WITH {_GROUPS_SQL} SELECT first, copies, redundant_bytes FROM g ORDER BY redundant_bytes DESC, first LIMIT 10")
def largest_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.largest_groups(_groups(spark, sf_dir)).select("first", "copies", "redundant_bytes")


@query("""WITH b AS (SELECT lang, strlen(text) AS o, strlen(text) // 2 AS z3, CASE WHEN doc_id % 4 = 0 THEN strlen(text) // 3 END AS slow FROM documents)
  SELECT lang, count(slow) AS sampled, round(sum(slow)::DOUBLE / sum(z3) FILTER (slow IS NOT NULL) * (sum(z3)::DOUBLE / sum(o)), 9) AS ratio FROM b GROUP BY 1""")
def slow_codec_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up sizes by a fast codec, and by a slow one on a quarter of the texts."""
    n = F.octet_length("text").cast("long")
    rows = src.load(spark, sf_dir, "documents").select("lang", n.alias("o"), F.floor(n / 2).alias("z3"), F.when(F.col("doc_id") % 4 == 0, F.floor(n / 3)).alias("slow"))
    return summaries.slow_ratio(rows, "lang", "slow", "z3", "o")


@query("""WITH c AS (SELECT lang, sum(strlen(text)) AS bytes, 1.0::DOUBLE / (2 + count(*) % 5) AS ratio FROM documents GROUP BY 1) SELECT round(sum(bytes * ratio) / sum(bytes), 9) AS ratio, sum(bytes)::BIGINT AS bytes FROM c""")
def weighted_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.load(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), (1.0 / (2 + F.count("*") % 5)).alias("ratio"))
    return summaries.weighted_ratio(rows, "bytes", "ratio")


_SIZED_SQL = "s AS (SELECT source, lang, [100 + doc_id % 50, 90 + doc_id % 70, 120 - doc_id % 30]::BIGINT[] AS sizes, (doc_id % 4 % 3)::INT AS predicted FROM documents)"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = src.load(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.array(100 + d % 50, 90 + d % 70, 120 - d % 30).alias("sizes"), (d % 4 % 3).cast("int").alias("predicted"))
    return rows.withColumn("best", (F.array_position("sizes", F.array_min("sizes")) - 1).cast("int"))


@query(f"""WITH {_SIZED_SQL}, e AS (SELECT source, count(*) AS blocks, sum(sizes[predicted + 1] - list_min(sizes))::BIGINT AS extra, sum(list_min(sizes)) AS best FROM s GROUP BY 1)
  SELECT source, blocks, extra, round(extra::DOUBLE / best, 9) AS regret FROM e""")
def errors_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.errors_by_file(_sized(spark, sf_dir), "source", "predicted", "sizes")


@query(f"""WITH {_SIZED_SQL}, d AS (SELECT lang, list_position(sizes, list_min(sizes)) - 1 AS best, count(*) AS n FROM s GROUP BY 1, 2) SELECT lang, best::INT AS best, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang), 6) AS share FROM d""")
def oracle_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.oracle_distribution(_sized(spark, sf_dir), "lang", "best")


@query("""SELECT source, count(*) AS runs, round(median(n / 1e6 / (ms / 1000)), 6) AS median, round(min(n / 1e6 / (ms / 1000)), 6) AS least, round(max(n / 1e6 / (ms / 1000)), 6) AS most
  FROM (SELECT source, strlen(text)::DOUBLE AS n, (1 + doc_id % 9)::DOUBLE AS ms FROM documents) GROUP BY 1""")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.load(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("double").alias("n"), (1 + F.col("doc_id") % 9).cast("double").alias("ms"))
    return summaries.timings(rows, ["source"], "n", "ms")


@query("""WITH r AS (SELECT 'classify' AS phase, least(strlen(text), 16384) AS n FROM documents UNION ALL SELECT 'hash', strlen(text) FROM documents WHERE doc_id % 3 = 0), t AS (SELECT sum(strlen(text)) AS t FROM documents)
  SELECT phase, count(*) AS files, sum(n)::BIGINT AS bytes, round(sum(n)::DOUBLE / any_value(t), 9) AS share FROM r, t GROUP BY 1""")
def read_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.load(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    reads = rows.select(F.lit("classify").alias("phase"), F.least(F.col("n"), F.lit(16384)).alias("n")).unionByName(rows.where("doc_id % 3 = 0").select(F.lit("hash").alias("phase"), "n"))
    return summaries.read_by_phase(reads.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("t")))), "phase", "n", F.max("t"))


@query("SELECT lang, count(*) AS n, coalesce(any_value(r), 400.0::DOUBLE) AS rate FROM documents LEFT JOIN (VALUES ('en', 325.0::DOUBLE), ('de', 517.0::DOUBLE)) v(lang, r) USING (lang) GROUP BY 1")
def throughput_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return summaries.with_default(rows, spark.createDataFrame([("en", 325.0), ("de", 517.0)], "lang string, rate double"), "lang", "rate", 400.0).select("lang", "n", "rate")


@query(f"""WITH {_GROUPS_SQL}, c AS (SELECT DISTINCT lang AS class FROM documents), d AS (SELECT class, sum(redundant_bytes)::BIGINT AS redundant_bytes FROM g WHERE class <> 'fr' GROUP BY 1), f AS (SELECT lang AS class, 0.5::DOUBLE AS share FROM documents WHERE lang = 'en' GROUP BY 1)
  SELECT class, coalesce(redundant_bytes, 0) AS redundant_bytes, coalesce(share, 0.1) AS share FROM c LEFT JOIN d USING (class) LEFT JOIN f USING (class)""")
def class_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What several tables know of each class, with defaults."""
    dup = _groups(spark, sf_dir).where("class != 'fr'").groupBy("class").agg(F.sum("redundant_bytes").alias("redundant_bytes"))
    share = spark.createDataFrame([("en", 0.5)], "class string, share double")
    classes = src.load(spark, sf_dir, "documents").select(F.col("lang").alias("class")).distinct()
    return summaries.class_info(classes, {"dup": (dup, {"redundant_bytes": 0}), "share": (share, {"share": 0.1})})


_CHUNK_SQL = "c AS (SELECT doc_id, strlen(text) AS n, sha256(text) AS h FROM documents)"


@query(f"""WITH {_CHUNK_SQL}, o AS (SELECT DISTINCT h FROM c WHERE doc_id % 2 = 0), w AS (SELECT h, min(doc_id) AS id, any_value(n) AS n FROM c WHERE doc_id % 2 = 1 AND h NOT IN (SELECT h FROM o) GROUP BY 1)
  SELECT CASE id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'equal' ELSE 'changed' END AS category, count(*) AS chunks, sum(n // 2)::BIGINT AS added FROM w GROUP BY 1""")
def marginal_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with odd ids as chunks of a new version: those that the old one lacks, with made-up packed sizes."""
    rows = src.load(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("h"))
    new = rows.where("doc_id % 2 = 1").groupBy("h").agg(F.min("doc_id").alias("id"), F.min("n").alias("n")).join(rows.where("doc_id % 2 = 0").select("h"), "h", "left_anti")
    category = F.when(F.col("id") % 3 == 0, "new").when(F.col("id") % 3 == 1, "equal").otherwise("changed")
    return summaries.marginal_cost(new.select(category.alias("category"), F.floor(F.col("n") / 2).alias("packed")), "category", "packed")


@query("""WITH s AS (SELECT lang AS "set", doc_id % 3 AS k, sum(strlen(text)) // (1 + doc_id % 3) AS stored, count(*) AS entries FROM documents GROUP BY 1, 2), t AS (SELECT "set", k, stored + entries * 40 AS total FROM s)
  SELECT a."set", ['none', 'fixed', 'cdc'][a.k::INT + 1] AS strategy, a.total::BIGINT AS total, round(1 - a.total::DOUBLE / b.total, 9) AS gain, 1 - a.total::DOUBLE / b.total >= 0.05 AS passes FROM t a JOIN t b ON a."set" = b."set" AND b.k = 0 WHERE a.k > 0""")
def dedup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up results of two strategies against none, for each language."""
    k = F.col("doc_id") % 3
    rows = src.load(spark, sf_dir, "documents").groupBy(F.col("lang").alias("set"), k.alias("k")).agg(F.sum(F.octet_length("text").cast("long")).alias("n"), F.count("*").alias("entries"))
    rows = rows.select("set", F.get(F.array(F.lit("none"), F.lit("fixed"), F.lit("cdc")), F.col("k").cast("int")).alias("strategy"), F.floor(F.col("n") / (1 + F.col("k"))).alias("stored"), "entries")
    return summaries.dedup_gate(rows, "none")


@query()
def bootstrap_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regret by language, with an interval over sources as files."""
    rows = _sized(spark, sf_dir).select("lang", "source", F.get("sizes", F.col("predicted")).alias("bytes"), F.array_min("sizes").alias("best"))
    return summaries.bootstrap_by_file(rows, "lang", "source", "bytes", "best", rounds=500).select("lang", "files", *[F.round(c, 9).alias(c) for c in ("ratio", "low", "high")])


# --- economics ------------------------------------------------------------------------------


@query("""WITH r AS (SELECT lang AS class, 'zstd-' || (doc_id % 2)::VARCHAR AS config, doc_id % 4 < 2 AS w, sum(strlen(text)) AS o, sum(strlen(text) // (2 + (doc_id % 4 < 2)::INT)) AS c FROM documents GROUP BY 1, 2, 3),
  p AS (SELECT class, config, max(c) FILTER (w) AS cw, max(c) FILTER (NOT w) AS co FROM r GROUP BY 1, 2) SELECT class, config, round((co::DOUBLE / cw - 1) * 100, 6) AS ratio_gain_pct, round((1 - cw::DOUBLE / co) * 100, 6) AS smaller_pct FROM p""")
def dictionary_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, w = F.octet_length("text").cast("long"), F.col("doc_id") % 4 < 2
    rows = src.load(spark, sf_dir, "documents").select(F.col("lang").alias("class"), F.concat(F.lit("zstd-"), F.col("doc_id") % 2).alias("config"), w.alias("with_dictionary"), n.alias("original"), F.floor(n / (2 + w.cast("int"))).alias("compressed"))
    return eco.dictionary_gain(rows).select("class", "config", F.round("ratio_gain_pct", 6).alias("ratio_gain_pct"), F.round("smaller_pct", 6).alias("smaller_pct"))


@query("""WITH f AS (SELECT lang AS class, 'zstd-3' AS config, doc_id % 7 = 0 AS synthetic, strlen(text) AS o, strlen(text) // 2 + 1 AS c, (1 + doc_id % 5)::DOUBLE AS cs, (1 + doc_id % 3)::DOUBLE AS ds FROM documents), a AS (SELECT * FROM f UNION ALL SELECT 'mix_real', config, synthetic, o, c, cs, ds FROM f WHERE NOT synthetic)
  SELECT class, config, count(*) AS files, round(sum(o)::DOUBLE / sum(c), 9) AS ratio, round(1 - sum(c)::DOUBLE / sum(o), 9) AS saved, round(sum(o) / 1e6 / sum(cs), 9) AS comp, round(sum(o) / 1e6 / sum(ds), 9) AS decomp FROM a GROUP BY 1, 2""")
def throughput_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    rows = src.load(spark, sf_dir, "documents").select(F.col("lang").alias("class"), F.lit("zstd-3").alias("config"), (F.col("doc_id") % 7 == 0).alias("synthetic"), n.alias("original"), (F.floor(n / 2) + 1).alias("compressed"), (1 + F.col("doc_id") % 5).cast("double").alias("comp_s"), (1 + F.col("doc_id") % 3).cast("double").alias("decomp_s"))
    return eco.throughput(rows).select("class", "config", "files", *[F.round(c, 9).alias(c) for c in ("ratio", "saved", "comp", "decomp")])


@query("""WITH s AS (SELECT 's' || c_custkey::VARCHAR AS name, (c_custkey % 10) / 20.0::DOUBLE AS saving FROM customer), m AS (SELECT name, saving * 0.023 * 60 - (2.5 / 40.0 - 0.0446 / 300.0) - 3.0 * 2.5 / 90.0 AS margin FROM s)
  SELECT name, round(margin, 9) AS margin, CASE WHEN margin > 0 THEN round((50000.0::DOUBLE + 100000.0 + 2.0 * 0.023 * 60) / margin, 3) END AS break_even_gb FROM m""")
def break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = {"gb_month": 0.023, "months": 60.0, "gpu_hour": 2.5, "enc_gb_hour": 40.0, "dec_gb_hour": 90.0, "reads": 3.0, "cpu_hour": 0.0446, "base_gb_hour": 300.0, "training": 50000.0, "research": 100000.0, "model_gb": 2.0}
    rows = src.load(spark, sf_dir, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("name"), ((F.col("c_custkey") % 10) / 20.0).alias("saving"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    return eco.break_even(rows).select("name", F.round("margin", 9).alias("margin"), F.round("break_even_gb", 3).alias("break_even_gb"))


@query("SELECT cores, years, round(15000.0::DOUBLE / cores / (years * 8760 * 0.7) + 5.0 / 1000 * 1.5 * 0.10, 12) AS price FROM (VALUES (32), (64), (128)) a(cores), (VALUES (3), (5)) b(years)")
def onprem_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c, y, round(eco.onprem_price(cores=c, years=y), 12)) for c in (32, 64, 128) for y in (3, 5)], "cores int, years int, price double")


@query("SELECT lang, r AS regret, g AS gain, c AS cost, r <= 0.01 AND g >= 0.01 AND c <= 0.02 AS enough FROM (SELECT lang, (count(*) % 5) / 200.0::DOUBLE AS r, (count(*) % 3) / 100.0::DOUBLE AS g, (count(*) % 4) / 100.0::DOUBLE AS c FROM documents GROUP BY 1)")
def stop_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.load(spark, sf_dir, "documents").groupBy("lang").agg(((F.count("*") % 5) / 200.0).alias("regret"), ((F.count("*") % 3) / 100.0).alias("gain"), ((F.count("*") % 4) / 100.0).alias("cost"))
    return models.stop_rule(rows)


# --- plans ------------------------------------------------------------------------------------


@query("SELECT count(*) AS texts, count(*) AS ok, 0::BIGINT AS grown FROM documents")
def forced_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text by one codec and level, whatever its class; what doesn't shrink is stored."""
    rows = src.load(spark, sf_dir, "documents").select("doc_id", F.lit("plain_text").alias("class"), "text")
    found = planner.pack(rows, "text", "max", "class", ["doc_id"], forced="zstd:3")
    return found.agg(F.count("*").alias("texts"), F.count_if("ok").alias("ok"), F.count_if(F.col("size") > F.col("original")).alias("grown"))


_SIZES = "(VALUES (0, 'zstd:12'), (1, 'csv_columnar+zstd:12'), (2, 'csv_columnar+brotli:9'), (3, 'stored')) v(idx, label)"


@query(f"""WITH m AS (SELECT doc_id, idx, label, strlen(text) AS original, CASE WHEN (doc_id + idx) % 11 = 0 THEN NULL WHEN label = 'stored' THEN strlen(text) ELSE strlen(text) * (3 + (doc_id * (idx + 1)) % 5) // 8 END AS size FROM documents, {_SIZES}),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size NULLS LAST, idx) AS n FROM m) SELECT doc_id, label, size::BIGINT AS size FROM r WHERE n = 1""")
def chosen_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice over given measurements, some of them failed."""
    labels = ["zstd:12", "csv_columnar+zstd:12", "csv_columnar+brotli:9", "stored"]
    rows = src.load(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("original")).crossJoin(F.broadcast(spark.createDataFrame(list(enumerate(labels)), "idx int, label string")))
    size = F.when((F.col("doc_id") + F.col("idx")) % 11 == 0, F.lit(None).cast("long")).when(F.col("label") == "stored", F.col("original")).otherwise(F.floor(F.col("original") * (3 + (F.col("doc_id") * (F.col("idx") + 1)) % 5) / 8))
    return planner.best_plan(rows.withColumn("size", size), ["doc_id"]).select("doc_id", "label", "size")


@query("SELECT count(DISTINCT lang) AS classes, count(*) AS texts, count(*) AS ok FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) >= 12 AND sum(least(strlen(text), 65536)) >= 49152)")
def dictionary_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary for each language that has texts enough, found again by its id, and every text of those packed and opened with it."""
    rows = src.load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("class"), "text")
    made = blk.trained_dictionaries(rows, "class", "text", "doc_id")
    known = {r["class"]: bytes(r["content"]) for r in blk.resolved(made, files.newest_dictionary(made.withColumn("mtime", F.lit(0)))).collect()}  # 112 KiB a class at most
    done = blk.dictionary_round_trips(rows.where(F.col("class").isin(list(known))), "doc_id", "class", "text", known)
    return done.agg(F.count_distinct("class").alias("classes"), F.count("*").alias("texts"), F.count_if("ok").alias("ok"))


# --- streams -------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id AS path, epoch_us(ts) // 1000 AS at, event_id, (event_id % 2)::BIGINT AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
  SELECT path::VARCHAR AS path, min(size) AS size FROM s WHERE n <= 3 GROUP BY 1 HAVING count(*) = 3 AND min(size) = max(size)""")
def steady_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as files whose size is sampled with every event: those whose last three samples agree."""
    rows = src.load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 2).alias("size"), F.struct(src.epoch_ms(F.col("ts")).alias("ms"), "event_id").alias("taken_ms"))
    return watch.stable(rows)


@query(f"""WITH {LEDGER_SQL}, b AS (SELECT operation, le, count(*) FILTER (cpu_ms >= 0 AND cpu_ms <= le) AS n FROM ledger, (VALUES {", ".join(f"({b}::DOUBLE)" for b in led.LATENCY_BOUNDS)}) v(le) GROUP BY 1, 2)
  SELECT operation, n AS cumulative FROM b""")
def metric_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of the latency histogram, read back from its lines of text."""
    lines = led.prometheus(led.latency_histogram(src.ledger(src.load(spark, sf_dir, "events"))).where("le != '+Inf'"))
    return lines.select(F.regexp_extract("line", 'operation="([a-z]+)"', 1).alias("operation"), F.regexp_extract("line", "([0-9]+)$", 1).cast("long").alias("cumulative"))
