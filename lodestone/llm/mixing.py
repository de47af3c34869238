"""Mixing sources to target weights by systematic sampling.

Each source gets a target amount of words. A source's documents all expect the
same number of copies, target over size. The expected copies are summed up
along the source's documents, one offset is added, and a document is emitted
once for every integer boundary that its step crosses.

The documents of a source stand in order of size class, then of a digest: so
every size is taken at its rate and the words taken come near the target.
Places in that order come from counts of small buckets, so no task ever holds
a whole source.

Null texts have size 0 and stay in their source; a null source is a source of
its own, after all others. Null ids and repeated rows are rows like any other;
rows of one id and size are interchangeable. A very long text has its whole
size, and is drawn twice at most like any other. An empty table gives an empty
result, a source without words the target 0. ``mix_sources`` looks at no other
columns; ``draw`` passes them on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import stored

WORD = r"[^ \t-\r]+"
#: Buckets that a size class of a source is dealt into.
SALTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest63(*cols: Column) -> Column:
    """A digest that DuckDB can compute too: 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Target of each source; ``sizes`` has source and source_size, one row for each source.

    ``share`` times all words is dealt by weight. No source gets over ``most``
    times its size; what is cut off goes to the others by weight. Ordered by
    size over weight, the cut sources come first, and the first source that
    isn't cut fixes the level for all after it.
    """
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("fill", "nth").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("fill", "nth").rowsBetween(W.currentRow, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("nth", order)
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("cut", F.col("fill") <= F.col("level"))
        .withColumn("free", F.min(F.when(~F.col("cut"), F.struct("fill", "nth", "level"))).over(everything)["level"])
        .select("source", "source_size", F.when(F.col("cut"), F.col("cap")).otherwise(F.col("weight") * F.col("free")).alias("target"))
    )


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: float, seed: str, carried: list[str]) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, and ``row`` with the carried columns."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        digest63(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-"))).alias("digest"),
    )
    rows = rows.withColumn("class", F.when(F.col("size") == 0, -1).otherwise(F.floor(F.log2("size") * 4)).cast("int"))
    rows = rows.withColumn("salt", (F.col("digest") % SALTS).cast("int"))
    # a null source needs a key that joins
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    if carried == [id_col]:
        # counting words is the dear part: it is done once, and without the text the rows are small
        rows = stored(rows)
    buckets = stored(rows.groupBy("key", "source", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    before = W.partitionBy("key").orderBy("class", "salt").rowsBetween(W.unboundedPreceding, -1)
    start = buckets.select("key", "class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rate = targets(buckets.groupBy("key", "source").agg(F.sum("size").alias("source_size")).drop("key"), weights, share, most).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("key"), "source_size", "target"
    )
    offset = digest63(F.lit(seed), F.lit("offset"), F.col("key")) / F.lit(float(1 << 60))
    plan = start.join(rate, "key").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("offset", offset)
    place = F.row_number().over(W.partitionBy("key", "class", "salt").orderBy("digest", "doc_id", "size"))
    placed = rows.withColumn("place", place).join(plan, ["key", "class", "salt"]).withColumn("i", F.col("before") + F.col("place"))
    copies = F.floor(F.col("offset") + F.col("i") * F.col("rate")) - F.floor(F.col("offset") + (F.col("i") - 1) * F.col("rate"))
    return placed.withColumn("copies", copies.cast("long"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken."""
    placed = _placed(docs, id_col, text_col, source_col, weights, share, most, seed, [id_col])
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def draw(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """The mix itself: every row of ``docs``, with all columns, as often as it is drawn."""
    placed = _placed(docs, id_col, text_col, source_col, weights, share, most, seed, docs.columns).where("copies > 0")
    return placed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: The same over ``documents`` in DuckDB's SQL, with the default parameters.
MIX_SQL = r"""
WITH a AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT AS digest FROM documents),
b AS (SELECT *, CASE WHEN size = 0 THEN -1 ELSE floor(log2(size) * 4)::INT END AS class, digest % 64 AS salt FROM a),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, digest, doc_id, size) AS i FROM b),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
nth AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sizes),
w AS (SELECT *, [3.0, 1.0, 2.0][((nth - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM nth),
f AS (SELECT *, cap / weight AS fill, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS alls FROM w),
l AS (SELECT *, (alls - coalesce(sum(cap) OVER (ORDER BY fill, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY fill, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT *, CASE WHEN fill <= level THEN cap
        ELSE weight * (SELECT level FROM l WHERE NOT fill <= level ORDER BY fill, nth LIMIT 1) END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5('mix|offset|' || coalesce('=' || source, 'null')), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS shift FROM t)
SELECT p.doc_id, p.size, r.source_size, r.target,
       ((floor(r.shift + p.i * r.rate) - floor(r.shift + (p.i - 1) * r.rate)) * p.size)::BIGINT AS taken
FROM placed p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""
