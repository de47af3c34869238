"""Inventory and exact dedup: sizes, duplicates, chunks, versions, families, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW_BYTES = 64 * 1024


def by_class(files: DataFrame, class_col: str, size_col: str) -> DataFrame:
    """Files, bytes and share of bytes of each class."""
    rows = files.groupBy(class_col).agg(F.count("*").alias("files"), F.sum(size_col).alias("bytes"))
    total = files.agg(F.sum(size_col).alias("total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("bytes") / F.col("total"), 6)).drop("total")


def by_extension(files: DataFrame, name_col: str, class_col: str, size_col: str, top: int = 25) -> DataFrame:
    """The extensions with most bytes, each with its class that has most."""
    rows = files.groupBy(extension(F.col(name_col)).alias("extension"), class_col).agg(F.count("*").alias("files"), F.sum(size_col).alias("bytes"))
    rows = rows.groupBy("extension").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.max_by(class_col, F.struct("bytes", class_col)).alias("dominant"))
    return rows.orderBy(F.desc("bytes"), "extension").limit(top)


def extension(name: Column) -> Column:
    """Lower-cased extension: "" for none, ? for irregular or long ones, # for digits only."""
    found = F.lower(F.substring_index(name, ".", -1))
    dotted = F.locate(".", name, 2) > 0
    return F.when(~dotted, "").when(found.rlike("^[0-9]+$"), "#").when(found.rlike("^[a-z0-9_]{1,10}$"), found).otherwise("?")


def size_percentiles(files: DataFrame, size_col: str) -> DataFrame:
    """Percentiles with linear interpolation, maximum and mean."""
    points = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
    return files.agg(
        *[F.round(F.percentile(size_col, p), 6).alias(n) for n, p in points.items()], F.max(size_col).alias("largest"), F.round(F.avg(size_col), 6).alias("mean")
    )


def bytes_below(files: DataFrame, size_col: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The size up to which 50, 90 and 99 % of all bytes lie.

    Sizes are summed up first, so the running sum sees distinct sizes only.
    """
    sizes = files.groupBy(F.col(size_col).alias("size")).agg(F.sum(size_col).alias("bytes"))
    run = sizes.withColumn("upto", F.sum("bytes").over(W.orderBy("size"))).withColumn("total", F.sum("bytes").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return run.agg(*[F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("size"))).alias(f"b{round(q * 100)}") for q in quantiles])


def duplicate_groups(files: DataFrame, hash_col: str, size_col: str, order_col: str) -> DataFrame:
    """Groups of at least two equal files, with the first one and the bytes that all others take."""
    rows = files.groupBy(hash_col, size_col).agg(F.count("*").alias("copies"), F.min(order_col).alias("first"))
    return rows.where("copies > 1").withColumn("redundant_bytes", (F.col("copies") - 1) * F.col(size_col))


def duplicate_bytes(files: DataFrame, class_col: str, hash_col: str, size_col: str, order_col: str) -> DataFrame:
    """Per class: redundant files and bytes (all but the first of equal ones) and their share."""
    nth = F.row_number().over(W.partitionBy(hash_col).orderBy(order_col))
    rows = files.withColumn("_again", nth > 1)
    return rows.groupBy(class_col).agg(
        F.count_if(F.col("_again")).alias("redundant_files"), F.sum(F.when(F.col("_again"), F.col(size_col)).otherwise(0)).alias("redundant_bytes"),
        F.round(F.sum(F.when(F.col("_again"), F.col(size_col)).otherwise(0)) / F.sum(size_col), 6).alias("redundant_share"),
    )


def sampled_hash(content: Column) -> Column:
    """Digest of the size and three windows; of all bytes where those would cover them."""
    n = F.octet_length(content)
    middle = F.floor((n - WINDOW_BYTES) / 2).cast("int")
    windows = F.concat(F.substring(content, F.lit(1), F.lit(WINDOW_BYTES)), F.substring(content, middle + 1, F.lit(WINDOW_BYTES)), F.substring(content, n - WINDOW_BYTES + 1, F.lit(WINDOW_BYTES)))
    return F.sha2(F.concat(n.cast("string").cast("binary"), F.when(n <= 3 * WINDOW_BYTES, content).otherwise(windows)), 256)


def duplicate_cascade(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """How many files are left as candidates after size, sampled digest and full digest; each digest is only taken of those left before."""
    sized = files.select(F.col(id_col).alias("id"), F.octet_length(content_col).alias("size"), F.col(content_col).cast("binary").alias("content"))
    # narrow aggregates first; the content is only joined where sizes, then samples repeat
    repeated = sized.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    left = sized.join(repeated, "size").withColumn("sampled", sampled_hash(F.col("content")))
    again = left.groupBy("size", "sampled").agg(F.count("*").alias("n"))
    alike = left.join(again.where("n > 1").select("size", "sampled"), ["size", "sampled"]).groupBy("size", F.sha2("content", 256).alias("full")).agg(F.count("*").alias("n"))
    by_sample = again.agg(F.sum("n").alias("by_size"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("by_sample"))
    # one row each
    return by_sample.withColumn("by_size", F.coalesce("by_size", F.lit(0))).crossJoin(F.broadcast(alike.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("by_content"))))


def fixed_chunks(files: DataFrame, id_col: str, content_col: str, size: int) -> DataFrame:
    """(id, block, offset, length, chunk) of every file in slices of ``size`` bytes; an empty file has none."""
    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("content"))
    n = F.octet_length("content")
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("id", "content", F.explode(blocks).alias("block"))
    chunk = F.substring("content", F.col("block") * size + 1, F.lit(size))
    return rows.select("id", "block", (F.col("block").cast("long") * size).alias("offset"), F.octet_length(chunk).cast("long").alias("length"), chunk.alias("chunk"))


def sorted_number_chunks(rows: DataFrame, id_col: str, number_col: str, size: int) -> DataFrame:
    """As ``fixed_chunks`` of each id's numbers in unsigned order, 8 bytes each, big end first; nulls are left out.

    No id's content is ever held whole: equal numbers are counted, their places
    follow from running counts, and each block's share of them is put together.
    """
    each = size // 8
    number = F.lpad(F.hex(F.col(number_col).cast("long")), 16, "0")
    counted = rows.where(F.col(number_col).isNotNull()).groupBy(F.col(id_col).alias("id"), number.alias("number")).agg(F.count("*").alias("n"))
    end = F.sum("n").over(W.partitionBy("id").orderBy("number").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counted.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    placed = placed.select("id", "number", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / each), F.floor((F.col("end") - 1) / each))).alias("block"))
    share = (F.least("end", (F.col("block") + 1) * each) - F.greatest("start", F.col("block") * each)).cast("int")
    blocks = placed.select("id", F.col("block").cast("int").alias("block"), F.struct("number", share.alias("n")).alias("part")).groupBy("id", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    chunk = F.unhex(F.array_join(F.transform("parts", lambda p: F.repeat(p["number"], p["n"])), ""))
    blocks = blocks.select("id", "block", chunk.alias("chunk"))
    return blocks.select("id", "block", (F.col("block").cast("long") * size).alias("offset"), F.octet_length("chunk").cast("long").alias("length"), "chunk")


def chunk_dedup(chunks: DataFrame, first_half: Column) -> DataFrame:
    """Total and distinct chunks and bytes; and the share of the second half's bytes that the first half has."""
    rows = chunks.select(F.sha2("chunk", 256).alias("hash"), "length", first_half.alias("old"))
    each = rows.groupBy("hash", "length").agg(F.count("*").alias("n"), F.count_if("old").alias("n_old"))
    new = F.col("n") - F.col("n_old")
    return each.agg(
        F.sum("n").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum(F.col("n") * F.col("length")).alias("bytes"), F.sum("length").alias("unique_bytes"),
        F.round(F.sum(F.when(F.col("n_old") > 0, new * F.col("length")).otherwise(0)) / F.sum(new * F.col("length")) * 100, 6).alias("known_pct"),
        F.round((1 - F.sum("length") / F.sum(F.col("n") * F.col("length"))) * 100, 6).alias("duplicate_pct"),
    )


def index_extrapolation(chunks: DataFrame, target_bytes: float = 5e15, entry_bytes: tuple[int, int] = (32, 40)) -> DataFrame:
    """Index size at a target volume, from distinct chunks a byte."""
    each = chunks.groupBy(F.sha2("chunk", 256)).agg(F.sum("length").alias("bytes"))
    rate = F.count("*") / F.sum("bytes")
    return each.agg(*[F.round(rate * target_bytes * e / 1e12, 6).alias(f"index_tb_{e}") for e in entry_bytes])


def version_categories(old: DataFrame, new: DataFrame, path: str, digest: str, size: str) -> DataFrame:
    """New files by what became of them: new, equal or changed; files and bytes."""
    before = old.select(path, F.col(digest).alias("_before"))
    rows = new.join(before, path, "left")
    kind = F.when(F.col("_before").isNull(), "new").when(F.col("_before") == F.col(digest), "equal").otherwise("changed")
    return rows.groupBy(kind.alias("category")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def changed_pairs(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    before = old.select(path, F.col(digest).alias("old_digest"))
    return new.join(before, path).where(F.col(digest) != F.col("old_digest"))


#: Words that announce a version number, and words that mark a copy.
VERSION_WORDS = ["v", "ver", "version", "rev", "r"]
COPY_WORDS = ["copy", "copia", "bak", "backup", "old", "final", "novo", "new"]
#: A run of letters, digits or separators, or any other character.
NAME_TOKEN = "[a-z]+|[0-9]+|[-_. :]+|[^a-z0-9]"


#: When a token says nothing but which version it is: kinds of its neighbours, by distance. Kinds are n for numbers, s separators,
#: v version words, c copy words, t the letter between date and time, w other words, ( and ), and ? for anything else.
DROPPED = [
    # numbers with separators between them, dates and times are one number
    {-2: "n", -1: "st", 0: "n"}, {-1: "n", 0: "st", 1: "n"},
    # v2, rev-3
    {0: "v", 1: "n"}, {0: "v", 1: "s", 2: "n"}, {-1: "v", 0: "s", 1: "n"},
    # -copy, _final
    {0: "s", 1: "c"}, {-1: "s", 0: "c"},
    # (2)
    {0: "s", 1: "(", 2: "n", 3: ")"}, {0: "(", 1: "n", 2: ")"}, {-1: "(", 0: "n", 1: ")"}, {-2: "(", -1: "n", 0: ")"},
]


def normalized(name: Column) -> Column:
    """A path without what tells versions apart: numbers, dates and times become one #, version words and copy marks go.

    The lower-cased name is cut into tokens, and each token kept or dropped by
    the kinds of its neighbours.
    """

    def kind(x: Column) -> Column:
        out = F.when(x.rlike("^[0-9]+$"), "n").when(x.rlike("^[-_. :]+$"), "s").when(x.isin(VERSION_WORDS), "v").when(x.isin(COPY_WORDS), "c")
        return out.when(x.isin("t", "(", ")"), x).when(x.rlike("^[a-z]+$"), "w").otherwise("?")

    def kept(z: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            drop = F.lit(False)
            for rule in DROPPED:
                fits = F.lit(True)
                for away, kinds in rule.items():
                    fits = fits & F.coalesce(F.get(z["k"], i + away), F.lit("-")).isin(*kinds)
                drop = drop | fits
            return F.when(drop, "").when(F.get(z["k"], i) == "n", "#").otherwise(x)

        return F.array_join(F.transform(z["t"], one), "")

    tokens = F.regexp_extract_all(F.lower(name), F.lit(NAME_TOKEN), F.lit(0))
    return F.get(F.transform(F.array(F.struct(tokens.alias("t"), F.transform(tokens, kind).alias("k"))), kept), F.lit(0))


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits count as numbers: for each run of other characters, it and the number after it."""
    parts = F.regexp_extract_all(name, F.lit("[^0-9]*[0-9]*"), F.lit(0))
    number = lambda p: F.regexp_replace(F.regexp_extract(p, "[0-9]*$", 0), "^0+(?=[0-9])", "")
    # a longer number is larger, whatever its size
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^[^0-9]*", 0).alias("text"), F.length(number(p)).alias("digits"), number(p).alias("number")))


def family_keys(path: Column) -> list[Column]:
    """Keys of three passes: equal names in folders that differ by version; names that differ by version in one folder; both may differ."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    name = F.regexp_extract(path, "([^/]*)$", 1)
    dotted = name.rlike(r"^.+\.[^.]*$")
    stem, ending = F.when(dotted, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name), F.when(dotted, F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))).otherwise("")

    def key(kind: str, *parts: Column) -> Column:
        return F.concat_ws("\x1f", F.lit(kind), *parts)

    return [key("A", normalized(folder), F.lower(name)), key("B", folder, normalized(stem), ending), key("C", normalized(folder), normalized(stem), ending)]


def family_chains(files: DataFrame, key: Column, order_col: str | Column, size_col: str, tolerance: float = 0.5) -> DataFrame:
    """Chains of at least two versions: files of a key in order, cut where neighbours' sizes differ too much."""
    w = W.partitionBy("family").orderBy(order_col)
    rows = files.where(F.col(size_col) > 0).withColumn("family", key).withColumn("_last", F.lag(size_col).over(w))
    size = F.col(size_col)
    cut = F.col("_last").isNull() | (F.greatest(size, F.col("_last")) > (1 + tolerance) * F.least(size, F.col("_last")))
    rows = rows.withColumn("chain", F.sum(cut.cast("int")).over(w)).withColumn("position", F.row_number().over(W.partitionBy("family", "chain").orderBy(order_col)))
    n = F.count("*").over(W.partitionBy("family", "chain"))
    return rows.withColumn("versions", n).where("versions > 1").drop("_last")


def families_greedy(files: DataFrame, keys: list[Column], id_col: str, order_col: str | Column, size_col: str, tolerance: float = 0.5) -> DataFrame:
    """Passes over several keys; a file that is in a chain of one pass takes no part in later ones."""
    free, out = files, None
    for i, key in enumerate(keys):
        found = family_chains(free, key, order_col, size_col, tolerance).withColumn("pass", F.lit(i))
        out = found if out is None else out.unionByName(found)
        free = free.join(found.select(id_col), id_col, "left_anti")
    return out


def block_offsets(blocks: DataFrame, object_col: str, block_col: str, length_col: str, start: int = 7) -> DataFrame:
    """Where each block is stored: after the header and all blocks before it."""
    before = W.partitionBy(object_col).orderBy(block_col).rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("stored_at", F.lit(start) + F.coalesce(F.sum(length_col).over(before), F.lit(0)))


def block_stats(blocks: DataFrame, object_col: str, plan_col: str, plan_index_col: str, stored_col: str, original_col: str, stored_plan: str = "stored") -> DataFrame:
    """Per object: blocks, bytes, plans, and the plan of most blocks that isn't stored (ties: lower index)."""
    plans = blocks.groupBy(object_col, plan_col, plan_index_col).agg(F.count("*").alias("n"), F.sum(stored_col).alias("stored"), F.sum(original_col).alias("original"))
    rank = F.when(F.col(plan_col) != stored_plan, F.struct(-F.col("n"), F.col(plan_index_col), F.col(plan_col).alias("name")))
    return plans.groupBy(object_col).agg(
        F.sum("n").alias("blocks"), F.sum("original").alias("original_bytes"), F.sum("stored").alias("stored_bytes"), F.count("*").alias("plans"),
        F.coalesce(F.min(rank)["name"], F.lit(stored_plan)).alias("dominant"),
    )


def distinct_plans(blocks: DataFrame, object_col: str, block_col: str, plan_col: str) -> DataFrame:
    """The plan table of each object: plans numbered by first use."""
    first = blocks.groupBy(object_col, plan_col).agg(F.min(block_col).alias("first_block"))
    return first.withColumn("plan_index", F.row_number().over(W.partitionBy(object_col).orderBy("first_block")) - 1)


def corrupt_blocks(blocks: DataFrame, expected_col: str, content_col: str) -> DataFrame:
    """Blocks whose content no longer has the digest that was recorded."""
    return blocks.where(F.sha2(content_col, 256) != F.col(expected_col))


def footer_faults(blocks: DataFrame, files: DataFrame, object_col: str, block_size_col: str) -> DataFrame:
    """First broken rule of each object's block table, in a fixed order; null where all hold.

    ``blocks``: object, block, offset, stored_len, original_len; ``files``: object, n_blocks, original_size, payload_end.
    """
    w = W.partitionBy(object_col).orderBy("block")
    rows = blocks.withColumn("_want", F.lit(7) + F.coalesce(F.sum("stored_len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_last", F.lead("block").over(w).isNull()).withColumn("_nth", F.row_number().over(w) - 1)
    seen = rows.join(files.select(object_col, block_size_col), object_col).groupBy(object_col).agg(
        F.count("*").alias("seen"), F.sum("original_len").alias("original"), F.max(F.col("offset") + F.col("stored_len")).alias("end"),
        F.count_if(F.col("block") != F.col("_nth")).alias("bad_order"), F.count_if(F.col("offset") != F.col("_want")).alias("bad_offset"),
        F.count_if(F.col("stored_len") > F.col("original_len")).alias("grown"), F.count_if(F.col("original_len") <= 0).alias("empty"),
        F.count_if(~F.col("_last") & (F.col("original_len") != F.col(block_size_col))).alias("short"), F.count_if(F.col("original_len") > F.col(block_size_col)).alias("long"),
    )
    rows = files.join(seen, object_col, "left").fillna(0)
    fault = (
        F.when(F.col("seen") != F.col("n_blocks"), "block_count").when(F.col("bad_order") > 0, "block_order").when(F.col("empty") > 0, "empty_block")
        .when(F.col("long") > 0, "block_too_long").when(F.col("short") > 0, "short_block_inside").when(F.col("grown") > 0, "stored_larger").when(F.col("bad_offset") > 0, "offset")
        .when(F.col("original") != F.col("original_size"), "original_size").when((F.col("n_blocks") > 0) & (F.col("end") != F.col("payload_end")), "payload_end")
    )
    return rows.select(object_col, fault.alias("fault"))


def first_names(files: DataFrame, hash_col: str, name_col: str, order_col: str, most: int = 32) -> DataFrame:
    """The first names under which an object was seen, each once."""
    named = files.groupBy(hash_col, name_col).agg(F.min(order_col).alias("o"))
    return named.withColumn("_nth", F.row_number().over(W.partitionBy(hash_col).orderBy("o"))).where(F.col("_nth") <= most).groupBy(hash_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", name_col))), lambda x: x[name_col]).alias("names"))
