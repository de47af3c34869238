"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a sequence of tokens: words, and single characters of scripts that
set no spaces; a token has 32 code points at most. Of all runs of K tokens
those are chosen whose smallest inner run of S tokens (by digest) lies at an
edge. Whether a run is chosen depends on the run alone, so an edit leaves all
anchors that it doesn't touch. The digests of the chosen runs in the order of
the text are the fingerprint; a text of under K tokens, or without a chosen
run, has its whole sequence as its one anchor, an empty one has none.

As anchors are free of context, what two texts have in common has its anchors
in both, and in one order: likeness is the share of anchors that match at
positions which agree with their neighbours'.

Null texts count as empty; equal texts have equal fingerprints, and a very long
text has all its anchors. Rows of one id, null ids among them, stand in the
order of their texts' digests, and equal rows are interchangeable; a single row
follows itself. An empty table gives an empty result. Other columns are never
looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import unused
from .sharding import let

K, S = 12, 2
#: Thai and Lao, Burmese, Khmer, kana, Han with its extensions: ranges, as a script's name is looked up for each character.
_UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
TOKEN = rf"[{_UNSPACED}]|[^ \t-\r{_UNSPACED}]{{1,32}}"
#: Rows that a bucket of neighbouring ids should hold.
BUCKET_ROWS = 500
#: Anchors by which a match may shift against its neighbour's.
SHIFT = 4


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Digests (32 bits) of the closed syncmers of a text, in order."""
    inner = k - s + 1

    def chosen(h: Column) -> Column:
        """h: digests of the tokens."""
        runs = F.transform(
            F.slice(h, 1, F.size(h) - (s - 1)),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)]),
        )

        def edges(g: Column) -> Column:
            places = F.filter(
                F.sequence(F.lit(0), F.size(h) - k),
                lambda i: F.array_min(F.slice(g, i + 1, inner)) == F.least(F.get(g, i), F.get(g, i + (inner - 1))),
            )
            # short texts often have no such run
            return let(places, lambda p: F.when(F.size(p) > 0, F.transform(p, lambda i: F.hash(F.slice(h, i + 1, k)))).otherwise(F.array(F.hash(h))))

        return F.when(F.size(h) >= k, let(runs, edges)).when(F.size(h) > 0, F.array(F.hash(h))).otherwise(F.array().cast("array<int>"))

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), chosen)


def fingerprint(anchor: Column) -> Column:
    """Anchors as text, eight hexadecimal digits each."""
    return F.array_join(F.transform(anchor, lambda a: F.lpad(F.lower(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Anchors that two fingerprints share at matching positions, of all their anchors; 1 for two empty ones.

    A shared anchor's shift is its first position in one less that in the other.
    It counts if the shared anchor before or after it has its shift too, or if it
    has not moved, up to SHIFT anchors each: so what was moved as a whole counts,
    and what is met here and there does not.
    """

    def matched(shifts: Column) -> Column:
        def near(k: Column, other: Column) -> Column:
            return F.coalesce(F.abs(F.get(shifts, k) - other) <= SHIFT, F.lit(False))

        return F.size(F.filter(shifts, lambda d, k: (F.abs(d) <= SHIFT) | near(k - 1, d) | near(k + 1, d)))

    shifts = F.transform(F.array_intersect(a, b), lambda x: F.array_position(a, x) - F.array_position(b, x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(a == b, 1.0).otherwise(let(shifts, matched) / F.size(F.array_union(a, b)))


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with ``next_<column>`` of the document that follows by descending id; the first follows the last.

    Ids are cut into parts by quantiles, and those evenly into buckets; an id
    that fills a part is cut by its texts' digests. Each bucket also gets the
    first row of the bucket that follows it, so that no task sees more than a
    bucket. ``derived`` columns are computed once for each row and copy, and may
    be among ``columns``. Rows of one id stand in the order of their texts'
    digests, null ids after all others.
    """
    id_, digest_, part_, bucket_, copy_, nth_ = unused(docs, 6)
    low = -(1 << 63)
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumns({id_: F.coalesce(F.col(id_col).cast("long"), F.lit(low)), digest_: digest})
    parts = 64
    found = rows.agg(F.count("*").alias("n"), F.percentile_approx(id_, [i / parts for i in range(parts + 1)], 10_000).alias("q")).first()
    edges = found.q or [0]
    bounds = sorted(set(edges))
    full = [b for b in bounds if edges.count(b) > 1]
    fine = max(1, math.ceil(found.n / bucket_rows / parts))
    slices = fine * parts
    edge = F.array(*[F.lit(b) for b in bounds])

    def bucket(at: Column) -> Column:
        """Numbers of buckets fall as the order goes on; an id that is cut has ``slices`` of them, and all above it stand before."""
        start, end = F.get(edge, at).cast("double"), F.get(edge, at + 1).cast("double")
        inside = F.when(end > start, F.floor((F.col(id_) - start) / (end - start) * fine)).otherwise(F.lit(0))
        even = at * F.lit(fine).cast("long") + F.least(F.greatest(inside, F.lit(0)), F.lit(fine - 1))
        cut = F.least(F.floor((0.5 - F.col(digest_) / float(1 << 64)) * slices), F.lit(slices - 1))
        return even * (slices + 1) + (F.when(F.col(id_).isin(full), F.greatest(cut, F.lit(0))).otherwise(F.lit(slices)) if full else slices)

    part = F.greatest(F.size(F.filter(edge, lambda b: b <= F.col(id_))) - 1, F.lit(0))
    rows = rows.withColumn(part_, part).withColumn(bucket_, let(F.col(part_), bucket))
    order = [F.col(id_).desc(), F.col(digest_)]
    # the first row of each bucket, for the one before it. Of each part, the lowest bucket takes the first row of the next part that has any
    heads = rows.withColumn(nth_, F.row_number().over(W.partitionBy(bucket_).orderBy(*order))).where(F.col(nth_) == 1).drop(nth_)
    lowest = {r[0]: r[1] for r in rows.groupBy(part_).agg(F.min(bucket_)).collect()}  # ``parts`` rows at most
    above = [lowest[p] for p in sorted(lowest)]
    after = F.array(*[F.lit(b).cast("long") for b in above]) if above else F.array().cast("array<long>")
    within = F.lead(bucket_).over(W.partitionBy(part_).orderBy(bucket_))
    to = F.coalesce(within, F.get(F.filter(after, lambda b: b > F.col(bucket_)), F.lit(0)))
    heads = heads.withColumn(nth_, to).withColumn(copy_, F.when(F.col(nth_).isNull(), 2).otherwise(1)).withColumn(bucket_, F.coalesce(nth_, F.lit(above[0] if above else 0).cast("long"))).drop(nth_)
    both = rows.withColumn(copy_, F.lit(0)).unionByName(heads).withColumns(derived or {})
    down = W.partitionBy(bucket_).orderBy(copy_, *order)
    return both.withColumns({f"next_{c}": F.lead(c).over(down) for c in columns}).where(F.col(copy_) == 0).drop(id_, digest_, part_, bucket_, copy_)


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has the last third of the code points (rounded down)
    replaced by as many from the start of the next document.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "anchors"], {"anchors": anchors(F.col("text"))}).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars as int) - cast(floor(n_chars / 3) as int))"), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", "anchors", "next_anchors", F.sha2("edited", 256).alias("edited_sha256"), anchors(F.col("edited")).alias("edited_anchors"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
