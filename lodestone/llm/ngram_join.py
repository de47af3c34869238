"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

A document is the set of its n-word shingles. Two documents link when their
sets' Jaccard coefficient reaches a threshold. Results are exact.

The incidence matrix (documents by n-grams) is cut by size-derived bounds: in
one fixed order of all n-grams, rare ones first, a document of n shingles keeps
only its first n - ceil(t n) + 1. Documents that link share one of those. The
product of this matrix with its transpose, taken block by block as a join on
the n-gram and a sum for each pair of documents, counts shared n-grams; a pair
whose count, and all that it could still share beyond, stays below the bound
that the two sizes set is dropped; so is one whose sizes, or the places of the
first shared n-gram in both, or what stands in their lists after it, or their
sketches' difference, leave too little to share. Of a pair, the smaller
document needs fewer n-grams still, n - ceil(2 t n / (1 + t)) + 1. What is left
is checked on the full sets.

No pair is made within groups that are known to hang together:
1. documents with equal sets form a class, and one stands for all;
2. each class is checked against the smallest partner that shares most with it
   (one link for each class), and components are formed;
3. the full product then only pairs classes of different components.
Every link between two components is found in step 3, so components are exact.

The order of n-grams only steers the work: counts of frequent n-grams come from
all texts, and the most frequent ``KNOWN_GRAMS`` go last in the order, the
others stand in hash order. N-grams and sets are told apart by 64-bit digests.

Null texts count as empty. A document without words links with nothing; one
with fewer words than n has its whole word sequence as its one shingle. Very
long texts are sets like others, whatever their size. Repeated rows each give
a row; rows with one id count as one document, and rows without an id belong
to no class. Of documents that share equally much, the smaller digest is the
partner, which changes no component. An empty table gives an empty result.
Other columns of the documents are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import U64, Repeated, Words, clean, discard, long_array, mix, shingles, short_methods, steps, stored, unused
from .components import connected_components

#: N-grams with a known count (8 bytes each in every worker), and how often one must be found to be among them.
KNOWN_GRAMS, FREQUENT = 200_000, 24
#: Shingles that are sorted at once to find frequent ones.
COUNTED_AT_ONCE = 4_000_000
#: Rows of one frequent n-gram that stay together while the lists are made.
LIST_ROWS = 512
#: Up to so many ids (8 bytes each) go to the executors by broadcast, beyond by a shuffle join.
BROADCAST_IDS = 1_000_000


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words = Words(data, offsets)
    h = words.hashes()
    for a, b in zip(words.first[:-1], words.first[1:]):
        yield np.unique(shingles(h[a:b], n))


def _name(grams: np.ndarray) -> int:
    """A digest of a whole set."""
    return int(mix(np.array([mix(grams).sum(dtype=U64) + U64(len(grams))], U64)).view(np.int64)[0]) if len(grams) else 0


#: 64-bit words of a set's short sketch.
SKETCH = 4


def _sketch(grams: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """For each bit, whether an odd number of n-grams falls on it: two sets differ in as many n-grams as bits, at least."""
    odd = np.bincount((grams >> U64(17)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _wide(grams: np.ndarray) -> bytes:
    """A sketch of two to four bits for each n-gram."""
    return _sketch(grams, max(SKETCH, 1 << max(0, 2 * len(grams) - 1).bit_length() >> 6)).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """In how many n-grams two sets differ at least, by their wide sketches; the longer one is folded to the other's size."""
    x, y = sorted((np.frombuffer(x, U64), np.frombuffer(y, U64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)).sum())


def _read(n: int):
    """(doc_id, text) to rows of two kinds: documents (doc_id, n, set, sketch), and frequent n-grams (gram, n)."""
    names = ["doc_id", "n", "name", "gram", *(f"s{i}" for i in range(SKETCH)), "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, seen = Repeated(COUNTED_AT_ONCE), set()

        def frequent(grams: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(grams), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(count.astype(np.int64)), none, long_array(grams), *[none] * SKETCH, pa.nulls(len(grams), pa.binary())], names=names)

        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                count, name, sketch, wide = [], [], [], []
                for grams in _sets(data, offsets, n):
                    count.append(len(grams))
                    sketch.append(_sketch(grams))
                    wide.append(_wide(grams))
                    name.append(_name(grams))
                    if len(grams) and name[-1] not in seen:
                        seen.add(name[-1])
                        for found in counted.add(grams):
                            yield frequent(*found)
                            seen.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(count, pa.int64()), pa.array(name, pa.int64()), pa.nulls(b - a, pa.int64()), *map(pa.array, np.array(sketch).T), pa.array(wide, pa.binary())], names=names)
        if counted.size:
            yield frequent(*counted.take())

    return run


def _list(n: int, least: tuple[int, int], known):
    """(doc_id, text) to the cut incidence matrix: (gram, salt, rare, at, n, id).

    ``id`` is the digest of the whole set, ``n`` its size. ``salt`` is 0 but for
    n-grams with a known count, ``at`` the n-gram's place in the document's order,
    ``rare`` how many n-grams without a known count it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_known, counts_known = known.value
        grams_known, counts_known = grams_known.view(U64), np.r_[counts_known, 0]
        seen: set[int] = set()
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                ids = batch.column(0)[a:b].to_pylist()
                gram, salt, rare, place, size, own = [], [], [], [], [], []
                for doc_id, grams in zip(ids, _sets(data, offsets, n)):
                    if not len(grams) or doc_id is None or (name := _name(grams)) in seen:
                        continue
                    seen.add(name)
                    keep = len(grams) - -(-len(grams) * least[0] // least[1]) + 1
                    at = np.searchsorted(grams_known, grams)
                    known_here = at < len(grams_known)
                    known_here[known_here] = grams_known[at[known_here]] == grams[known_here]
                    count = counts_known[np.where(known_here, at, len(grams_known))]
                    first = np.argsort(count, kind="stable")[:keep]
                    c = count[first]
                    gram.append(grams[first])
                    salt.append(np.where(c > 0, 1 + name % (1 + c // LIST_ROWS), 0))
                    rare.append(np.full(len(first), np.count_nonzero(count == 0)))
                    place.append(np.arange(len(first)))
                    size.append(np.full(len(first), len(grams)))
                    own.append(np.full(len(first), name))
                if gram:
                    yield pa.RecordBatch.from_arrays(
                        [long_array(np.concatenate(gram)), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (salt, rare, place, size)), pa.array(np.concatenate(own).astype(np.int64))],
                        names=["gram", "salt", "rare", "at", "n", "id"],
                    )

    return run


def _sized(n_a: Column, n_b: Column, least: tuple[int, int]) -> Column:
    return least[1] * F.least(n_a, n_b) >= least[0] * F.greatest(n_a, n_b)


def _kept(n: Column, least: tuple[int, int]) -> Column:
    """How many n-grams a document keeps."""
    return n - F.ceil(n * least[0] / least[1]) + 1


def _kept_as_smaller(n: Column, least: tuple[int, int]) -> Column:
    """How many it needs against documents that are as large or larger: those share at least 2t / (1 + t) of it."""
    return n - F.ceil(n * (2 * least[0]) / sum(least)) + 1


def _may_share(a: str, b: str, least: tuple[int, int]) -> Column:
    """Whether two documents can share as much as a link needs.

    ``most`` is a size less the rare n-grams that nobody else lists. Where the
    other document lists all its rare ones (``covers``) it can't hold those.
    """
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    of_a = F.when(F.col(f"covers_{b}"), F.col(f"most_{a}")).otherwise(n_a)
    of_b = F.when(F.col(f"covers_{a}"), F.col(f"most_{b}")).otherwise(n_b)
    return sum(least) * F.least(of_a, of_b) >= least[0] * (n_a + n_b)


def _may_reach(shared: Column, n_a: Column, n_b: Column, least: tuple[int, int]) -> Column:
    """Whether a pair that shares so many of its kept n-grams may still link.

    The document whose kept n-grams end first in the order shares, besides the
    counted ones, at most what it didn't keep.
    """
    rest = F.ceil(F.greatest(n_a, n_b) * least[0] / least[1]) - 1
    return (shared + rest) * sum(least) >= least[0] * (n_a + n_b)


def _may_be_first(least: tuple[int, int]) -> Column:
    """Whether an n-gram may be the first that two documents share, if they link.

    The one before it must not be the same in both lists. All that they share
    then stands from here on in both (``behind``). Of the two, the one whose kept
    n-grams end first in the order shares no others of them than those listed
    from here on, and at most all that it didn't keep (``reach``). So the rows of
    later shared n-grams need not be made.
    """
    needed = least[0] * (F.col("n_a") + F.col("n_b"))
    after = F.coalesce(F.col("before_a") != F.col("before_b"), F.lit(True))
    return after & (sum(least) * F.least("behind_a", "behind_b") >= needed) & (sum(least) * F.greatest("reach_a", "reach_b") >= needed)


def _sketches_allow(least: tuple[int, int]) -> Column:
    """Whether two documents differ little enough, as far as their sketches tell."""
    apart = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(SKETCH)), F.lit(0))
    both = F.col("n_a") + F.col("n_b")
    return F.coalesce(sum(least) * (both - apart) >= 2 * least[0] * both, F.lit(True))


class _Sets:
    """Checks pairs of classes on their full shingle sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, least: tuple[int, int], once: bool):
        """``once``: no id stands on two rows."""
        self.docs, self.classes, self.n, self.least, self.once = docs, classes, n, least, once
        self.made: list[DataFrame] = []

    def _of(self, ids: DataFrame) -> DataFrame:
        """(id, grams) of the classes ``ids``; the text must be the class's own."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, offsets in steps(batch.column(1)):
                    made = list(_sets(data, offsets, n))
                    out = pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([g.tobytes() for g in made], pa.binary())], names=["id", "grams"])
                    yield out.filter(pa.array([_name(g) == w for g, w in zip(made, batch.column(0)[a:b].to_pylist())], pa.bool_()))

        wanted = stored(ids.distinct().join(self.classes.select("id", "rep"), "id"))
        self.made.append(wanted)
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        texts = self.docs.join(wanted, self.docs["doc_id"] == wanted["rep"]).select("id", "text")
        made = texts.mapInArrow(run, "id long, grams binary")
        return made if self.once else made.dropDuplicates(["id"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        p, q = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(q * shared >= p * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(c.to_pylist() for c in batch.columns[2:]))
                yield batch.select(["a", "b"]).filter(pa.array([(p + q) * (m + n - _apart(x, y)) >= 2 * p * (m + n) for m, x, n, y in rows], pa.bool_()))

        # sketches are a small part of the sets, which only travel for pairs that those don't tell apart
        of_a, of_b = (self.classes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("wide").alias(f"wide_{s}")) for s in "ab")
        pairs = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "n_a", "wide_a", "n_b", "wide_b")
        pairs = stored(pairs.mapInArrow(near, "a long, b long"))
        self.made = [pairs]
        of_a = self._of(pairs.select(F.col("a").alias("id"))).select(F.col("id").alias("a"), F.col("grams").alias("x"))
        of_b = self._of(pairs.select(F.col("b").alias("id"))).select(F.col("id").alias("b"), F.col("grams").alias("y"))
        both = pairs.select("a", "b").join(of_b, "b").join(of_a, "a").select("a", "b", "x", "y")
        out = stored(both.mapInArrow(run, "a long, b long").distinct())
        discard(*self.made)
        return out


def join_ngrams(docs: DataFrame, n: int = 5, least: tuple[int, int] = (8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, class_id (smallest id with an equal set), component_id (smallest id reached by links).

    Documents link when the Jaccard coefficient of their ``n``-word shingles
    (A-Z in lower case) is at least ``least[0] / least[1]``.
    """
    with short_methods(docs.sparkSession):
        return _joined(clean(docs, id_col, text_col), n, least)


def _joined(docs: DataFrame, n: int, least: tuple[int, int]) -> DataFrame:
    spark = docs.sparkSession
    sketch = [f"s{i}" for i in range(SKETCH)]
    read = stored(docs.mapInArrow(_read(n), "doc_id long, n long, name long, gram long" + "".join(f", {c} long" for c in sketch) + ", wide binary"))
    rows = read.where("gram IS NULL").select("doc_id", "n", F.when(F.col("n") > 0, F.col("name")).alias("id"), *sketch, "wide")
    # equal sets have equal digests, and one id
    classes = rows.where("id IS NOT NULL AND doc_id IS NOT NULL").groupBy("id").agg(F.min("n").alias("n"), F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in (*sketch, "wide")])
    classes = stored(classes)
    # ids that several rows share, and links between their texts
    repeated = stored(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("high"), F.count("*").alias("rows")).where("rows > 1"))
    same_id = rows.join(repeated.where("a != high"), "doc_id").where("id != a").select("a", F.col("id").alias("b")).distinct()

    # a fixed number of rows at most
    frequent = read.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "gram").limit(KNOWN_GRAMS).toArrow()
    grams = frequent["gram"].to_numpy().view(U64)
    order = np.argsort(grams)
    known = spark.sparkContext.broadcast((grams[order].view(np.int64), frequent["n"].to_numpy()[order]))

    # one row for each set and n-gram. N-grams of one set only go; a frequent n-gram was found in three, and stays
    entries = docs.mapInArrow(_list(n, least, known), "gram long, salt int, rare int, at int, n int, id long")
    alike = W.partitionBy("gram", "salt").orderBy("id")
    whole = alike.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    entries = entries.withColumns({"low": F.min("id").over(whole), "high": F.max("id").over(whole), "last": F.lag("id").over(alike)})
    entries = entries.where("(salt > 0 OR low != high) AND NOT last <=> id").select("gram", "id", "n", "at", "rare", (F.col("salt") > 0).alias("frequent"))
    kept = _kept(F.col("n"), least)
    listed = F.count_if(~F.col("frequent")).over(W.partitionBy("id"))
    down = W.partitionBy("id").orderBy("at")
    left, before = F.count("*").over(down.rowsBetween(0, W.unboundedFollowing)).cast("int").alias("left"), F.lag("gram").over(down).alias("before")
    entries = stored(entries.select("gram", "id", "n", "at", "frequent", left, before, (F.col("n") - F.least(F.col("rare"), kept) + listed).alias("most"), (F.col("rare") <= kept).alias("covers")))

    def beside(df: DataFrame, **of: Column) -> DataFrame:
        """Aggregates over each n-gram's rows, beside them; the rows of frequent ones don't meet in one task for it."""
        rare, many = df.where("NOT frequent"), df.where("frequent")
        own = W.partitionBy("gram")
        return rare.withColumns({k: v.over(own) for k, v in of.items()}).unionByName(many.join(many.groupBy("gram").agg(*[v.alias(k) for k, v in of.items()]), "gram"))

    sets = _Sets(docs, classes, n, least, once=repeated.isEmpty())
    # each class against one partner: of the most typical members of its lists, the one with which it shares most
    typical = F.struct((~F.col("covers")).alias("no"), ((F.col("n") - F.col("most")) / F.col("n")).alias("lone"), "id", "n", "most", "covers")
    lists = beside(entries, m=F.min(typical)).withColumnsRenamed({"n": "n_b", "most": "most_b", "covers": "covers_b"})
    stars = (
        lists.select(F.col("id").alias("b"), "n_b", "most_b", "covers_b", F.col("m.id").alias("a"), *[F.col(f"m.{c}").alias(f"{c}_a") for c in ("n", "most", "covers")])
        .where((F.col("b") != F.col("a")) & _sized(F.col("n_a"), F.col("n_b"), least) & _may_share("a", "b", least))
        .groupBy("a", "n_a", "b", "n_b").agg(F.count("*").alias("shared"))
        .where(_may_reach(F.col("shared"), F.col("n_a"), F.col("n_b"), least))
        .groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    )
    of_a, of_b = (classes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in sketch]) for s in "ab")
    star_links = sets.links(stars.join(of_a, "a").join(of_b, "b").where(_sketches_allow(least)).select("a", "b"))
    star_links = stored(star_links.union(same_id))
    found = connected_components(star_links)

    # the product, between different components; of a pair, a is the smaller
    parts = entries.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    parts = beside(parts, low=F.min("part"), high=F.max("part")).where("low != high").drop("low", "high")
    # all that the condition needs is put in columns, so that its code stays small
    n = F.col("n").cast("long")
    parts = parts.select("gram", "id", n.alias("n"), "before", F.col("most").cast("long").alias("most"), "covers", "part", (n - F.col("at")).alias("behind"), (F.col("left") + n - kept).cast("long").alias("reach"), (F.col("at") < _kept_as_smaller(n, least)).alias("early"))
    parts = stored(parts.join(classes.select("id", *sketch), "id"))
    discard(found)
    carried = ["id", "n", "behind", "reach", "before", "most", "covers", "part", *sketch]
    left, right = (df.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in carried]) for s, df in (("a", parts.where("early")), ("b", parts)))
    smaller = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b"))
    allowed = smaller & (F.col("part_a") != F.col("part_b")) & _sized(F.col("n_a"), F.col("n_b"), least) & _may_share("a", "b", least) & _may_be_first(least) & _sketches_allow(least)
    pairs = stored(left.join(right, "gram").where(allowed).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())
    discard(parts)
    # how many of their kept n-grams the pairs share; a document's are few, so they travel instead of its set
    paired = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    listed = stored(entries.join(paired, "id").groupBy("id", "n").agg(F.collect_list("gram").alias("grams")))
    of_a, of_b = (listed.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("grams").alias(f"grams_{s}")) for s in "ab")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    more = sets.links(pairs.join(of_a, "a").join(of_b, "b").where(_may_reach(shared, F.col("n_a"), F.col("n_b"), least)).select("a", "b"))
    discard(entries, pairs, listed)
    found = connected_components(star_links.union(more))
    discard(star_links, more)
    # a component's name is a digest; its smallest document stands for it
    named = classes.select("id", "rep").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = stored(named.join(smallest, "component").select("id", "rep", "component_id"))
    discard(found, classes, repeated)
    return rows.select("doc_id", "n", "id").join(named, "id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        # a row without a set, or without an id, is alone
        *[F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(new) for c, new in (("rep", "class_id"), ("component_id", "component_id"))],
    )


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all columns, one for each component of ``groups`` (as of ``join_ngrams``).

    The document with the smallest id stays; of rows that share an id one
    stays. Rows without an id belong to no group, and stay.
    """
    id_, many_, row_ = unused(docs, 3)
    seen = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(id_)).agg((F.count("*") > 1).alias(many_))
    seen = stored(seen)
    few = F.broadcast(seen) if seen.count() <= BROADCAST_IDS else seen
    key = F.col(f"`{id_col}`").cast("long")
    joined = docs.join(few, key == F.col(id_))
    once = joined.where(~F.col(many_)).select(*[F.col(f"`{c}`") for c in docs.columns])
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    # the least digest of an id's rows, found by partial sums, so that no task holds them all
    many = joined.where(F.col(many_)).groupBy(id_).agg(F.min_by(rows, digest).alias(row_)).select(*[F.col(f"{row_}.`{c}`").alias(c) for c in docs.columns])
    out = once.unionByName(docs.where(key.isNull()))
    return out.unionByName(many) if not seen.where(many_).isEmpty() else out
