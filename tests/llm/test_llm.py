"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from lodestone.llm import ann, base, bpe, components, fingerprints, licences, mixing, ngram_join, pii, quality, queries, sharding, substring_dedup

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and very long texts, ties and repeated rows.
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3), (5, "One", "en", None, 3),
    (6, "x" * 200_000, "en", "a", 200_000), (7, "word " * 30_000, "de", "b", 150_000), (8, "same text here again now", "en", "b", 24),
    (8, "same text here again now", "en", "b", 24), (9, "same text here again now", "en", "a", 24), (None, "no id at all in this row", "en", "b", 24), (10, "日本語 ünï \U0001f600", "ja", "c", 9),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(awkward):
    """The same rows with extra columns whose names the operators use themselves."""
    names = ["n", "name", "rep", "row", "key", "class", "salt", "size", "digest", "copies", "place", "gram", "component_id", "shard", "spans", "score", "_row", "id"]
    return awkward.withColumns({c: F.lit(c) for c in names})


def texts():
    return {i: t or "" for i, t in connect(SF).sql("SELECT doc_id, text FROM documents").fetchall()}


def components_of(links, nodes):
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# --- op1


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.no_padding()
    t.no_truncation()
    r = random.Random(1)
    letters = "ab '́éÉΣσς²½_-1٣日가\x1c\x1f\x85 İǅﬁ!?|<>endoftxs"
    rows = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|>a<|startoftext|> b", "x" * 30_000, "ab" * 500, ""]
    got = bpe.encode_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), VOCABULARY, with_digests=True)
    for row in got.collect():
        ids = t.encode(rows[row.doc_id], add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids)
        decoded = t.decode(ids, skip_special_tokens=False)
        assert row.decoded == decoded and row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    back = bpe.decode_documents(got.select("doc_id", "ids"), VOCABULARY).join(got.select("doc_id", F.col("decoded").alias("want")), "doc_id")
    assert back.where("decoded != want").isEmpty()


def test_cuts_never_lie_inside_a_token():
    own = bpe.tokenizer(bpe.read_vocabulary(VOCABULARY))
    assert 0 < own.joined.sum() < own.joined.size
    ids, ends = own.words(["hello", "qzxjq", "a"])
    assert ends[-1] == len(ids) and [own.names[i] for i in ids[ends[1] :]] == ["a</w>"]


# --- op2


def shingle_sets(rows, n):
    out = {}
    for i, t in rows.items():
        w = WORD(t.translate(FOLD))
        out[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return out


def jaccard_components(rows, n, p, q):
    sets = shingle_sets(rows, n)
    index = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    links = []
    for i, s in sets.items():
        for j, c in Counter(j for g in s for j in index[g] if j < i).items():
            if q * c >= p * (len(s) + len(sets[j]) - c):
                links.append((i, j))
    return sets, components_of(links, sets)


@pytest.mark.parametrize(("n", "p", "q"), [(4, 85, 100), (5, 8, 10)])
def test_ngram_join_equals_brute_force(spark, n, p, q):
    rows = texts()
    sets, want = jaccard_components(rows, n, p, q)
    got = ngram_join.join_ngrams(spark.read.parquet(f"{SF}/documents.parquet"), n, (p, q)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in rows}


def test_ngram_join_in_a_large_group_of_near_copies(spark, monkeypatch):
    """Chains of links, just above and below the threshold, with frequent n-grams known and not."""
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = {}
    for i in range(400):
        w = list(base if i % 5 else base[: r.randint(90, 120)])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"v{r.randrange(30)}"
        rows[i] = " ".join(w)
    rows |= {1000 + i: " ".join(f"u{r.randrange(40)}" for _ in range(r.randint(1, 12))) for i in range(200)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    sets, want = jaccard_components(rows, 4, 85, 100)
    for frequent in (2, 24, 10**9):
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        got = {x.doc_id: x.component_id for x in ngram_join.join_ngrams(df, 4, (85, 100)).collect()}
        assert got == want


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 150), (150, 120)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of(links, {n for link in links for n in link})
    assert got == want


# --- op3


def test_shards_are_exact_and_uniform(spark):
    df = spark.range(3000).withColumn("x", F.lit("same"))
    rows = sharding.shard_rows(df, 16).collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(by) == 16 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    low = Counter(r.shard for r in rows if r.id < 1500)
    assert sum((low[s] - 93.75) ** 2 / 46.9 for s in range(16)) < 45
    again = {r.id: (r.shard, r.slot) for r in sharding.shard_rows(df.repartition(3), 16).collect()}
    assert again == {r.id: (r.shard, r.slot) for r in rows}


def test_shards_of_the_query_and_of_clashing_columns(spark):
    rows = texts()
    got = queries.op3_sharding(spark, SF).collect()
    assert {r.doc_id for r in got} == set(rows) and len(got) == len(rows)
    for r in got:
        own = rows[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(own) + 1, zlib.crc32(own), "rows", None)
    of = Counter(r.shard for r in got)
    assert set(of) == set(range(16)) and max(of.values()) - min(of.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(16) for i in range(of[s])]
    names = ["id", "upto", "_block", "_c0", "_C1", "slot", "shard", "block", "n"]
    odd = spark.createDataFrame([[i] * len(names) for i in range(50)], names)
    dealt = sharding.shard_rows(odd, 4)
    assert dealt.columns == ["id", "upto", "_block", "_c0", "_C1", "block", "n", "shard", "slot"]
    assert sorted(r.id for r in dealt.collect()) == list(range(50)) and sorted(Counter(r.shard for r in dealt.collect()).values()) == [12, 12, 13, 13]


def test_hypergeometric_draws(spark):
    import math

    x = F.shiftrightunsigned(F.xxhash64(F.lit("t"), "id"), 11) / F.lit(float(1 << 53))
    got = {r.x: r.n for r in spark.range(40_000).groupBy(sharding.hypergeometric(F.lit(40), F.lit(13), F.lit(9), x).alias("x")).agg(F.count("*").alias("n")).collect()}
    want = {k: 40_000 * math.comb(13, k) * math.comb(27, 9 - k) / math.comb(40, 9) for k in range(10)}
    assert sum((got.get(k, 0) - w) ** 2 / w for k, w in want.items() if w > 5) < 32
    one = spark.range(1).select(*[sharding.hypergeometric(F.lit(n), F.lit(k), F.lit(m), F.lit(0.5)).alias(f"c{i}") for i, (n, k, m) in enumerate([(0, 0, 0), (5, 5, 3), (5, 0, 3), (10**9, 10**8, 10**7)])]).first()
    assert (one.c0, one.c1, one.c2) == (0, 3, 0) and abs(one.c3 - 10**6) < 5


# --- op4


def test_quality_learns_on_held_out_rows(spark):
    got = queries.op4_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = got.where("held_out").collect()
    assert len(rows) > 50 and np.mean([(r.predicted == r.quality) for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.collect())


def test_quality_gradient_equals_differences():
    r = np.random.default_rng(3)
    d, hidden, gate = 5, 4, 3
    shapes = {"E": (d, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "a": (gate,), "c": (hidden,), "b": ()}
    w = {k: r.normal(0, 0.7, s) for k, s in shapes.items()}
    model = quality.Model(np.zeros(d), np.ones(d), w)
    x, first, y = r.normal(size=(9, d)), np.array([0, 1, 5, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        p, _ = model.forward(x, first)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    got = quality.gradient(model, x, first, y)
    for k, s in shapes.items():
        for at in np.ndindex(s):
            old = np.array(w[k])
            ends = []
            for step in (1e-6, -1e-6):
                new = old.copy()
                new[at] += step
                w[k] = new
                ends.append(loss())
            w[k] = old
            assert abs((ends[0] - ends[1]) / 2e-6 - np.asarray(got[k])[at]) < 1e-6


def test_quality_takes_repeated_ids_and_awkward_tables(spark, awkward, empty, clashing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(8, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    for docs in (awkward, clashing):
        model = quality.train(docs, labels)
        again = quality.train(docs.repartition(3), labels)
        assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)
        assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.train(empty, labels).constant == 0.5


def test_quality_without_labels_of_both_kinds(spark, awkward):
    none = spark.createDataFrame([(4, None), (5, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(awkward, quality.train(awkward, none)).collect()} == {1.0}
    assert {r.score for r in quality.score(awkward, quality.train(awkward, none.limit(0))).collect()} == {0.5}


def test_passage_features_do_not_depend_on_the_batch():
    rows = ["a b c " * 100, "", "x", "long" * 5000, "é ü\n" * 70]
    data = "".join(rows).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in rows)])
    x, first = quality.passages(np.frombuffer(data, np.uint8), offsets)
    for i, t in enumerate(rows):
        own, f = quality.passages(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert np.allclose(own, x[first[i] : first[i + 1]]) and f[-1] == first[i + 1] - first[i]


# --- op5

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(PATTERNS[0], t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(PATTERNS[1], t) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, low, high in ((2, 12, 19), (3, 9, 15)):
        for m in re.finditer(PATTERNS[kind], t):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    r = random.Random(3)
    for letters in ["01259.", "a.@-b1", "+1 ()2-.9", "4012888 -1", "aA1@.+- (2)3"]:
        for _ in range(3000):
            t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(t) == plain_spans(t)
    for t in texts().values():
        assert pii.base_spans(t) == plain_spans(t)


def test_base_is_linear_in_long_runs():
    import time

    began = time.time()
    pii.base_spans("1" * 200_000 + " " + "1." * 50_000 + "a@" * 50_000 + "+1 " * 50_000)
    assert time.time() - began < 20


def test_field_adds_what_the_base_misses_and_keeps_the_rest():
    field = pii.train()
    found = ["call (212) 555-0147 after noon", "mail bob99 at mail dot example dot org today", "in 1999 there were 24 books", "plain words only"]
    base = [pii.base_spans(t) for t in found]
    more = pii.added_spans(found, base, field)
    assert [[pii.KINDS[k] for _, k, _ in s] for s in more] == [["phone"], ["email"], [], []]
    assert pii.redact("a x@y.org b", pii.base_spans("a x@y.org b")) == "a [email] b"


def test_spelled_out_addresses_without_a_digit_or_at_sign():
    rows = ["write to kim at example dot com or call", "her address is lee (at) mail.example.net since then", "plain words only", "", "we met them at the house"]
    more = pii.added_spans(rows, [pii.base_spans(t) for t in rows], pii.train())
    assert [[t[a:b] for a, _, b in s] for t, s in zip(rows, more)] == [["kim at example dot com"], ["lee (at) mail.example.net"], [], [], []]


def test_every_word_is_decoded():
    """Spans are those of a best path over the whole text with each word's features."""
    r = random.Random(8)
    field = pii.train()
    cues = "at dot (at) (dot) call phone kim mail.example.net 555-0147 (212) the of and house , 12 @home +1 x.y a1 2019 example com card".split()
    rows = [" ".join(r.choice(cues) if r.random() < 0.3 else r.choice("some plain words without any cue".split()) for _ in range(r.randint(0, 60))) for _ in range(300)]
    got = pii.added_spans(rows, [[]] * len(rows), field)
    for t, spans in zip(rows, got):
        w = t.split()
        x = np.array([field.emit[[field.index[f] for f in pii.features(w, i) if f in field.index]].sum(0) for i in range(len(w))]).reshape(-1, pii.N_LABELS)
        assert np.allclose(field.scores([w]), x)
        labels = field.viterbi([x])[0] if w else []
        assert [k for _, k, _ in sorted(spans)] == [int(k) for k in labels if k < len(pii.KINDS)]


def test_viterbi_equals_all_paths():
    import itertools

    r = np.random.default_rng(0)
    field = pii.Field({}, np.zeros((0, pii.N_LABELS)), r.normal(size=(pii.N_LABELS, pii.N_LABELS)))
    chains = [r.normal(size=(n, pii.N_LABELS)) for n in (1, 3, 4)]
    for x, got in zip(chains, field.viterbi(chains)):
        best = max(itertools.product(range(pii.N_LABELS), repeat=len(x)), key=lambda p: sum(x[i, k] for i, k in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got) == best


def test_the_join_runs_with_short_methods_and_leaves_the_session_as_it_was(spark, monkeypatch):
    seen, before = [], spark.conf.get("spark.sql.codegen.hugeMethodLimit")

    def noted(df):
        seen.append(int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")))
        return base.stored(df)

    monkeypatch.setattr(ngram_join, "stored", noted)
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")], "doc_id long, text string")
    got = ngram_join.join_ngrams(df)
    assert sorted((x.doc_id, x.component_id) for x in got.collect()) == [(1, 1), (2, 1), (3, 3)]
    assert seen and max(seen) <= base.METHOD_BYTES and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before


# --- op6


def test_passages_do_not_hang_on_other_columns_or_equal_rows(spark):
    r = random.Random(6)
    w = [f"w{r.randrange(400)}" for _ in range(400)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(30)] + w[40 * (i % 3) : 40 * (i % 3) + 90]), "x", 1, 2) for i in range(9)] * 2 + [(None, " ".join(w[:90]), "x", 1, 2), (20, None, "x", 1, 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, gram string, low int, id int")
    got = [sorted(map(tuple, substring_dedup.find_passages(df).collect())) for df in (odd, odd.select("doc_id", "text"), odd.select("doc_id", "text").distinct())]
    assert got[0] == got[1] == got[2] and {x[0] for x in got[0]} == set(range(9))


def test_passages_cover_every_exact_repeat(spark):
    rows = {i: WORD(t.translate(FOLD)) for i, t in texts().items()}
    r = random.Random(7)
    passage = [f"p{r.randrange(999)}" for _ in range(60)]
    # into texts that no other resembles: a passage is compared with its first holder only
    near = Counter(tuple(w[k : k + 8]) for w in rows.values() for k in range(len(w) - 7))
    alone = [i for i, w in rows.items() if len(w) > 60 and all(near[tuple(w[k : k + 8])] == 1 for k in range(len(w) - 7))]
    for i in alone[:4]:
        rows[i] = rows[i][:40] + passage + rows[i][40:]
    got = substring_dedup.find_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()
    spans = defaultdict(list)
    for x in got:
        assert x.n_words >= 50 and x.similarity >= 0.8
        spans[x.doc_id].append((x.start_word, x.end_word))
    seen = defaultdict(set)
    for i, w in rows.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add((i, k))
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                assert any(a <= k and k + 50 <= b for a, b in spans[i]), (i, k)


def apart(r, n, sizes, gaps):
    """Pairs of texts that share passages of ``sizes`` words with own words between, as many as ``gaps`` says for each."""
    out = []
    for _ in range(n):
        shared = [[f"p{r.randrange(9999)}" for _ in range(k)] for k in sizes]
        both = []
        for gap in gaps:
            w = [f"o{r.randrange(10**6)}" for _ in range(30)]
            for p in shared:
                w += p + [f"o{r.randrange(10**6)}" for _ in range(gap)]
            both.append(w)
        out.append(both)
    return out


def uncovered(spark, rows):
    """Places (document, word) of runs of 50 words in two documents that no passage of the document holds."""
    got = substring_dedup.find_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()
    spans, seen = defaultdict(list), defaultdict(set)
    for x in got:
        assert x.n_words >= 50 and x.similarity >= 0.8
        spans[x.doc_id].append((x.start_word, x.end_word))
    for i, w in rows.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add((i, k))
    return [(i, k) for places in seen.values() if len({i for i, _ in places}) > 1 for i, k in places if not any(a <= k and k + 50 <= b for a, b in spans[i])]


def test_two_passages_of_a_pair_are_both_found(spark):
    r = random.Random(11)
    rows = {}
    for sizes, gaps in [((60, 60), (40, 40)), ((60, 60), (80, 80)), ((60, 60), (100, 100)), ((60, 60), (0, 60)), ((100, 100), (100, 100)), ((60, 55, 70), (45, 90))]:
        for both in apart(r, 5, sizes, gaps):
            rows |= {len(rows) + k: w for k, w in enumerate(both)}
    assert uncovered(spark, rows) == []


def test_a_run_that_first_holders_have_cut_up_is_found(spark):
    r = random.Random(13)
    rows = {}

    def own(n):
        return [f"o{r.randrange(10**6)}" for _ in range(n)]

    for case in range(12):
        p = [f"p{case}x{i}" for i in range(50 + 2 * case)]
        half = len(p) // 2
        if case % 2:  # two holders of a half each
            texts_ = [own(30) + p[:half] + own(30), own(30) + p[half:] + own(30)]
        else:  # one holder with the pieces in another order
            texts_ = [own(20) + p[half:] + own(40) + p[:half] + own(20)]
        texts_ += [own(9) + p + own(30), own(41) + p[: len(p) - 8] + own(20), own(35) + p + own(12)]
        rows |= {len(rows) + k: w for k, w in enumerate(texts_)}
    assert uncovered(spark, rows) == []


def test_alike_passages_are_found_whose_seeds_others_held_first(spark):
    r = random.Random(17)
    rows, pairs = {}, []
    for case in range(6):
        p = [f"p{case}x{i}" for i in range(100)]
        for k in range(0, 85, 4):  # each seed is first in a text that has 20 words of it
            rows[len(rows)] = [f"o{r.randrange(10**6)}" for _ in range(15)] + p[k : k + 20] + [f"o{r.randrange(10**6)}" for _ in range(15)]
        pair = []
        for changed in ((33, 66), (34, 67)):
            w = [f"o{r.randrange(10**6)}" if i in changed else v for i, v in enumerate(p)]
            pair.append(len(rows))
            rows[len(rows)] = [f"o{r.randrange(10**6)}" for _ in range(20)] + w + [f"o{r.randrange(10**6)}" for _ in range(20)]
        pairs.append(tuple(pair))
    got = substring_dedup.find_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()
    found = {(x.other_doc_id, x.doc_id): x for x in got if x.kind == "passage"}
    for pair in pairs:
        assert pair in found and found[pair].n_words >= 50 and found[pair].similarity >= 0.8


def test_every_link_by_an_equal_run_shows_in_one_document(spark):
    r = random.Random(19)
    pieces = [[f"p{k}x{i}" for i in range(r.randrange(20, 90))] for k in range(14)]
    rows = {i: [f"o{i}x{k}" for k in range(12)] + [w for _ in range(4) for w in pieces[r.randrange(14)] + [f"o{r.randrange(10**6)}"] * r.randrange(2)] for i in range(40)}
    got = substring_dedup.find_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()
    spans, runs = defaultdict(list), defaultdict(set)
    for x in got:
        if x.kind == "passage":
            spans[x.other_doc_id, x.other_doc_id].append((x.other_start, x.other_end))
            spans[x.doc_id, x.other_doc_id].append((x.other_start, x.other_end))
    for i, w in rows.items():
        for k in range(len(w) - 49):
            runs[tuple(w[k : k + 50])].add((i, k))
    links = 0
    for places in runs.values():
        ids = {i for i, _ in places}
        if len(ids) > 1:
            links += 1
            assert any(all(any(a <= k and k + 50 <= b for a, b in spans[other, i]) for other in ids) for i, k in places), places
    assert links > 50


def test_spans_go_to_texts_without_a_forced_broadcast(spark, capsys):
    docs = spark.createDataFrame([(i, f"a b c {i}") for i in range(9)], "doc_id long, text string")
    classes = docs.select(F.col("doc_id").alias("rep"), F.lit(1).cast("long").alias("name"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = substring_dedup._Texts(docs, classes).with_spans(docs.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("lo"), F.lit(2).cast("long").alias("hi")))
        rows.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_minimisers_and_groups_against_plain_ones():
    r = np.random.default_rng(2)
    for t in range(600):
        h = r.integers(0, [3, 20, 1 << 40][t % 3], r.integers(0, 80)).astype(np.uint64)
        at, gram = substring_dedup.minimisers(h)
        g = base.shingles(h, substring_dedup.K) if len(h) >= substring_dedup.K else h[:0]
        w = min(substring_dedup.W, len(g))
        want = sorted({k + int(g[k : k + w].argmin()) for k in range(len(g) - w + 1)}) if len(g) else []
        assert at.tolist() == want and (gram == g[at]).all()
    for _ in range(200):
        rows = sorted((int(b), int(a)) for b, a in r.integers(0, 4, (r.integers(1, 50), 2)))
        x, y = r.integers(-60, 60, len(rows)), r.integers(0, 60, len(rows))
        cuts = np.unique(np.r_[0, r.integers(0, len(rows) + 1, 5), len(rows)])
        cols = [np.array([k for k, _ in rows]), np.array([k for _, k in rows]), x, y]
        batches = [pa.RecordBatch.from_arrays([pa.array(c[p:q]) for c in cols], names=list("baxy")) for p, q in zip(cuts[:-1], cuts[1:])]
        want = defaultdict(list)
        for key, p, q in zip(rows, x.tolist(), y.tolist()):
            want[key] += [(p, q)] if p >= 0 else [(-1 - p, q), (34 - p, q + 35)]
        want = {k: sorted(v) for k, v in want.items() if len(v) > 1 and all(max(z) - min(z) + substring_dedup.K >= 40 for z in zip(*v))}
        assert {(b, a): sorted(zip(p.tolist(), q.tolist())) for b, a, p, q in substring_dedup._grouped(iter(batches), 40, 35)} == want


def test_common_subsequence_and_chains():
    r = np.random.default_rng(1)
    for _ in range(40):
        a, b = r.integers(0, 4, r.integers(0, 12)), r.integers(0, 4, r.integers(0, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert substring_dedup.common(a, b) == table[-1, -1]
        x, y = r.integers(0, 30, 15), r.integers(0, 30, 15)
        best = {}
        for i in sorted(range(15), key=lambda i: (x[i], -y[i])):
            before = [best[j] - substring_dedup.GAP * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i]]
            best[i] = substring_dedup.K + max([0, *before])
        found = substring_dedup.chains(x, y)
        if max(best.values()) > substring_dedup.K:
            top = max(best, key=best.get)
            assert any(c[1] - substring_dedup.K == x[i] and c[3] - substring_dedup.K == y[i] for c in found[:1] for i in best if abs(best[i] - best[top]) < 1e-9)


# --- op7


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(900, 16)).round(2)
    v[100:300] = v[100]  # one very common vector
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] * 16), (2005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in ann.nearest(df.where("vec_id % 50 = 0"), df, 5, cell_rows=60, sample_rows=500).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    assert set(got) == set(range(0, 900, 50))
    hits = 0
    for q in got:
        score = ann.cosine(v, np.broadcast_to(v[q], v.shape))
        want = [int(i) for i in np.lexsort((np.arange(900), -score)) if i != q][:5]
        found = sorted(got[q])
        assert [k for k, *_ in found] == [1, 2, 3, 4, 5] and all(abs(s - score[i]) < 1e-12 for _, i, s in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits / (5 * len(got)) >= 0.9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert [x.vec_id for x in ann.nearest(few.where("vec_id = 0"), few, 5).collect()] in ([1, 2], [2, 1])
    assert ann.nearest(few.limit(0), few, 5).isEmpty() and ann.nearest(few, few.limit(0), 5).isEmpty()


def test_neighbours_of_extreme_equal_and_unlike_vectors(spark):
    schema = "vec_id long, embedding array<double>, v string, p int, size int, ids int, query int"
    rows = [(1, [1e-200, 0.0]), (2, [1e200, 1e200]), (3, [1.0, 1.0]), (4, [0.0, 5e-324]), (5, [1.0, 0.0, 0.0]), (6, [2.0, 0.0, 0.0]), (7, [-1e308, -1e308])]
    df = spark.createDataFrame([(*r, "a", 1, 2, 3, 4) for r in rows], schema)
    got = defaultdict(dict)
    for x in ann.nearest(df, df, 5).collect():
        got[x.query_id][x.rank] = (x.vec_id, x.score)
    half = 0.5**0.5
    for q, want in {1: {2: half, 3: half, 4: 0.0, 7: -half}, 2: {3: 1.0, 1: half, 4: half, 7: -1.0}, 4: {2: half, 3: half, 1: 0.0, 7: -half}, 5: {6: 1.0}}.items():
        order = sorted(want, key=lambda i: (-want[i], i))
        found = [got[q][k] for k in sorted(got[q])]
        assert [i for i, _ in found] == order and all(abs(s - want[i]) < 1e-12 for i, s in found)
    # ties at the last rank go to the smaller id, and each query row has an answer of its own
    ties = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(20)] + [(0, [1.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = sorted((x.rank, x.vec_id) for x in ann.nearest(ties.where("vec_id = 0"), ties, 5).collect())
    assert found == [(k, i) for k, i in enumerate((2, 4, 6, 8, 10), 1) for _ in range(2)]


def test_neighbours_of_all_queries_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    own = {r.vec_id: r.embedding for r in df.collect()}
    ids = np.array(sorted(own))
    m = np.array([own[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = defaultdict(set)
    for x in ann.nearest(df.where("vec_id % 50 = 0"), df, 5, cell_rows=64).collect():
        got[x.query_id].add(x.vec_id)
    hits = sum(len(got[q] & set([int(i) for i in ids[np.lexsort((ids, -(m @ m[np.searchsorted(ids, q)])))] if i != q][:5])) for q in got)
    assert set(got) == {int(i) for i in ids if i % 50 == 0} and hits >= 0.9 * 5 * len(got)


def test_chi_square():
    assert abs(ann.chi_square(np.array([15.507]), 8)[0] - 0.95) < 1e-4


# --- op8


def test_mix_equals_its_sql(spark):
    assert_same(spark, SF, queries.op8_mixing, queries.ORACLE_SQL["op8_mixing"])


def test_mix_targets_by_rounds_of_resharing(spark, awkward):
    r = random.Random(5)
    for _ in range(4):
        sizes = {f"s{i}": r.choice([0, 1, 10, 100, 5000]) for i in range(9)}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {x.source: x.target for x in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
        want, left, free = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
        while left > 1e-9 and free:
            total = sum(weight[s] for s in free)
            for s in free:
                want[s] += left * weight[s] / total
            left = sum(max(0, want[s] - 2 * sizes[s]) for s in free)
            full = {s for s in free if want[s] >= 2 * sizes[s]}
            for s in full:
                want[s] = 2.0 * sizes[s]
            free -= full
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix_comes_near_its_targets(spark):
    rows = queries.op8_mixing(spark, "/root/testdata/sf0.01").collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    target, taken = sum({(r.source_size, r.target) for r in rows} and [t for _, t in {(r.source_size, r.target) for r in rows}]), sum(r.taken for r in rows)
    assert abs(taken / target - 1) < 0.05


# --- op9


def positional(f, g):
    """Likeness of two fingerprints, in plain steps."""
    f, g = ([x[k : k + 8] for k in range(0, len(x), 8)] for x in (f, g))
    if f == g:
        return 1.0
    shift = [f.index(x) - g.index(x) for x in dict.fromkeys(f) if x in g]
    good = sum(any(abs(d - e) <= fingerprints.SHIFT for e in (0, *shift[max(0, k - 1) : k], *shift[k + 1 : k + 2])) for k, d in enumerate(shift))
    return good / len(set(f) | set(g))


@pytest.mark.parametrize("bucket_rows", [1, 3, 500])
def test_next_rows_whatever_the_buckets(spark, bucket_rows):
    """One id, and null ids, on a third of the rows each; the order is by falling id, then by the texts' digests."""
    r = random.Random(7)
    rows = [(r.choice([None, 5, r.randrange(-40, 40)]), f"text {i}" if i % 9 else None, "x") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _c0 string")
    digest = {x.text: x.d for x in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("d")).distinct().collect()}
    order = sorted(rows, key=lambda x: (-(-(1 << 63) if x[0] is None else x[0]), digest[x[1]]))
    want = Counter((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    got = fingerprints.with_next(df, ["text"], bucket_rows=bucket_rows)
    assert got.columns == ["doc_id", "text", "_c0", "next_text"]
    assert Counter((x.doc_id, x.text, x.next_text) for x in got.collect()) == want


def test_likeness_needs_positions_that_agree(spark):
    a = list(range(40))
    cases = {"same": (a, a, 1.0), "moved": (a, [*range(100, 120), *a], 40 / 60), "none": ([], [], 1.0), "empty": (a, [], 0.0), "scattered": (a, [x for i in range(4) for x in [*range(1000 + 50 * i, 1050 + 50 * i), 39 - 13 * i]], 0.0)}
    df = spark.createDataFrame([(k, x, y) for k, (x, y, _) in cases.items()], "name string, a array<int>, b array<int>")
    for x in df.select("name", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).collect():
        assert abs(x.near - cases[x.name][2]) < 1e-12


def test_edited_texts_and_neighbours(spark):
    rows = texts()
    order = sorted(rows, reverse=True)
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    got = {r.doc_id: r for r in queries.op9_syncmer_fingerprints(spark, SF).collect()}
    assert set(got) == set(rows)
    for i, t in rows.items():
        third = len(t) // 3
        edited = t[: len(t) - third] + rows[after[i]][:third]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_next - positional(got[i].fingerprint, got[after[i]].fingerprint)) < 1e-12
        assert abs(got[i].near_edited - positional(got[i].fingerprint, got[i].edited_fingerprint)) < 1e-12
    edited = spark.createDataFrame([(i, t[: len(t) - len(t) // 3] + rows[after[i]][: len(t) // 3]) for i, t in rows.items()], "doc_id long, text string")
    for r in edited.select("doc_id", fingerprints.fingerprint(fingerprints.anchors(F.col("text"))).alias("f")).collect():
        assert got[r.doc_id].edited_fingerprint == r.f
    assert np.mean([r.near_edited for r in got.values()]) > 0.3 > np.mean([r.near_next for r in got.values()])


def test_anchors_are_free_of_context(spark):
    r = random.Random(2)
    w = [f"t{r.randrange(500)}" for _ in range(300)]
    rows = [(0, " ".join(w)), (1, " ".join(["new", "head", *w])), (2, " ".join(w[:150] + ["edit"] + w[150:])), (3, " ".join(w))]
    a = {x.id: x.a for x in spark.createDataFrame(rows, "id long, text string").select("id", fingerprints.anchors(F.col("text")).alias("a")).collect()}
    assert a[0] == a[3] and set(a[0]) <= set(a[1]) and len(set(a[0]) - set(a[2])) <= 6
    digests = [x.h for x in spark.createDataFrame([(t,) for t in w], "t string").select(F.xxhash64("t").alias("h")).collect()]
    pairs = [x.h for x in spark.createDataFrame(list(zip(digests, digests[1:])), "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()]
    n = fingerprints.K - fingerprints.S + 1
    closed = sum(min(g) in (g[0], g[-1]) for g in (pairs[i : i + n] for i in range(300 - fingerprints.K + 1)))
    assert len(a[0]) == closed


def test_short_texts_have_fingerprints_of_their_own(spark):
    rows = [(100 * n + i, " ".join(f"t{n}x{i}y{j}" for j in range(n))) for n in range(1, 21) for i in range(20)] + [(0, ""), (1, " \n")]
    a = {x.id: x.a for x in spark.createDataFrame(rows, "id long, text string").select("id", fingerprints.anchors(F.col("text")).alias("a")).collect()}
    assert a.pop(0) == a.pop(1) == [] and all(a.values()) and len({tuple(x) for x in a.values()}) == len(a)


# --- op10


def test_licences_equal_their_sql(spark):
    assert_same(spark, SF, queries.op10_licence_scan, queries.ORACLE_SQL["op10_licence_scan"])


def test_licences_in_other_spellings(spark):
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + licences.KNOWN[0][1].upper().replace(",", " ;")), (2, "RELEASED under the mit LICENCE"), (3, "Some prose.\nAll rights reserved.\nMore prose."),
        (4, licences.KNOWN[0][1] + " and more"), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
    ]
    whole = dict(licences.KNOWN[k] for k in range(len(licences.KNOWN)) if len(licences.KNOWN[k][1]) > 300)
    for k, (name, text) in enumerate(sorted(whole.items())):
        words = text.split(" ")  # set in short lines, as files have it
        wrapped = "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
        for j, head in enumerate(["Copyright Jane Doe", "Copyright (c) Jane Doe and others", "(c) 1999, 2003 J. Doe", "  © The Authors", ""]):
            rows.append((1000 + 10 * k + j, f"{head}\n\n{wrapped}"))
    got = {r.doc_id: (r.licence, r.notices, r.n_notices) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, name in enumerate(sorted(whole)):
        assert [got[1000 + 10 * k + j][0] for j in range(5)] == [name] * 5
    assert got[1][0] == "MIT" and got[2] == ("MIT", "MIT", 1) and got[3] == (None, "all-rights-reserved", 1)
    assert got[4][0] is None and got[5] == got[6] == (None, "", 0) and got[7] == (None, "CC-BY-NC-4.0,MIT", 2)


# --- awkward tables


OPERATORS = {
    "bpe": lambda d: bpe.encode_documents(d, VOCABULARY),
    "ngram_join": lambda d: ngram_join.join_ngrams(d),
    "shard_rows": lambda d: sharding.shard_rows(d, 16),
    "quality": lambda d: quality.score(d, quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), {}, 0.5)),
    "keep_good": lambda d: quality.keep_good(d, quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), {}, 1.0)),
    "pii": lambda d: pii.find_personal(d),
    "redact": lambda d: pii.redact_documents(d),
    "mix": lambda d: mixing.mix_sources(d),
    "fingerprints": lambda d: fingerprints.compare_with_edited(d),
    "licences": lambda d: licences.scan_licences(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, awkward, empty, clashing):
    for df in (awkward, clashing):
        assert len(OPERATORS[name](df).collect()) == len(AWKWARD)
    assert OPERATORS[name](empty).isEmpty()


def test_awkward_results(awkward, empty, clashing):
    joined = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_ngrams(awkward).collect()}
    assert {(1, 0, 1), (2, 0, 2), (4, 1, 4), (5, 1, 4), (8, 1, 8), (9, 1, 8)} <= joined
    kept = ngram_join.keep_one(clashing, ngram_join.join_ngrams(clashing))
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 6, 7, 8, 10)] + [(True, 0)]
    assert substring_dedup.find_passages(empty).isEmpty() and substring_dedup.find_passages(awkward).isEmpty()
    drawn = mixing.draw(clashing)
    assert drawn.columns == clashing.columns and drawn.count() == mixing.mix_sources(clashing).agg(F.sum("copies")).first()[0]


def test_a_hot_id_stays_one_document(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g")] * 300 + [(i, f"text number {i} with some words") for i in range(2, 60)], "doc_id long, text string")
    assert ngram_join.keep_one(rows, ngram_join.join_ngrams(rows)).count() <= 59
    assert len(sharding.shard_rows(rows, 4).collect()) == rows.count()


# --- pipeline


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = cp.stored(cp.good_quality(spark, docs, sf))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns
    assert np.mean([(i in kept) == (q == 1) for i, q in labels.items()]) > 0.95
    one = cp.stored(cp.near_duplicates(spark, good, sf))
    _, want = jaccard_components(kept, 5, 8, 10)
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, c in want.items() if i == c)
    clean = cp.stored(cp.personal_data(spark, one, sf))
    assert clean.columns == docs.columns and not any(plain_spans(r.text) for r in clean.collect())
    assert clean.where("n_chars != char_length(text)").isEmpty()
    drawn = cp.stored(cp.mixed(spark, clean, sf))
    assert drawn.columns == docs.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter({r.doc_id: r.copies for r in mixing.mix_sources(clean).where("copies > 0").collect()})
    made = cp.tokens(spark, drawn, sf)
    assert made.count() == drawn.count()


@pytest.mark.parametrize("table", ["awkward", "clashing", "empty"])
def test_pipeline_stages_on_awkward_tables(spark, request, table):
    import corpus_pipeline as cp

    docs = request.getfixturevalue(table)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        rows = out.count()
        if name != "tokens":
            assert out.columns == docs.columns
        assert rows == 0 if table == "empty" else rows <= 2 * len(AWKWARD)
    if table != "empty":
        assert cp.near_duplicates(spark, docs, SF).count() == 9 and cp.personal_data(spark, docs, SF).count() == len(AWKWARD)
