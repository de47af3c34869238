import hashlib
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import content, dataset, names
from lodestone.operators import blocks, inventory, ledger, models
from lodestone.operators import economics as eco
from lodestone.plans import planner
from lodestone.sources import files, tables
from lodestone.streaming import watch


def test_quote_vectors(spark):
    gib = 1 << 30
    rows = spark.createDataFrame([("a", "compress", "fast", gib, 8 * gib), ("a", "compress", "max", 2 * gib, 0), ("b", "compress", "fast", 0, 40 << 20)], "tenant_id string, operation string, effort string, bytes_in long, bytes_saved long")
    got = {r.tenant_id: (r.micro_cents, r.cents) for r in ledger.quote_savings(rows).collect()}
    assert got["a"] == (28_800_000, 29) and got["b"][0] > 0 and got["b"][1] == 0
    assert {r.tenant_id: r.cents for r in ledger.quote_ingested(rows).collect()}["a"] == 3350


def test_price_config_defaults(spark):
    rows = spark.createDataFrame([("a", "ingested_gb", '{"fast": 1}'), ("b", "what", "no json")], "id string, plan string, price_config string")
    got = {r.id: r for r in ledger.price_config(rows).collect()}
    assert (got["a"].plan, got["a"].fast, got["a"].max) == ("ingested_gb", 1.0, 1600.0)
    assert (got["b"].plan, got["b"].share_percent) == ("savings_share", 30.0)


def test_window_defaults():
    assert tables.default_window(1000, days=0) == (1001 - 86_400_000, 1001)
    assert tables.default_window(1000, start=5000) == (1001, 1001)


def test_idempotent_keeps_events_without_a_key(spark):
    rows = spark.createDataFrame([(1, "t", "k"), (2, "t", "k"), (3, "t", None), (4, "t", None), (5, "u", "k")], "event_id long, tenant_id string, idempotency_key string")
    assert sorted(r.event_id for r in ledger.idempotent(rows).collect()) == [1, 3, 4, 5]
    assert [(r.event_id, r.first_event_id) for r in ledger.replayed(rows).collect()] == [(2, 1)]


def test_keys_and_scopes(spark):
    keys = spark.createDataFrame([("k1", "t", "s", 5, None, "read,admin"), ("k2", "t", "s", None, 3, "read"), ("k3", "t", "s", None, None, "read")], "key_id string, tenant_id string, key_hash string, expires_at_ms long, revoked_at_ms long, scopes string")
    assert {r.key_id for r in ledger.usable_keys(keys, 4).collect()} == {"k1", "k3"} and {r.key_id for r in ledger.usable_keys(keys, 6).collect()} == {"k3"}
    assert {r.key_id for r in keys.where(ledger.has_scope(F.col("scopes"), "compress")).collect()} == {"k1"}


def test_histogram_skips_what_is_no_time(spark):
    rows = spark.createDataFrame([("x", 0.5), ("x", 1.0), ("x", 7.0), ("x", -1.0), ("x", float("nan")), ("x", 1e9)], "operation string, cpu_ms double")
    got = {r.le: (r.n, r.cumulative) for r in ledger.latency_histogram(rows).collect()}
    assert got["1"] == (2, 2) and got["10"] == (1, 3) and got["+Inf"] == (1, 4) and len(got) == 13


def test_footer_faults(spark):
    files_ = spark.createDataFrame([(1, 2, 150, 157, 100), (2, 2, 150, 157, 100), (3, 0, 0, 7, 100)], "id int, n_blocks int, original_size long, payload_end long, block_size long")
    rows = spark.createDataFrame([(1, 0, 7, 100, 100), (1, 1, 107, 50, 50), (2, 0, 7, 50, 50), (2, 1, 57, 100, 100)], "id int, block int, offset long, stored_len long, original_len long")
    assert {r.id: r.fault for r in inventory.footer_faults(rows, files_, "id", "block_size").collect()} == {1: None, 2: "short_block_inside", 3: None}


def test_greedy_families(spark):
    rows = spark.createDataFrame([(1, "a", "x", 10), (2, "a", "x", 12), (3, "b", "x", 11), (4, "b", "y", 100), (5, "b", "y", 10)], "id int, k1 string, k2 string, size long")
    got = {(r.id, r["pass"]) for r in inventory.families_greedy(rows, [F.col("k1"), F.col("k2")], "id", "id", "size").collect()}
    assert got == {(1, 0), (2, 0)}


def test_cores_needed_is_a_fixed_point(spark):
    row = spark.range(1).select(eco.cores_needed(F.lit(1929.0), F.lit(510.0), [(1, 1.0)]).alias("one"), eco.cores_needed(F.lit(8000.0), F.lit(400.0)).alias("n")).first()
    assert abs(row.one - 3.7824) < 1e-3
    e = spark.range(1).select(eco.efficiency(F.lit(row.n)).alias("e")).first().e
    assert abs(row.n - 8000 / (400 * e)) < 1e-6


def test_classes_of_made_up_contents(spark):
    rows = files.synthetic(spark, 12, 16 * 1024).withColumn("p", content.profile("content"))
    text = F.decode("content", "ISO-8859-1")
    rows = rows.withColumn("mime", content.effective_mime(F.lit("x"), F.lit(""), F.col("p.printable")))
    got = {(r.kind, r["class"]) for r in rows.select("kind", content.content_class(F.col("content"), text, F.col("mime"), F.col("p")).alias("class")).collect()}
    assert {("random", "incompressible"), ("csv", "tabular"), ("i64", "numeric_binary")} <= got


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.range(400).selectExpr("id", "'c' AS class", "id % 7 + 1 AS a", "id % 11 + 5 AS b")
    one = blocks.bootstrap_ratio(rows.coalesce(1), "class", ["id"], "a", "b", 50).first()
    two = blocks.bootstrap_ratio(rows.repartition(7), "class", ["id"], "a", "b", 50).first()
    assert (one.low, one.ratio, one.high) == (two.low, two.ratio, two.high) and one.low < one.ratio < one.high


def test_watch_sees_new_changed_touched_and_gone(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for n in ("a", "b", "c", ".hidden", "x.tmp"):
        (d / n).write_text(n)
    seen = watch.empty_seen(spark)

    def one(seen):
        events, after = watch.run_round(spark, str(d), seen)
        got = {(r.path.rsplit("/", 1)[1], r.event) for r in events.collect()}
        return got, spark.createDataFrame(after.collect(), watch.SEEN)

    got, seen = one(seen)
    assert got == {("a", "new"), ("b", "new"), ("c", "new")}
    assert one(seen)[0] == set()
    time.sleep(1.1)
    (d / "a").write_text("other")
    (d / "b").touch()
    (d / "c").unlink()
    got, seen = one(seen)
    assert got == {("a", "changed"), ("c", "gone")}
    assert one(seen)[0] == set()


def test_watch_query_runs_rounds(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a").write_text("a")
    got = []
    watch.watch(spark, str(d), str(tmp_path / "seen"), lambda df, epoch: got.extend((epoch, r.event) for r in df.collect()), str(tmp_path / "check"), seconds=1, rounds=2)
    assert got[0] == (0, "new") and len(got) == 1


def test_stable_needs_three_equal_sizes(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("a", 2, 4), ("b", 5, 1), ("b", 5, 2)], "path string, size long, taken_ms long")
    assert [(r.path, r.size) for r in watch.stable(rows).collect()] == [("a", 2)]


def test_everything_works_without_the_corpus_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['lodestone.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'usage_totals' in e.queries() and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0]).returncode == 0


def test_names_of_versions_become_one(spark):
    same = [
        ["report-v1.txt", "report-v2.10.txt", "report_v3.txt".replace("_", "-")], ["scan 2024-01-02.pdf", "scan 2023_12_31.pdf", "scan 20240102.pdf", "scan 2024-01-02t10:30:59.pdf"],
        ["notes.md", "notes (2).md", "notes-copy.md", "notes_final.md", "Notes_OLD.md"], ["lib-1.2.3", "lib-1.3", "lib-rev 7"], ["a/b12/c.bin", "a/b7/c.bin"],
    ]
    apart = ["report.txt", "driver2.txt", "final.txt", "copying.txt", "new-york.txt", "v.txt", "t.txt"]
    rows = [(i, n) for i, names in enumerate(same) for n in names] + [(100 + i, n) for i, n in enumerate(apart)]
    got = {}
    for r in spark.createDataFrame(rows, "k int, n string").select("k", inventory.normalized(F.col("n")).alias("x")).collect():
        got.setdefault(r.k, set()).add(r.x)
    assert all(len(x) == 1 for x in got.values()) and len(set.union(*got.values())) == len(got)


def test_natural_order_and_three_passes(spark):
    names = ["a10", "a9", "a09b", "b1", "a9b10", "a9b9", "a123456789012345678901234567890", "a", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    import re

    def key(s):
        return [int(x) if k % 2 else x for k, x in enumerate(re.split("([0-9]+)", s))]

    got = [r.n for r in rows.orderBy(inventory.natural_key(F.col("n")), "n").collect()]
    assert [key(n) for n in got] == sorted(key(n) for n in names)
    files_ = [(1, "app-1/x.bin", 100), (2, "app-2/x.bin", 120), (3, "doc/r-v1.txt", 10), (4, "doc/r-v2.txt", 11), (5, "doc/r-v10.txt", 12), (6, "p1/q1.c", 7), (7, "p2/q2.c", 7), (8, "p3/q3.c", 100), (9, "lone", 5)]
    df = spark.createDataFrame(files_, "id int, path string, size long")
    found = inventory.families_greedy(df, inventory.family_keys(F.col("path")), "id", F.struct(inventory.natural_key(F.col("path")), "id"), "size").collect()
    chains = {}
    for r in sorted(found, key=lambda r: r.position):
        chains.setdefault((r["pass"], r.family, r.chain), []).append(r.id)
    assert sorted((k[0], v) for k, v in chains.items()) == [(0, [1, 2]), (1, [3, 4, 5]), (2, [6, 7])]


def test_cascade_looks_at_the_whole_only_of_equal_samples(spark):
    big = bytes(range(256)) * 1200
    rows = [(1, big), (2, big), (3, big[:100_000] + b"!" + big[100_001:]), (4, b"x" * 5), (5, b"y" * 5), (6, b"unlike")]
    got = inventory.duplicate_cascade(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id int, content binary"), "id", "content").first()
    assert (got.by_size, got.by_sample, got.by_content) == (5, 3, 2)


def test_long_contents_are_measured_in_part_and_packed_whole(spark):
    r = random.Random(3)
    noise, numbers = r.randbytes(4000), b"".join((10**9 + 7 * i).to_bytes(8, "little") for i in range(500))
    table, runs = "".join(f"{i};{i * i};x\n" for i in range(400)).encode(), b"a" * 300 + b"b" * 3700
    rows = [(1, "binary", noise, None, 8.0, None), (2, "numeric_binary", numbers, 8, 3.0, None), (3, "tabular", table, None, 4.0, ";"), (4, "binary", runs, None, 0.4, None), (5, "plain_text", b"", None, 0.0, None)]
    df = spark.createDataFrame([(i, c, bytearray(b), s, e, d) for i, c, b, s, e, d in rows], "id int, class string, content binary, stride int, entropy double, delimiter string")
    profile = {k: k for k in planner.PROFILE}
    got = planner.ranked(planner.measure(df, "content", "max", "class", ["id"], profile=profile, above=1000, sample=512), ["id"]).collect()
    of = {i: {x.label: x for x in got if x.id == i} for i in range(1, 6)}
    assert all(x.measured == min(512, x.original) for x in got) and all(x.saved_pct <= 5 for x in of[1].values() if x.error is None)
    assert "delta:8>byte_split:8+zstd:19" in of[2] and "csv_columnar+zstd:19" in of[3] and any(x.startswith("rle+") for x in of[4]) and not any(x.startswith("rle+") for x in of[1])
    tables_ = planner.measure(df.where("id = 3"), "content", "max", "class", ["id"], profile=profile).where("label = 'csv_columnar+zstd:19'")
    assert tables_.first().error is None and tables_.first().measured == len(table)
    whole = {x.id: x for x in planner.pack(df, "content", "max", "class", ["id"], profile=profile, above=1000, sample=512).collect()}
    assert all(x.ok and x.size <= x.original for x in whole.values()) and whole[1].label == "stored" and whole[2].size < 200 and whole[4].size < 60
    forced = {x.id: x for x in planner.pack(df, "content", "max", "class", ["id"], forced="zstd:3").collect()}
    assert forced[1].label == "stored" and forced[3].label == "zstd:3" and all(x.ok for x in forced.values())


def test_dictionaries_are_trained_resolved_and_checked(spark):
    r = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, "a" if i < 200 else "b", " ".join(r.choices(words, k=80))) for i in range(205)]
    df = spark.createDataFrame(rows, "id int, class string, text string")
    made = blocks.trained_dictionaries(df, "class", "text", "id")
    got = made.collect()
    assert [x["class"] for x in got] == ["a"] and 4096 <= len(got[0].content) <= 112 * 1024
    bad = spark.createDataFrame([(x["class"], x.id, bytearray(x.content[:-1] + b"!")) for x in got], "class string, id string, content binary")
    assert blocks.resolved(bad, made).isEmpty() and blocks.resolved(made, made).count() == 1
    done = blocks.dictionary_round_trips(df.where("class = 'a'"), "id", "class", "text", {"a": bytes(got[0].content)})
    assert done.where("NOT ok").isEmpty() and done.agg(F.sum("packed") < F.sum("alone")).first()[0]


def test_classes_of_files_and_why(spark):
    r = random.Random(2)
    code = b"import os\n\ndef f(x):\n    return x\n\nclass A:\n    pass\n" * 5
    cases = [
        (b"", "", "vazio", "tamanho_zero"), (b"\x1f\x8b" + bytes(40), "", "container_comprimido", "assinatura:gzip"), (b'{"a": 1}\n{"a": 2}\n{"b": 3}\n', "", "json_ndjson", "conteudo_ndjson"),
        (b'{"a": [1, 2]}', "", "json_ndjson", "conteudo_json"), (b"<html><p>hello</p></html>", "", "xml_html", "conteudo"), (b"2024-01-02 10:20:30 INFO started\n" * 6, "", "log", "conteudo"),
        (b"a,b,c\n" * 20, "", "csv_tabular", "conteudo"), (b"a,b,c\n" * 20, "txt", "texto", "conteudo"), (b">x\n" + b"ACGTACGTAA\n" * 40, "", "sequencia", "conteudo"), (code, "", "codigo", "conteudo"), (b"some words", "py", "codigo", "extensao"),
        (b"plain words and more of them. " * 20, "", "texto", "conteudo"), (r.randbytes(8192), "", "criptografado_aleatorio", "entropia>=7.9_sem_assinatura"), (r.randbytes(8192), "zip", "container_comprimido", "extensao_sem_assinatura"),
        (b"".join((i * 37).to_bytes(4, "little") for i in range(3000)), "", "cientifico_numerico", "entropia_dos_deltas"), (bytes([0, 1, 2, 200]) * 50, "db", "banco_de_dados", "extensao"), ("word ".encode("utf-16") * 30, "", "texto", "bom_utf16"),
        (b"%PDF-1.4\n" + b"words in a file\n" * 30, "", "texto", "assinatura:pdf_texto"), (bytes(257) + b"ustar" + bytes(250) + b"words of a file " * 60, "", "texto", "assinatura:tar+conteudo"),
    ]
    df = spark.createDataFrame([(i, bytearray(b), e) for i, (b, e, *_) in enumerate(cases)], "id int, content binary, ending string")
    got = {x.id: (x.c["class"], x.c.reason) for x in df.select("id", dataset.dataset_class(F.col("content"), F.col("ending")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [(c, w) for *_, c, w in cases]
    assert {c for *_, c, _ in cases} <= set(dataset.CLASSES)


def test_frame_windows(spark):
    import zstandard

    def packed(n, **kw):
        made = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, **kw))
        return made.compress(bytes(n))

    cases = [packed(n) for n in (5, 255, 256, 70_000)] + [packed(1 << 20, window_log=17), b"no frame", b""]
    want = [zstandard.get_frame_parameters(x).window_size if x[:4] == b"(\xb5/\xfd" else None for x in cases]
    size = [zstandard.frame_content_size(x) if w else None for x, w in zip(cases, want)]
    got = [x.w for x in spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(cases)], "i int, c binary").orderBy("i").select(names.frame_window(F.col("c")).alias("w")).collect()]
    assert all(g == w or g == s for g, w, s in zip(got, want, size)) and got[-2:] == [None, None]


def test_watch_holds_back_what_still_grows(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "done.txt").write_text("done")
    (d / "grows.txt").write_text("gro")
    seen = watch.empty_seen(spark)
    listed = spark.read.format("binaryFile").load(str(d)).select("path", F.col("length").alias("size"))
    events, seen = watch.run_round(spark, str(d), seen, steady=listed.where("path LIKE '%done.txt'"))
    assert [(r.path.rsplit("/")[-1], r.event) for r in events.collect()] == [("done.txt", "new")]
    assert [r.object_hash for r in seen.collect()] == [hashlib.sha256(b"done").hexdigest()]


def test_contents_that_are_too_large_stay_as_rows(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "large").write_bytes(b"x" * 100)
    got = {r.path.rsplit("/")[-1]: (r.length, r.content and bytes(r.content), r.skipped) for r in files.contents(spark, str(tmp_path), most=10).collect()}
    assert got == {"small": (3, b"abc", None), "large": (100, None, "too large")}


def test_sorted_numbers_in_blocks_are_those_of_whole_contents(spark):
    r = np.random.default_rng(3)
    rows = [(int(i % 3) if i % 50 else None, int(v)) for i, v in enumerate(r.integers(-5, 40, 900))] + [(1, 7)] * 400 + [(2, None), (9, None), (8, 1)]
    df = spark.createDataFrame(rows, "k long, v long")
    whole = df.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(F.lpad(F.hex("v"), 16, "0"))), "").alias("h")).select("k", F.unhex("h").alias("content"))
    want = inventory.fixed_chunks(whole, "k", "content", 64).collect()
    got = inventory.sorted_number_chunks(df, "k", "v", 64)
    assert Counter(map(repr, got.collect())) == Counter(map(repr, want)) and len(want) > 150


def test_blocks_are_dealt_over_all_cores_and_made_once(spark, tmp_path):
    blocks = spark.range(1).select(F.lit(1).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(199))).alias("block")).withColumn("chunk", F.sha2(F.col("block").cast("string"), 512).cast("binary"))

    def noted(frames):
        for frame in frames:
            for block in frame["block"]:
                with open(tmp_path / "made", "a") as f:
                    f.write(f"{block}\n")
            yield frame

    made = models.labelled(blocks, 64)
    assert made.select(F.spark_partition_id()).distinct().count() >= 4
    ids = made.withColumn("id", F.col("block").cast("long")).select("id", "block", "features", "sizes", "best", F.lit(1.0).alias("weight"))
    ids = ids.mapInPandas(noted, ids.schema)
    found = models.cross_validated(ids, F.col("id"))
    assert found.count() == 200 and found.where("predicted IS NULL").isEmpty()
    assert Counter((tmp_path / "made").read_text().split()) == Counter(map(str, range(200)))
