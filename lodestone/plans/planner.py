"""Candidate plans, and the measured choice of the smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codecs, transforms

#: Candidate plans of each class and effort in order of preference. T stands for csv_columnar, S and D for
#: byte_split and delta at the content's stride, w marks the other widths, + dict needs a dictionary, low: needs entropy below 2.
PLANS: dict[str, dict[str, str]] = {
    "incompressible": {"fast": "stored", "balanced": "stored", "max": "stored"},
    "media": {"fast": "stored", "balanced": "stored", "max": "stored, zstd:19, xz:6"},
    "pre_compressed": {"fast": "stored", "balanced": "stored", "max": "stored, zstd:19, xz:6"},
    "tabular": {
        "fast": "zstd:3", "balanced": "zstd:12, T+zstd:12, T+brotli:9, zstd:12+dict",
        "max": "zstd:19, T+zstd:19, T+zstd:22, T+brotli:11, T+xz:6, T>delta:1+zstd:19, T+bzip2:9, zstd:19+dict, T+zstd:19+dict",
    },
    "structured_text": {"fast": "zstd:3", "balanced": "zstd:12, brotli:9, zstd:12+dict", "max": "zstd:19, zstd:22, brotli:11, xz:6, bzip2:9, zstd:19+dict, low:rle+zstd:19"},
    "plain_text": {"fast": "zstd:3", "balanced": "zstd:12, brotli:9, zstd:12+dict", "max": "zstd:19, zstd:22, brotli:11, xz:6, bzip2:9, zstd:19+dict, low:rle+zstd:19"},
    "numeric_binary": {
        "fast": "S+zstd:3", "balanced": "zstd:12, S+zstd:12, D+zstd:12, D>S+zstd:12",
        "max": "zstd:19, S+zstd:19, D+zstd:19, D>S+zstd:19, S+xz:6, D>S+xz:6, S+brotli:11, w2+zstd:19, w4+zstd:19, w8+zstd:19",
    },
    "binary": {
        "fast": "lz4", "balanced": "zstd:12, byte_split:4+zstd:12, low:rle+zstd:12",
        "max": "zstd:19, xz:6, brotli:11, bzip2:9, byte_split:4+zstd:19, delta:4+zstd:19, low:rle+zstd:19, low:rle+xz:6, zstd:19+dict",
    },
}
BUDGET = {"fast": 1, "balanced": 4, "max": 16}
EFFORTS = {"fast": "fast rapido speed", "balanced": "balanced default padrao", "max": "max maximum best"}
SAMPLE_ABOVE, SAMPLE = 48 << 20, 8 << 20


def candidates(klass: str, effort: str, stride: int | None = None, entropy: float = 8.0, dictionary: bool = False) -> list[str]:
    """Labels of the plans to measure: the first 1, 4 or 16 that apply, and stored at the end."""
    width = stride or 4
    out = []
    for plan in PLANS[klass][effort].split(", "):
        if plan.startswith("low:"):
            if entropy >= 2.0:
                continue
            plan = plan[4:]
        if plan.endswith("+dict") and not dictionary or plan[:2] == f"w{width}":
            continue
        chain, _, codec = plan.removesuffix("+dict").rpartition("+")
        names = {"T": "csv_columnar", "S": f"byte_split:{width}", "D": f"delta:{width}", "w2": "byte_split:2", "w4": "byte_split:4", "w8": "byte_split:8"}
        chain = ">".join(names.get(t, t) for t in chain.split(">")) if chain else ""
        out.append(f"{chain}+{codec}" * bool(chain) or codec)
        if plan.endswith("+dict"):
            out[-1] += "+dict"
    out = out[: BUDGET[effort]]
    return out if "stored" in out else [*out, "stored"]


def parsed(label: str) -> tuple[list[tuple[str, int]], str, int | None, bool]:
    """(steps, codec, level, uses a dictionary) of a label."""
    with_dictionary = label.endswith("+dict")
    chain, _, last = label.removesuffix("+dict").rpartition("+")
    codec, _, level = last.partition(":")
    steps = [(t.split(":")[0], int(t.split(":")[1]) if ":" in t else 0) for t in chain.split(">")] if chain else []
    return steps, codec, int(level) if level else None, with_dictionary


def candidate_table(spark: SparkSession) -> DataFrame:
    """class, effort, idx, label for every class and effort, at stride 4, without a dictionary: a fixed small table."""
    rows = [(c, e, i, p) for c in PLANS for e in BUDGET for i, p in enumerate(candidates(c, e))]
    return spark.createDataFrame(rows, "class string, effort string, idx int, label string")


def run_plan(data: bytes, label: str, delimiter: bytes = b",", dictionary: bytes = b"") -> tuple[bytes, list[tuple[str, int, int]]]:
    steps, codec, level, with_dictionary = parsed(label)
    made, done = transforms.apply(data, steps, delimiter)
    return codecs.encode(made, codec, level, dictionary if with_dictionary else b""), done


def restore(payload: bytes, label: str, done: list[tuple[str, int, int]], length: int, dictionary: bytes = b"", before: int | None = None) -> bytes:
    """``before``: length of what the codec was given, where steps changed it."""
    _, codec, _, with_dictionary = parsed(label)
    before = length if before is None else before
    return transforms.invert(codecs.decode(payload, codec, before, dictionary if with_dictionary else b"", before), done)


def _measured(data: bytes, label: str, verify: bool, delimiter: bytes = b",", dictionary: bytes = b"") -> tuple[int | None, str | None]:
    try:
        payload, done, before = _packed(data, label, delimiter, dictionary)
        if verify and restore(payload, label, done, len(data), dictionary, before) != data:
            return None, "not restored"
        return len(payload), None
    except ValueError as e:
        return None, type(e).__name__


def _packed(data: bytes, label: str, delimiter: bytes, dictionary: bytes) -> tuple[bytes, list[tuple[str, int, int]], int]:
    steps, codec, level, with_dictionary = parsed(label)
    made, done = transforms.apply(data, steps, delimiter)
    return codecs.encode(made, codec, level, dictionary if with_dictionary else b""), done, len(made)


def middle(data: bytes, above: int = SAMPLE_ABOVE, size: int = SAMPLE) -> bytes:
    """What is measured of a content: all of it, or of a long one its middle, from a multiple of 8 on."""
    start = (len(data) - size) // 2 // 8 * 8
    return data if len(data) <= above else data[start : start + size]


#: Columns that a profile may give beside the content, and what holds without them.
PROFILE = {"stride": "int", "entropy": "double", "delimiter": "string"}


def _rows(objects: DataFrame, content_col: str, class_col: str, id_cols: list[str], profile: dict[str, str]) -> DataFrame:
    given = [F.col(profile[k]).cast(t).alias(f"_{k}") if k in profile else F.lit(None).cast(t).alias(f"_{k}") for k, t in PROFILE.items()]
    return objects.select(*[F.col(c) for c in id_cols], F.col(class_col).alias("_class"), *given, F.col(content_col).cast("binary").alias("_content"))


def _plans_of(row: tuple, effort: str, dictionaries: dict[str, bytes]) -> tuple[list[str], bytes, bytes, bytes]:
    """(labels, content, delimiter, dictionary) of a row of ``_rows``."""
    klass, stride, entropy, delimiter, data = row[-5:]
    data = bytes(data or b"")
    dictionary = dictionaries.get(klass, b"")
    stride = int(stride) if stride is not None and stride == stride else None
    entropy = float(entropy) if entropy is not None and entropy == entropy else 8.0
    labels = candidates(klass, effort, stride, entropy, bool(dictionary)) if data and klass in PLANS else ["stored"]
    return labels, data, (delimiter or ",").encode(), dictionary


def measure(
    objects: DataFrame, content_col: str, effort: str, class_col: str, id_cols: list[str], verify: bool = True,
    *, profile: dict[str, str] | None = None, dictionaries: dict[str, bytes] | None = None, above: int = SAMPLE_ABOVE, sample: int = SAMPLE,
) -> DataFrame:
    """One row for each object and candidate: id columns, idx, label, size, measured, original, error.

    All candidates of an object are measured in the task that holds it, so the
    content isn't copied for each; contents over ``above`` bytes by their middle
    ``sample`` bytes: ``size`` is what becomes of ``measured`` bytes. ``profile``
    names the columns with a content's stride, entropy and delimiter.
    """
    rows = _rows(objects, content_col, class_col, id_cols, profile or {})
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(id_cols)])
    known = dictionaries or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                labels, data, delimiter, dictionary = _plans_of(row, effort, known)
                part = middle(data, above, sample)
                for i, label in enumerate(labels):
                    size, error = _measured(part, label, verify, delimiter, dictionary)
                    out.append((*row[: len(id_cols)], i, label, size, len(part), len(data), error))
            yield pd.DataFrame(out, columns=[*id_cols, "idx", "label", "size", "measured", "original", "error"]).astype({"size": "Int64"})

    return rows.mapInPandas(run, f"{fields}, idx int, label string, size long, measured long, original long, error string")


def pack(
    objects: DataFrame, content_col: str, effort: str, class_col: str, id_cols: list[str], *, profile: dict[str, str] | None = None,
    dictionaries: dict[str, bytes] | None = None, forced: str | None = None, above: int = SAMPLE_ABOVE, sample: int = SAMPLE, with_payload: bool = False,
) -> DataFrame:
    """Each object by its best plan: id columns, label, size, original, candidates, ok.

    The smallest candidate wins, of equals the first; failed ones lose. It is
    then run on the whole content, which is stored as it is where that is not
    smaller or isn't given back. ``forced`` is a codec and level to use instead,
    without transforms, with the same fall back.
    """
    rows = _rows(objects, content_col, class_col, id_cols, profile or {})
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(id_cols)])
    known = dictionaries or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                labels, data, delimiter, dictionary = _plans_of(row, effort, known)
                if forced is not None:
                    labels = [forced]
                sizes = [_measured(middle(data, above, sample), x, False, delimiter, dictionary)[0] for x in labels] if len(labels) > 1 else [0]
                tried = [(n, i) for i, n in enumerate(sizes) if n is not None]
                label, payload, done, before = labels[min(tried)[1]] if tried else "stored", data, [], len(data)
                if label != "stored":
                    try:
                        payload, done, before = _packed(data, label, delimiter, dictionary)
                        if len(payload) >= len(data) or restore(payload, label, done, len(data), dictionary, before) != data:
                            label, payload = "stored", data
                    except ValueError:
                        label, payload = "stored", data
                ok = payload == data if label == "stored" else True
                out.append((*row[: len(id_cols)], label, len(payload), len(data), len(labels), ok, *([payload] * with_payload)))
            yield pd.DataFrame(out, columns=[*id_cols, "label", "size", "original", "candidates", "ok", *["payload"] * with_payload])

    return rows.mapInPandas(run, f"{fields}, label string, size long, original long, candidates int, ok boolean" + ", payload binary" * with_payload)


def best_plan(measured: DataFrame, id_cols: list[str]) -> DataFrame:
    """The smallest candidate of each object; ties go to the lower index, failed ones lose."""
    order = F.row_number().over(W.partitionBy(*id_cols).orderBy(F.col("size").asc_nulls_last(), "idx"))
    return measured.withColumn("_nth", order).where("_nth = 1").drop("_nth")


def ranked(measured: DataFrame, id_cols: list[str]) -> DataFrame:
    """All measurements of an object, errors last, then by size; what is saved is a share of the bytes that were measured."""
    order = W.partitionBy(*id_cols).orderBy(F.col("error").isNotNull(), "size", "idx")
    saved = F.when(F.col("measured") > 0, (1 - F.col("size") / F.col("measured")) * 100).otherwise(0.0)
    return measured.withColumn("position", F.row_number().over(order)).withColumn("saved_pct", F.round(saved, 4))
