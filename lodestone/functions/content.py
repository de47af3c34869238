"""Content profiling: types, magic numbers, entropy, layout, tables, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: MIME type by file extension.
MIME = {
    "application/json": "json", "application/x-ndjson": "jsonl ndjson", "text/csv": "csv", "text/tab-separated-values": "tsv", "text/plain": "log txt", "text/markdown": "md",
    "application/xml": "xml", "text/html": "html htm", "text/css": "css", "text/javascript": "js", "text/typescript": "ts", "application/yaml": "yaml yml", "application/toml": "toml",
    "application/sql": "sql", "text/x-rust": "rs", "text/x-python": "py", "text/x-go": "go", "text/x-java": "java", "text/x-c": "c h", "text/x-c++": "cpp", "image/svg+xml": "svg",
    "application/vnd.apache.parquet": "parquet", "application/vnd.apache.orc": "orc", "application/vnd.apache.avro": "avro", "application/vnd.apache.arrow": "arrow",
    "application/x-protobuf": "protobuf pb", "application/x-numpy": "npy", "application/octet-stream": "bin dat", "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "image/png": "png", "image/jpeg": "jpg jpeg", "image/gif": "gif", "image/webp": "webp",
    "image/bmp": "bmp", "image/tiff": "tiff tif", "image/avif": "avif", "image/heic": "heic", "image/heif": "heif", "audio/wav": "wav", "audio/flac": "flac", "audio/mpeg": "mp3",
    "audio/aac": "aac", "audio/opus": "opus", "video/mp4": "mp4", "video/x-matroska": "mkv", "video/webm": "webm", "application/zip": "zip", "application/gzip": "gz",
    "application/x-bzip2": "bz2", "application/x-xz": "xz", "application/zstd": "zst", "application/x-7z-compressed": "7z", "application/vnd.rar": "rar",
}
#: First bytes of compressed formats (zip, gzip, bzip2, xz, zstd, 7z, rar, lz4 frame).
COMPRESSED_MAGIC = ["504B0304", "1F8B", "425A68", "FD377A585A00", "28B52FFD", "377ABCAF271C", "526172211A07", "04224D18"]
PRE_COMPRESSED = ["application/zip", "application/gzip", "application/x-bzip2", "application/x-xz", "application/zstd", "application/x-7z-compressed", "application/vnd.rar"]
MEDIA_IMAGES = ["image/jpeg", "image/png", "image/gif", "image/webp", "image/avif", "image/heic", "image/heif"]
#: Further signatures as (offset, first bytes, class).
SIGNATURES = [
    (0, "89504E470D0A1A0A", "image"), (0, "FFD8FF", "image"), (0, "474946383761", "image"), (0, "474946383961", "image"), (0, "424D", "image"), (0, "25504446", "document"),
    (0, "7F454C46", "executable"), (0, "4D5A", "executable"), (0, "CAFEBABE", "executable"), (0, "53514C69746520666F726D6174203300", "database"), (0, "50415231", "columnar"),
    (0, "4F5243", "columnar"), (0, "4F626A01", "columnar"), (0, "4152524F5731", "columnar"), (0, "664C6143", "audio"), (0, "494433", "audio"), (0, "4F676753", "audio"),
    (0, "1A45DFA3", "video"), (4, "66747970", "video"), (257, "7573746172", "archive"),
]
_STRUCTURED = "json|xml|yaml|toml|html|sql|csv|tab-separated"
SAMPLE = 3 * 1024 * 1024
CLASSES = ("tabular", "structured_text", "plain_text", "numeric_binary", "binary", "pre_compressed", "media", "incompressible")


def mime_of_name(name: Column) -> Column:
    """By the last extension, or null."""
    pairs = [F.lit(x) for mime, names in MIME.items() for e in names.split() for x in (e, mime)]
    found = F.element_at(F.create_map(*pairs), F.lower(F.substring_index(name, ".", -1)))
    return F.when(F.contains(name, F.lit(".")), found)


def starts_with_hex(content: Column, magic: str, offset: int = 0) -> Column:
    return F.substring(content, offset + 1, len(magic) // 2) == F.unhex(F.lit(magic))


def has_compressed_magic(content: Column) -> Column:
    out = F.lit(False)
    for magic in COMPRESSED_MAGIC:
        out = out | starts_with_hex(content, magic)
    return out


def signature_class(content: Column) -> Column:
    """Class by signature, or null; RIFF files by the word after their size."""
    riff = F.when(starts_with_hex(content, "52494646"), F.when(F.substring(content, 9, 4) == F.lit(b"WEBP"), "image").when(F.substring(content, 9, 4) == F.lit(b"WAVE"), "audio").otherwise("video"))
    return F.coalesce(F.when(has_compressed_magic(content), "compressed"), riff, *[F.when(starts_with_hex(content, m, o), c) for o, m, c in SIGNATURES])


def is_text_mime(mime: Column) -> Column:
    return mime.startswith("text/") | mime.rlike(_STRUCTURED)


def is_pre_compressed_mime(mime: Column) -> Column:
    return mime.isin(PRE_COMPRESSED) | mime.startswith("application/vnd.openxmlformats") | mime.startswith("application/vnd.oasis.opendocument")


def is_media_mime(mime: Column) -> Column:
    return mime.startswith("video/") | mime.startswith("audio/") | mime.isin(MEDIA_IMAGES)


def mime_family(mime: Column) -> Column:
    return F.when(is_pre_compressed_mime(mime), "pre_compressed").when(is_media_mime(mime), "media").when(is_text_mime(mime), "text").otherwise("other")


def detect_csv(text: Column) -> Column:
    """struct(delimiter, columns) where all lines of a text of 64 bytes or more have the same number of , tab or ; and there are 4 rows; else null.

    The first 32 lines of the first 256 KiB choose the delimiter: most columns,
    the earlier of equals. Empty lines among them don't count there.
    """
    head = F.slice(F.split(F.substring(text, 1, 256 * 1024), "\n"), 1, 32)
    head = F.filter(head, lambda x: x != "")
    body = F.regexp_replace(text, r"\n\z", "")
    lines = F.split(body, "\n", -1)

    def count(line: Column, delimiter: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))

    best = None
    for delimiter in (",", "\t", ";"):
        first = count(F.get(head, F.lit(0)), delimiter)
        fits = (F.size(head) > 0) & (first > 0) & F.forall(head, lambda x: count(x, delimiter) == first)  # noqa: B023
        found = F.when(fits, F.struct(F.lit(delimiter).alias("delimiter"), (first + 1).alias("columns")))
        best = found if best is None else F.when(best.isNull() | (found["columns"] > best["columns"]), found).otherwise(best)

    def even(delimiter: str) -> Column:
        return F.forall(lines, lambda x: count(x, delimiter) + 1 == best["columns"])

    whole = F.when(best["delimiter"] == ",", even(",")).when(best["delimiter"] == "\t", even("\t")).otherwise(even(";"))
    return F.when((F.octet_length(text) >= 64) & best.isNotNull() & whole & (F.size(lines) >= 4), best)


# --- byte statistics, in numpy -----------------------------------------------

_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[[9, 10, 13, *range(0x20, 0x7F), *range(0x80, 256)]] = True
_MARKERS = np.zeros(256, bool)
_MARKERS[list(b'{}[]<>:"=')] = True


def sample_of(data: bytes, most: int = SAMPLE) -> np.ndarray:
    """The middle of a long content."""
    a = np.frombuffer(data, np.uint8)
    start = max(0, (len(a) - most) // 2)
    return a[start : start + most]


def entropy(a: np.ndarray) -> float:
    """Bits a byte."""
    if not len(a):
        return 0.0
    p = np.bincount(a, minlength=256)
    p = p[p > 0] / len(a)
    return float(-(p * np.log2(p)).sum())


def corrected_entropy(a: np.ndarray) -> float:
    """With the Miller-Madow correction for small samples."""
    return min(8.0, entropy(a) + (len(np.unique(a)) - 1) / (2 * len(a) * np.log(2))) if len(a) else 0.0


def match_rate(a: np.ndarray, lag: int) -> float:
    return float((a[lag:] == a[:-lag]).mean()) if len(a) > lag else 0.0


def stride(a: np.ndarray) -> int | None:
    """Width (2, 4 or 8) at which bytes repeat clearly more often than between neighbours."""
    a = a[: 256 * 1024]
    if len(a) < 512:
        return None
    base = match_rate(a, 1)
    rates = [(match_rate(a, w), -w) for w in (2, 4, 8)]
    best = max((r for r in rates if r[0] > 0.25 and r[0] > 1.6 * base), default=None)
    return -best[1] if best else None


def transform_entropy(a: np.ndarray) -> float:
    """The smallest entropy after delta, plane split or both, at widths 1, 2, 4 and 8."""
    best = entropy(a)
    for w in (1, 2, 4, 8):
        n = len(a) // w * w
        if not n:
            continue
        v = a[:n].view(f"<u{w}")
        d = np.diff(v, prepend=v[:1] * 0).view(np.uint8)
        planes = lambda x: float(np.mean([entropy(x[i::w]) for i in range(w)]))
        best = min(best, entropy(d), planes(d), planes(a[:n]))
    return best


def _statistics(data: bytes, wanted: frozenset[str]) -> list[float | int | None]:
    """The wanted statistics in the order of ``_STATS``: markers from the first 64 KiB, matches and stride from 256 KiB, all else from the middle."""
    a, head = sample_of(data), np.frombuffer(data, np.uint8)[: 64 * 1024]
    make = {
        "entropy": lambda: entropy(a),
        "printable": lambda: float(_PRINTABLE[a].mean()) if len(a) else 0.0,
        "markers": lambda: float(_MARKERS[head].mean()) if len(head) else 0.0,
        **{f"rate{k}": (lambda k=k: match_rate(a[: 256 * 1024], k)) for k in (1, 2, 4, 8)},
        "transform_entropy": lambda: transform_entropy(a[:65536]),
        "stride": lambda: stride(a),
    }
    return [make[name]() for name in _STATS if name in wanted]


_STATS = ["entropy", "printable", "markers", "rate1", "rate2", "rate4", "rate8", "transform_entropy", "stride"]


def measured(*stats: str):
    """A column function: a struct of these byte statistics of binary contents, and no others."""
    names = [n for n in _STATS if n in stats]
    schema = T.StructType([T.StructField(n, T.IntegerType() if n == "stride" else T.DoubleType()) for n in names])

    @F.pandas_udf(schema)
    def made(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in contents:
            rows = [_statistics(data or b"", frozenset(names)) for data in series]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"stride": "Int32"}) if "stride" in names else frame

    return made


profile = measured(*_STATS)


def content_class(content: Column, text: Column, mime: Column, stats: Column) -> Column:
    """One of CLASSES by the ordered rules; ``stats`` is a profile, ``text`` the content read as text."""
    textual = is_text_mime(mime)
    return (
        F.when(F.octet_length(content) == 0, "binary")
        .when(is_pre_compressed_mime(mime) | has_compressed_magic(content), "pre_compressed")
        .when(is_media_mime(mime), "media")
        .when(stats["entropy"] >= 7.94, "incompressible")
        .when(stats["stride"].isNotNull() & ~textual, "numeric_binary")
        .when((stats["printable"] > 0.88) & detect_csv(text).isNotNull(), "tabular")
        .when((stats["printable"] > 0.88) & (textual | (stats["markers"] > 0.04)), "structured_text")
        .when(stats["printable"] > 0.88, "plain_text")
        .when(stats["stride"].isNotNull(), "numeric_binary")
        .otherwise("binary")
    )


def effective_mime(name: Column, hint: Column, printable: Column) -> Column:
    """A hint that says something, else by name, else text if over nine tenths print."""
    given = F.when((hint != "") & (hint != "application/octet-stream"), hint)
    return F.coalesce(given, mime_of_name(name), F.when(printable > 0.90, "text/plain").otherwise("application/octet-stream"))


def dictionary_key(class_col: Column) -> Column:
    """Name under which a class's dictionaries stand; empty for classes that have none."""
    none = class_col.isin("pre_compressed", "media", "incompressible")
    return F.when(none, "").otherwise(F.regexp_replace(F.lower(class_col), "[^a-z0-9-]", "_"))


def safe_name(name: Column) -> Column:
    """The last path part without control characters, 255 characters at most; unnamed if nothing is left."""
    base = F.substring(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\p{Cntrl}", ""), 1, 255)
    return F.when(F.coalesce(base, F.lit("")) == "", "unnamed").otherwise(base)


def valid_object_id(name: Column) -> Column:
    """64 hexadecimal digits at the start, before an underscore or a suffix; or null."""
    found = F.regexp_extract(name, r"^([0-9a-fA-F]{64})(_.*)?(\.[a-z]+)?$", 1)
    return F.when(found != "", F.lower(found))


def valid_tenant_id(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]{1,64}$")
