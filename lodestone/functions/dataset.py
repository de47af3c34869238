"""Classes of files in a dataset: by signature, by layout of text, by entropy; fourteen classes, each with its reason."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .content import corrected_entropy, entropy, transform_entropy

#: The classes.
CLASSES = ["texto", "codigo", "csv_tabular", "json_ndjson", "log", "xml_html", "sequencia", "binario", "banco_de_dados", "cientifico_numerico", "imagem_audio_video", "container_comprimido", "criptografado_aleatorio", "vazio"]
_PACKED, _MEDIA, _BINARY, _NUMBERS, _SECRET = "container_comprimido", "imagem_audio_video", "binario", "cientifico_numerico", "criptografado_aleatorio"
#: Place, first bytes, format and class of each signature.
SIGNATURES: list[tuple[int, bytes, str, str]] = [
    (0, b"PK\x03\x04", "zip", _PACKED),
    (0, b"PK\x05\x06", "zip", _PACKED),
    (0, b"\x1f\x8b", "gzip", _PACKED),
    (0, b"\xfd7zXZ\x00", "xz", _PACKED),
    (0, b"\x28\xb5\x2f\xfd", "zstd", _PACKED),
    (0, b"7z\xbc\xaf\x27\x1c", "7z", _PACKED),
    (0, b"Rar!\x1a\x07", "rar", _PACKED),
    (0, b"\x04\x22\x4d\x18", "lz4", _PACKED),
    (0, b"PAR1", "parquet", _PACKED),
    (0, b"ORC", "orc", _PACKED),
    (0, b"ARROW1", "arrow", _PACKED),
    (0, b"Obj\x01", "avro", _PACKED),
    (0, b"\x89PNG\r\n\x1a\n", "png", _MEDIA),
    (0, b"\xff\xd8\xff", "jpeg", _MEDIA),
    (0, b"GIF87a", "gif", _MEDIA),
    (0, b"GIF89a", "gif", _MEDIA),
    (0, b"\x00\x00\x00\x0cjP  ", "jpeg2000", _MEDIA),
    (0, b"fLaC", "flac", _MEDIA),
    (0, b"OggS", "ogg", _MEDIA),
    (0, b"ID3", "mp3", _MEDIA),
    (0, b"\x1a\x45\xdf\xa3", "matroska", _MEDIA),
    (0, b"\x00\x00\x01\xba", "mpeg", _MEDIA),
    (0, b"\x00\x00\x01\xb3", "mpeg", _MEDIA),
    (0, b"FLV\x01", "flv", _MEDIA),
    (0, b"\x30\x26\xb2\x75\x8e\x66\xcf\x11", "asf", _MEDIA),
    (0, b"\x7fELF", "elf", _BINARY),
    (0, b"\xfe\xed\xfa\xce", "macho", _BINARY),
    (0, b"\xfe\xed\xfa\xcf", "macho", _BINARY),
    (0, b"\xce\xfa\xed\xfe", "macho", _BINARY),
    (0, b"\xcf\xfa\xed\xfe", "macho", _BINARY),
    (0, b"\xca\xfe\xba\xbe", "java_class_ou_macho", _BINARY),
    (0, b"\x00asm", "wasm", _BINARY),
    (0, b"SQLite format 3\x00", "sqlite", "banco_de_dados"),
    (0, b"\x89HDF\r\n\x1a\n", "hdf5", _NUMBERS),
    (0, b"CDF\x01", "netcdf", _NUMBERS),
    (0, b"CDF\x02", "netcdf", _NUMBERS),
    (0, b"SIMPLE  =", "fits", _NUMBERS),
    (0, b"\x93NUMPY", "npy", _NUMBERS),
    (0, b"MATLAB 5.0", "mat", _NUMBERS),
    (128, b"DICM", "dicom", _NUMBERS),
    (0, b"Salted__", "openssl_enc", _SECRET),
    (0, b"LUKS\xba\xbe", "luks", _SECRET),
    (0, b"age-encryption.org/v1", "age", _SECRET),
    (0, b"-----BEGIN PGP MESSAGE-----", "pgp_armor", _SECRET),
]
#: Brands of the ISO media format that are pictures.
PICTURE_BRANDS = ["avif", "avis", "heic", "heix", "mif1", "msf1", "heim", "heis"]
#: Extensions by class.
EXTENSIONS: dict[str, str] = {
    "codigo": "py js mjs cjs ts tsx jsx c h cc cpp cxx hpp hh rs go java kt kts scala swift rb php pl pm lua sh bash zsh ps1 bat cs fs vb sql r jl m mm dart hs ml clj ex exs erl cu cl glsl vhd vhdl v sv asm s css scss less proto gradle cmake mk toml yaml yml ini cfg conf tf",
    "texto": "txt md rst tex rtf adoc org nfo text",
    "csv_tabular": "csv tsv psv tab",
    "json_ndjson": "json jsonl ndjson geojson json5",
    "log": "log out err trace",
    "xml_html": "xml html htm xhtml svg xsd xsl xslt rss atom kml plist",
    "sequencia": "fa fasta fna faa fastq fq gb gbk",
    "banco_de_dados": "db sqlite sqlite3 db3 mdb accdb ldb sst ibd myd myi frm dbf mdf ldf rdb lmdb",
    "container_comprimido": "zip gz tgz bz2 tbz2 xz txz zst zstd 7z rar lz4 lz lzma z cab jar war apk whl parquet orc avro arrow feather docx xlsx pptx odt ods odp epub syntra snappy br deb rpm",
    "imagem_audio_video": "jpg jpeg png gif webp avif heic heif jp2 mp3 aac m4a ogg oga opus flac wma mp4 m4v mov mkv webm avi wmv flv mpg mpeg 3gp",
    "cientifico_numerico": "npy h5 hdf5 hdf nc cdf fits fit mat dcm grib grb tif tiff bmp wav raw",
    "criptografado_aleatorio": "enc gpg pgp age crypt aes luks kdbx",
    "binario": "exe dll so o a elf class pyc wasm dylib obj lib img iso vmdk qcow2 vdi",
}
_CLASS_OF = {e: c for c, names in EXTENSIONS.items() for e in names.split()}
WINDOW = 16 * 1024
#: Bits a byte from which a content counts as random, or as packed where its name says so; bits that a transform must take off.
RANDOM_BITS, PACKED_BITS, GAINED_BITS = 7.9, 7.3, 0.75


def _is(content: Column, at: int, what: bytes) -> Column:
    return F.substring(content, at + 1, len(what)) == F.lit(what)


def signature(content: Column, ending: Column) -> Column:
    """struct(format, class) by first bytes, in a fixed order; class is null for formats that may hold anything, both where nothing fits.

    ``ending`` is the name's extension, which short signatures need besides.
    """

    def found(name: str, klass: str | None) -> Column:
        return F.struct(F.lit(name).alias("format"), F.lit(klass).cast("string").alias("class"))

    byte = lambda i: F.conv(F.hex(F.substring(content, i + 1, 1)), 16, 10).cast("int")
    brand = F.substring(content, 9, 4)
    pe = byte(60) + byte(61) * 256 + byte(62) * 65536
    rules = [F.when(_is(content, at, magic), found(name, klass)) for at, magic, name, klass in SIGNATURES]
    rules += [
        F.when(_is(content, 0, b"BZh") & byte(3).between(49, 57), found("bzip2", _PACKED)),
        F.when(_is(content, 257, b"ustar"), found("tar", None)),
        F.when(_is(content, 0, b"%PDF-"), found("pdf", None)),
        F.when(_is(content, 0, b"RIFF"), F.when(brand == F.lit(b"WEBP"), found("webp", _MEDIA)).when(brand == F.lit(b"AVI "), found("avi", _MEDIA)).when(brand == F.lit(b"WAVE"), found("wav", None))),
        F.when(_is(content, 4, b"ftyp"), F.when(brand.cast("string").isin(PICTURE_BRANDS), found("heif", _MEDIA)).otherwise(found("iso_bmff", _MEDIA))),
        F.when(_is(content, 0, b"II*\x00") | _is(content, 0, b"MM\x00*"), found("tiff", None)),
        F.when(_is(content, 0, b"BM") & (ending == "bmp"), found("bmp", None)),
        F.when(_is(content, 0, b"MZ") & (F.octet_length(content) >= 64) & (byte(63) == 0) & (pe >= 64) & (F.substring(content, pe + 1, F.lit(4)) == F.lit(b"PE\x00\x00")), found("pe", _BINARY)),
        F.when(ending.isin("mp3", "aac", "mp2") & (byte(0) == 255) & (byte(1) >= 224), found("mpeg_audio", _MEDIA)),
    ]
    return F.coalesce(*rules, F.struct(F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("class")))


# --- text ----------------------------------------------------------------------

_STAMP = re.compile(rb"\[?(\d{4}-\d\d-\d\d[T ]\d\d:\d\d|[A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d|\d\d/\d\d/\d{4}[ :]|\d\d:\d\d:\d\d[ .,])|\d+\.\d+\.\d+\.\d+ .*\[\d\d/[A-Z][a-z]{2}/\d{4}").match
_LEVELS = frozenset(b"INFO WARN WARNING ERROR DEBUG TRACE FATAL NOTICE".split())
_OPENERS = frozenset(b"#include #define #ifdef import from def class function package public private static const let var fn func using namespace struct typedef".split())
_BRANCH = re.compile(rb"\b(?:if|for|while|switch|return) ?\(|\) ?\{|;[ \t]*$").search
_BASES = np.zeros(256, bool)
_BASES[list(b"ACGTNacgtn")] = True


def _lines(head: bytes, whole: bool) -> list[bytes]:
    """Lines that say something; the last one of a part of a file may be cut, and goes."""
    lines = head.split(b"\n")
    return [x.rstrip(b"\r") for x in (lines if whole or len(lines) == 1 else lines[:-1]) if x.strip()]


def _json(head: bytes, lines: list[bytes], whole: bool, ending: str) -> str | None:
    if head.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] not in (b"{", b"["):
        return None

    def parses(x: bytes) -> bool:
        try:
            json.loads(x)
        except (ValueError, RecursionError):
            return False
        return True

    if len(lines) >= 3 and all(x[:1] in b"{[" for x in lines[:20]) and all(parses(x) for x in lines[:3]):
        return "ndjson"
    if whole and parses(head):
        return "json"
    keys = head.count(b'":')
    return "json" if _CLASS_OF.get(ending) == "json_ndjson" or keys >= 5 and head.count(b'"') >= len(head) / 50 and head.count(b"{") + head.count(b"[") >= 2 else None


def _markup(head: bytes) -> bool:
    top = head.lstrip(b"\xef\xbb\xbf \t\r\n")
    closing, opening = head.count(b"</"), head.count(b"<")
    if top[:64].lower().startswith((b"<?xml", b"<!doctype html", b"<html", b"<svg", b"<!--")):
        return True
    return top[:1] == b"<" and closing >= 3 and opening >= len(head) / 100 or closing >= 10 and opening >= len(head) / 50


def _table(lines: list[bytes]) -> bool:
    """Four fifths of the first lines have as many columns by one delimiter: two by tabs, three by others."""
    lines = lines[:60]
    if len(lines) < 5 or max(map(len, lines)) > 8192:
        return False
    for delimiter, least in ((b",", 3), (b"\t", 2), (b";", 3), (b"|", 3)):
        columns, times = np.unique([x.count(delimiter) + 1 for x in lines], return_counts=True)
        if columns[times.argmax()] >= least and times.max() >= 0.8 * len(lines):
            return True
    return False


def _log(lines: list[bytes]) -> bool:
    lines = lines[:80]
    stamps = sum(bool(_STAMP(x)) for x in lines)
    levels = sum(not _LEVELS.isdisjoint(re.split(rb"\W+", x)) for x in lines)
    return len(lines) >= 4 and (stamps >= 0.6 * len(lines) or levels >= 0.5 * len(lines) and stamps >= 0.2 * len(lines))


def _sequence(head: bytes) -> bool:
    body = np.frombuffer(b"".join(x.rstrip(b"\r") for x in head.split(b"\n") if x[:1] not in (b">", b"@", b"+", b";")), np.uint8)
    return len(body) >= 256 and bool(_BASES[body].mean() >= 0.95)


def _code(head: bytes) -> bool:
    lines = head.split(b"\n")
    openers = {w[0] for x in lines if (w := x.split(None, 1))} & _OPENERS
    branches = sum(bool(_BRANCH(x)) for x in lines) / max(1, len(lines) - 1)
    return head[:2] == b"#!" or len(openers) >= 3 or len(openers) >= 2 and branches >= 0.15 or branches >= 0.35


def text_class(head: bytes, ending: str, size: int) -> tuple[str, str]:
    """(class, reason) of a text by its first bytes, its name's extension and its size."""
    whole, named = len(head) >= size, _CLASS_OF.get(ending)
    lines = _lines(head, whole)
    if kind := _json(head, lines, whole, ending):
        return "json_ndjson", f"conteudo_{kind}"
    checks = [("json_ndjson", lambda: False), ("xml_html", lambda: _markup(head)), ("log", lambda: _log(lines)), ("csv_tabular", lambda: False), ("sequencia", lambda: _sequence(head)), ("codigo", lambda: False), ("csv_tabular", lambda: named != "texto" and _table(lines)), ("codigo", lambda: _code(head))]
    for klass, fits in checks:
        if named == klass:
            return klass, "extensao"
        if fits():
            return klass, "conteudo"
    return "texto", "conteudo"


# --- all fourteen --------------------------------------------------------------


def sampled(data: bytes, size: int = WINDOW, large: int = 1 << 20) -> tuple[bytes, bytes]:
    """The first bytes; and with them, of a large content, its middle and end."""
    head = data[:size]
    middle = (len(data) - size) // 2
    return head, head + data[middle : middle + size] + data[-size:] if len(data) > large else head


def _utf8(head: bytes) -> bool:
    try:
        head.decode()
    except UnicodeDecodeError as e:
        return e.reason == "unexpected end of data" and e.start >= len(head) - 3
    return True


def dataset_class_of(data: bytes, ending: str, fmt: str | None, klass: str | None) -> tuple[str, str, float, float, float, float]:
    """(class, reason, entropy, corrected entropy, printable share, share of zero bytes) of a content; ``fmt`` and ``klass`` by its signature."""
    if not data:
        return "vazio", "tamanho_zero", 0.0, 0.0, 0.0, 0.0
    head, sample = sampled(data)
    a = np.frombuffer(sample, np.uint8)
    n, counts = len(a), np.bincount(a, minlength=256)
    bits, more = entropy(a), corrected_entropy(a)
    prints = int(counts[[9, 10, 13]].sum() + counts[32:127].sum() + counts[128:].sum())
    shown, zeros = prints / n, counts[0] / n
    shown_else = prints / (n - counts[0]) if n > counts[0] else 0.0
    named = _CLASS_OF.get(ending)

    def decided() -> tuple[str, str]:
        if klass:
            return klass, f"assinatura:{fmt}"
        if head[:2] in (b"\xff\xfe", b"\xfe\xff") and shown_else > 0.95:
            return "texto", "bom_utf16"
        if fmt == "tar":
            if shown_else < 0.95:
                return _BINARY, "assinatura:tar_com_conteudo_binario"
            kind, why = text_class(sample.replace(b"\0", b""), "", len(data) << 8)
            return kind, f"assinatura:tar+{why}"
        if fmt == "pdf":
            return (_PACKED, "assinatura:pdf_entropia_alta") if more >= PACKED_BITS else ("texto", "assinatura:pdf_texto") if shown >= 0.88 else (_BINARY, "assinatura:pdf_binario")
        if fmt:
            return (_MEDIA, f"assinatura:{fmt}_entropia_alta") if more >= PACKED_BITS else (_NUMBERS, f"assinatura:{fmt}_bruto")
        text = shown >= 0.88 and zeros < 0.01 and more < 7.0 and (counts[128:].sum() / n <= 0.3 or _utf8(head))
        if text:
            return text_class(head, ending, len(data))
        if n >= 1024 and more >= RANDOM_BITS:
            return (named, "extensao_sem_assinatura") if named in (_PACKED, _MEDIA) else (_SECRET, f"entropia>={RANDOM_BITS}_sem_assinatura")
        if named in (_PACKED, _MEDIA) and more >= PACKED_BITS or named in (_SECRET, "banco_de_dados", _BINARY, _NUMBERS):
            return named, "extensao"
        if n >= 4096 and bits - (best := transform_entropy(a)) >= GAINED_BITS and best < 7.0:
            return _NUMBERS, "entropia_dos_deltas"
        return _BINARY, "conteudo_binario"

    return *decided(), bits, more, shown, float(zeros)


_FOUND = T.StructType([T.StructField("class", T.StringType()), T.StructField("reason", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("entropy", "corrected", "printable", "zeros")]])


@F.pandas_udf(_FOUND)
def _classes(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for data, ending, fmt, klass in batches:
        rows = [dataset_class_of(bytes(d or b""), e or "", f, k) for d, e, f, k in zip(data, ending, fmt, klass)]
        yield pd.DataFrame(rows, columns=_FOUND.names)


def dataset_class(content: Column, ending: Column) -> Column:
    """struct(class, reason, entropy, corrected, printable, zeros) of a content; null counts as empty."""
    found = signature(content, ending)
    return _classes(content, ending, found["format"], found["class"])


#: MIME type by format of a signature.
MIME_OF_FORMAT = {
    "zip": "application/zip", "gzip": "application/gzip", "bzip2": "application/x-bzip2", "xz": "application/x-xz", "zstd": "application/zstd", "7z": "application/x-7z-compressed", "rar": "application/vnd.rar",
    "parquet": "application/vnd.apache.parquet", "png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "flac": "audio/flac", "mp3": "audio/mpeg", "wav": "audio/wav", "matroska": "video/x-matroska",
    "iso_bmff": "video/mp4", "heif": "image/heif", "tiff": "image/tiff", "bmp": "image/bmp", "pdf": "application/pdf", "elf": "application/x-executable", "wasm": "application/wasm", "sqlite": "application/vnd.sqlite3", "tar": "application/x-tar",
}


def mime_by_magic(content: Column, printable: Column) -> Column:
    """By signature, else text where over nine tenths print, else unknown bytes."""
    table = F.create_map(*[F.lit(x) for pair in MIME_OF_FORMAT.items() for x in pair])
    fmt = signature(content, F.lit(""))["format"]
    return F.coalesce(F.when(fmt.isNotNull(), F.element_at(table, fmt)), F.when(printable > 0.90, "text/plain").otherwise("application/octet-stream"))
