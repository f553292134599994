"""Content types by first bytes, then by the name's ending."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_REGULAR, UNKNOWN = "application/x-not-regular-file", "application/octet-stream"
#: First bytes in hex and what they say; fixed values.
MAGIC = (
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("424D", "image/bmp"),
    ("255044462D", "application/pdf"),
    ("504B0304", "application/zip"),
    ("504B0506", "application/zip"),
    ("1F8B", "application/gzip"),
    ("28B52FFD", "application/zstd"),
    ("425A68", "application/x-bzip2"),
    ("FD377A585A00", "application/x-xz"),
    ("377ABCAF271C", "application/x-7z-compressed"),
    ("526172211A07", "application/x-rar-compressed"),
    ("7F454C46", "application/x-elf"),
    ("CAFEBABE", "application/x-java-applet"),
    ("53514C69746520666F726D6174203300", "application/vnd.sqlite3"),
    ("4F676753", "application/ogg"),
    ("494433", "audio/mpeg"),
    ("664C6143", "audio/flac"),
    ("0061736D", "application/wasm"),
    ("50415231", "application/vnd.apache.parquet"),
)
#: How texts begin after white space, as expressions.
BEGINNINGS = ((r"(?i)^\s*<(!doctype html|html|head|body|script|table|div|h1|p)[\s>]", "text/html; charset=utf-8"), (r"^\s*<\?xml", "text/xml; charset=utf-8"), (r"^#!.*\bpython", "text/x-python"), (r"^#!", "text/x-shellscript"))


def by_name(name: Column) -> Column:
    """What the standard list of endings says; null if it has none."""
    known = mimetypes.MimeTypes().types_map[True]
    endings = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
    return F.try_element_at(endings, F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1)))


def sniffed(data: Column, name: Column, regular: Column | None = None) -> Column:
    """data: the first bytes. Known first bytes, then text, then the name's ending; without bytes the name decides."""
    text = data.cast("string")
    is_text = (F.octet_length(data) > 0) & F.is_valid_utf8(text) & ~text.rlike("[\\x00-\\x08\\x0E-\\x1A\\x1C-\\x1F]")
    kind = F.coalesce(F.when(is_text, "text/plain; charset=utf-8"), by_name(name), F.lit(UNKNOWN))
    for pattern, what in reversed(BEGINNINGS):
        kind = F.when(is_text & text.rlike(pattern), what).otherwise(kind)
    hexed = F.hex(F.substring(data, 1, 16))
    for magic, what in reversed(MAGIC):
        kind = F.when(hexed.startswith(magic), what).otherwise(kind)
    return kind if regular is None else F.when(regular, kind).otherwise(NOT_REGULAR)
