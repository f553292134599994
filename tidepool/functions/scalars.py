"""Scalar expressions of the snapshot model."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def mac(data: Column) -> Column:
    """Content address: SHA-256, lower-case hex."""
    return F.sha2(data, 256)


def is_mac(hex_text: Column) -> Column:
    return hex_text.rlike("^[0-9a-f]{64}$")


def mac_parse(hex_text: Column) -> Column:
    """The 32 bytes of an address; null for anything else."""
    return F.when(hex_text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(hex_text))


def mac_format(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def random_mac() -> Column:
    return F.sha2(F.concat(F.uuid(), F.uuid()), 256)


#: Names of hashes that stores may have, and the hash that stands for each; fixed values. No BLAKE3 here: SHA-256 stands in.
HASHES = {"SHA256": 256, "BLAKE3": 256}


def hashed(data: Column, name: str = "BLAKE3") -> Column:
    """The address under a hash by name; null for names that no store has."""
    return F.sha2(data, HASHES[name]) if name in HASHES else F.lit(None).cast("string")


def version_pack(major: Column, minor: Column, patch: Column) -> Column:
    return F.shiftleft(major, 16).bitwiseOR(F.shiftleft(minor, 8)).bitwiseOR(patch)


def version_format(version: Column) -> Column:
    return F.format_string("%d.%d.%d", F.shiftright(version, 16), F.shiftright(version, 8).bitwiseAND(255), version.bitwiseAND(255))


def version_readable(version: Column, current: Column) -> Column:
    return version <= current


#: Bits of file modes and the kinds that they stand for; fixed values.
MODE_DIRECTORY, MODE_SYMLINK, MODE_DEVICE, MODE_PIPE, MODE_SOCKET, MODE_SETUID, MODE_SETGID, MODE_STICKY = (1 << n for n in (31, 27, 26, 25, 24, 23, 22, 20))


def has_mode(mode: Column, bit: int) -> Column:
    return mode.bitwiseAND(F.lit(bit)) != 0


def file_kind(mode: Column) -> Column:
    kinds = {"directory": MODE_DIRECTORY, "symlink": MODE_SYMLINK, "device": MODE_DEVICE, "pipe": MODE_PIPE, "socket": MODE_SOCKET}
    out = F.lit("regular")
    for name, bit in reversed(kinds.items()):
        out = F.when(has_mode(mode, bit), name).otherwise(out)
    return out


def mime_major(content_type: Column) -> Column:
    return F.substring_index(content_type, "/", 1)


def mime_bare(content_type: Column) -> Column:
    return F.trim(F.substring_index(content_type, ";", 1))


def content_type_key(content_type: Column, path: Column) -> Column:
    return F.concat(F.lit("/"), content_type, path)


def xattr_key(path: Column, name: Column, kind: Column) -> Column:
    """path, name and a mark for extended (1), alternate stream (2), descriptor (3) or custom (4) attributes."""
    return F.concat(path, name, F.when(kind == 1, ":").when(kind == 2, "@").when(kind == 3, "%").otherwise("#"))


def human_size(n: Column) -> Column:
    """Binary units, two significant digits below ten."""
    out = F.format_string("%d B", n.cast("bigint"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), 1):
        x = F.floor(n / float(1024**power) * 10 + 0.5) / 10
        out = F.when(n >= 1024**power, F.when(x < 10, F.concat(F.format_number(x, "0.0"), F.lit(f" {unit}"))).otherwise(F.concat(F.format_number(x, "0"), F.lit(f" {unit}")))).otherwise(out)
    return out


def location_protocol(location: Column, fallback: str = "fs") -> Column:
    found = F.regexp_extract(location, r"^([A-Za-z][A-Za-z0-9+.-]+):(?://)?", 1)
    return F.when(found == "", fallback).otherwise(found)


def location_rest(location: Column) -> Column:
    return F.regexp_replace(location, r"^[A-Za-z][A-Za-z0-9+.-]+:(?://)?", "")


def snapshot_prefix(path: Column) -> Column:
    """What is before the colon of `prefix:path`; empty for an absolute path."""
    return F.when(path.startswith("/"), "").otherwise(F.split(path, ":", 2)[0])


def snapshot_path(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.coalesce(F.get(F.split(path, ":", 2), F.lit(1)), F.lit("")))


def hmac_sha256_hex(key: bytes, data: Column) -> Column:
    """Keyed address, from two plain hashes."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), data), 256))), 256)


_UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "sec": 1, "second": 1, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800, "m": 2592000, "month": 2592000, "y": 31536000, "year": 31536000, "min": 60, "minute": 60}


def parse_time_flag(text: str, now: datetime) -> datetime | None:
    """A time from a command line: RFC 3339, a date with or without time, or a duration before now ("1m": a month)."""
    if not text:
        return None
    if text != text.strip():
        raise ValueError(f"invalid time: {text!r}")
    if m := re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)([.,]\d+)?(Z|[+-]\d\d:\d\d)", text):
        at = datetime.strptime(m[1] + m[3].replace("Z", "+00:00"), "%Y-%m-%dT%H:%M:%S%z")
        return (at + timedelta(seconds=float((m[2] or "").replace(",", ".") or 0))).astimezone(timezone.utc)
    for digits, form in ((r"\d{4}-\d\d-\d\d \d\d:\d\d", "%Y-%m-%d %H:%M"), (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", "%Y-%m-%d %H:%M:%S"), (r"\d{4}-\d\d-\d\d", "%Y-%m-%d"), (r"\d{4}/\d\d/\d\d", "%Y/%m/%d")):
        if re.fullmatch(digits, text):
            return datetime.strptime(text, form).replace(tzinfo=timezone.utc)
    total, at = 0.0, 0
    for m in re.finditer(r"(\d+(?:\.\d+)?)\s*([a-z]+?)s?(?=\d|\s|$)", text):
        unit = m[2] if m[2] in _UNITS else m[2] + "s"
        if m.start() != at or unit not in _UNITS:
            raise ValueError(f"invalid time: {text!r}")
        total, at = total + float(m[1]) * _UNITS[unit], m.end()
    if at != len(text):
        raise ValueError(f"invalid time: {text!r}")
    return now - timedelta(seconds=total)

#: Resource types and their names; fixed values.
RESOURCES = {1: "config", 2: "lock", 3: "state", 4: "packfile", 5: "snapshot", 6: "signature", 7: "object", 9: "chunk", 10: "vfs-btree", 11: "vfs-node", 12: "vfs-entry", 13: "error-btree", 14: "error-node", 15: "error-entry", 16: "xattr-btree", 17: "xattr-node", 18: "xattr-entry", 19: "btree-root", 20: "btree-node", 21: "vfs-summary", 255: "random"}


def resource_name(kind: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in RESOURCES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, kind), F.lit("unknown"))
