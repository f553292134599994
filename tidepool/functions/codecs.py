"""Compression, encryption and fixed-width records of what a store holds."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidepool.functions import batches

#: Names of compressions and the stream codecs that make them.
COMPRESSIONS = {"GZIP": "gzip", "LZ4": "lz4", "ZSTD": "zstd"}

# -- compression -----------------------------------------------------------------------------------------------------


def deflate_bytes(data: bytes | pa.Buffer, algorithm: str = "LZ4") -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, COMPRESSIONS[algorithm]) as out:
        out.write(data)
    return sink.getvalue().to_pybytes()


def inflate_bytes(data: bytes | pa.Buffer, algorithm: str = "LZ4") -> bytes:
    with pa.CompressedInputStream(pa.BufferReader(data), COMPRESSIONS[algorithm]) as raw:
        return raw.read()


def _mapped(one, data: Column, algorithm: str) -> Column:
    if algorithm not in COMPRESSIONS:
        raise ValueError(f"unknown compression: {algorithm}")

    @F.arrow_udf(BinaryType())
    def run(values: pa.Array) -> pa.Array:
        out = pa.array([None if x is None else one(x, algorithm) for x in batches.buffers(values)], values.type)
        batches.trim()
        return out

    batches.bounded()
    return run(data)


def deflated(data: Column, algorithm: str = "LZ4") -> Column:
    """A compressed stream for each value; null for null."""
    return _mapped(deflate_bytes, data, algorithm)


def inflated(data: Column, algorithm: str = "LZ4") -> Column:
    return _mapped(inflate_bytes, data, algorithm)


# -- encryption ------------------------------------------------------------------------------------------------------


def derive_key(passphrase: str, salt: bytes, method: str = "SCRYPT") -> bytes:
    """32 bytes from a passphrase. ARGON2ID needs a library that isn't here."""
    if method == "SCRYPT":
        return hashlib.scrypt(passphrase.encode(), salt=salt, n=1 << 15, r=8, p=1, maxmem=1 << 26, dklen=32)
    if method == "PBKDF2":
        return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, 600_000, 32)
    raise ValueError(f"unsupported key derivation: {method}")


@F.arrow_udf(BinaryType())
def _fresh_key(rows: pa.Array) -> pa.Array:
    return pa.array([os.urandom(32) for _ in range(len(rows))], pa.binary())


_FRESH_KEY = _fresh_key.asNondeterministic()


def encrypted(rows: DataFrame, column: str, key: bytes) -> DataFrame:
    """rows with the column replaced by its AES-GCM form: length of the wrapped key (2 bytes), a key of its own wrapped by
    `key`, and the data under that key. Null stays null."""
    data = F.col(column).cast("binary")
    wrapped = F.aes_encrypt(F.col("_key"), F.lit(key), F.lit("GCM"))
    body = F.aes_encrypt(data, F.col("_key"), F.lit("GCM"))
    keyed = rows.withColumn("_key", _FRESH_KEY(F.lit(0)))
    return keyed.withColumn(column, F.when(F.col(column).isNotNull(), F.concat(F.unhex(F.lpad(F.hex(F.octet_length(wrapped)), 4, "0")), wrapped, body))).drop("_key")


def decrypted(data: Column, key: bytes) -> Column:
    """Null where the key is another or the bytes were changed."""
    size = F.conv(F.hex(F.substring(data, 1, 2)), 16, 10).cast("int")
    own = F.try_aes_decrypt(F.substring(data, F.lit(3), size), F.lit(key), F.lit("GCM"))
    return F.try_aes_decrypt(F.substring(data, size + 3, F.octet_length(data)), own, F.lit("GCM"))


def canary(spark, key: bytes) -> bytes:
    """Random bytes under the key: whoever can decrypt them has the key."""
    return bytes(encrypted(spark.createDataFrame([(os.urandom(32),)], "c binary"), "c", key).first().c)


def opens(spark, sealed: bytes, key: bytes) -> bool:
    return spark.createDataFrame([(sealed,)], "c binary").select(decrypted(F.col("c"), key).isNotNull()).first()[0]


def encoded(rows: DataFrame, column: str, algorithm: str | None = "LZ4", key: bytes | None = None) -> DataFrame:
    """Compressed, then encrypted; each step only if asked."""
    if algorithm:
        rows = rows.withColumn(column, deflated(F.col(column).cast("binary"), algorithm))
    return encrypted(rows, column, key) if key else rows


def decoded(rows: DataFrame, column: str, algorithm: str | None = "LZ4", key: bytes | None = None) -> DataFrame:
    if key:
        rows = rows.withColumn(column, decrypted(F.col(column), key))
    return rows.withColumn(column, inflated(F.col(column), algorithm)) if algorithm else rows


# -- records of fixed width ------------------------------------------------------------------------------------------

#: Fields and their bytes; those of 32 bytes are addresses, the others little-endian numbers. Fixed values.
DELTA = (("type", 1), ("version", 4), ("mac", 32), ("packfile", 32), ("offset", 8), ("length", 4), ("flags", 4))
COLOURED = (("type", 1), ("mac", 32), ("when_ns", 8))
PACKFILE = (("packfile", 32), ("state_id", 32), ("ts_ns", 8))
DELETE = (("kind", 1), ("blob_type", 1), ("blob", 32), ("packfile", 32))
PACK_BLOB = (("type", 4), ("version", 4), ("mac", 32), ("offset", 8), ("length", 4), ("flags", 4))
PACK_FOOTER = (("ts_ns", 8), ("count", 4), ("index_offset", 8), ("index_mac", 32), ("flags", 4))


def width(layout: tuple[tuple[str, int], ...]) -> int:
    return sum(n for _, n in layout)


def little(n: Column, size: int) -> Column:
    """A number's bytes, the lowest first."""
    big = F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))
    return F.concat(*(F.substring(big, i, 1) for i in range(size, 0, -1)))


def number(data: Column, at: Column | int, size: int) -> Column:
    """The number in `size` bytes from place `at`, which counts from 1."""
    at = F.lit(at) if isinstance(at, int) else at
    value = F.lit(0).cast("long")
    for i in range(size):
        value = value.bitwiseOR(F.shiftleft(F.conv(F.hex(F.substring(data, (at + i).cast("int"), F.lit(1))), 16, 10).cast("long"), 8 * i))
    return value


def record(layout: tuple[tuple[str, int], ...]) -> Column:
    """The bytes of a row whose columns are named as in the layout; addresses are hex text."""

    def field(name: str, size: int) -> Column:
        if size == 32:
            return F.unhex(F.col(name))
        return little(F.col(name), size)

    return F.concat(*(field(*x) for x in layout))


def fields(data: Column, layout: tuple[tuple[str, int], ...]) -> list[Column]:
    """The columns of a record; all null if it has another width."""
    out, at = [], 1
    fits = F.octet_length(data) == width(layout)
    for name, size in layout:
        value = F.lower(F.hex(F.substring(data, at, 32))) if size == 32 else number(data, at, size)
        out.append(F.when(fits, value).alias(name))
        at += size
    return out


def setting_record(key: Column, value: Column, created_ns: Column) -> Column:
    """A configuration entry: length and bytes of the key (1) and of the value (2), then its time (8)."""
    name = F.encode(key, "UTF-8")
    return F.concat(little(F.octet_length(name), 1), name, little(F.octet_length(value), 2), value, little(created_ns, 8))


def setting_fields(data: Column) -> list[Column]:
    """key, value and created_ns of a configuration entry; all null if its lengths don't fit."""
    n = number(data, 1, 1)
    m = F.when(F.octet_length(data) >= n + 3, number(data, n + 2, 2))
    fits = F.octet_length(data) == n + m + 11
    part = lambda at, size: F.substring(data, at.cast("int"), size.cast("int"))
    return [F.when(fits, x).alias(name) for x, name in ((part(F.lit(2), n).cast("string"), "key"), (part(n + 4, m), "value"), (number(data, n + m + 4, 8), "created_ns"))]
