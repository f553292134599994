"""Ed25519 signatures of RFC 8032, for the few headers that are signed; not made to resist timing attacks."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

P, Q = 2**255 - 19, 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
Point = tuple[int, int, int, int]


def _sum(a: Point, b: Point) -> Point:
    low, high = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    c, d = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = high - low, d - c, d + c, high + low
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, a: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _sum(out, a)
        a, n = _sum(a, a), n >> 1
    return out


def _x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if x * x % P != square:
        x = x * pow(2, (P - 1) // 4, P) % P
    if x * x % P != square or not x and odd:
        return None
    return x if x & 1 == odd else P - x


_Y = 4 * pow(5, -1, P) % P
_X = _x_of(_Y, 0)
BASE: Point = (_X, _Y, 1, _X * _Y % P)


def _pack(a: Point) -> bytes:
    z = pow(a[2], -1, P)
    x, y = a[0] * z % P, a[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> Point | None:
    n = int.from_bytes(raw, "little")
    y = n & (1 << 255) - 1
    x = _x_of(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _halves(secret: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(secret).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(secret: bytes) -> bytes:
    return _pack(_times(_halves(secret)[0], BASE))


def sign(secret: bytes, message: bytes) -> bytes:
    a, prefix = _halves(secret)
    r = _hash(prefix, message) % Q
    point = _pack(_times(r, BASE))
    return point + ((r + _hash(point, public_key(secret), message) * a) % Q).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= Q:
        return False
    left, right = _times(s, BASE), _sum(r, _times(_hash(signature[:32], public, message) % Q, a))
    return not (left[0] * right[2] - right[0] * left[2]) % P and not (left[1] * right[2] - right[1] * left[2]) % P


@F.pandas_udf(BooleanType())
def _verified(public: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or z is None else verify(bytes(x), bytes(y), bytes(z)) for x, y, z in zip(public, message, signature, strict=True)], dtype=object)


def verified(public: Column, message: Column, signature: Column) -> Column:
    """Whether a signature fits; null for a header that isn't signed."""
    return _verified(public, message, signature)
