"""Keyed determinism: HMAC-SHA256 and digits drawn from it, as Column expressions.

The secret becomes two literals of the plan; keep plans and mappings as private as the secret itself.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(secret: str) -> tuple[str, str]:
    """The inner and the outer key block, in hex."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_hex(secret: str, message: Column) -> Column:
    inner, outer = padded(secret)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def byte_at(digest: Column, i: int | Column) -> Column:
    """The i-th byte of a hex digest, 0 to 255."""
    start = F.lit(2 * i + 1) if isinstance(i, int) else 2 * i + 1
    return F.conv(F.substring(digest, start, F.lit(2)), 16, 10).cast("int")


def number(digest: Column, i: int, n_bytes: int = 4) -> Column:
    """Bytes i .. as one number."""
    return F.conv(F.substring(digest, 2 * i + 1, 2 * n_bytes), 16, 10).cast("long")


def digits(digest: Column, i: int, n: int) -> Column:
    """n decimal digits out of the bytes from the i-th."""
    return F.array_join(F.transform(F.sequence(F.lit(i), F.lit(i + n - 1)), lambda k: (byte_at(digest, k) % 10).cast("string")), "")
