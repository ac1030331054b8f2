"""Signed links: HMAC-SHA256 from the built-in hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of a key of at most 64 bytes."""
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex of the HMAC of a text."""
    inner, outer = pads(key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def link_error(expected: Column, given: Column, expires: Column, now: Column) -> Column:
    """A wrong signature is told before an expired link; null if the link is good."""
    return F.when(expected != given, "forbidden").when(expires < now, "expired")
