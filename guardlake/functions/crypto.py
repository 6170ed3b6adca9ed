"""Keyed digests from built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(text: Column, key: str) -> Column:
    """RFC 2104 HMAC: sha256(opad ++ sha256(ipad ++ text)), hex."""
    raw = key.encode("utf-8")
    raw = hashlib.sha256(raw).digest() if len(raw) > _BLOCK else raw
    raw = raw.ljust(_BLOCK, b"\x00")
    inner = F.lit(bytearray(b ^ 0x36 for b in raw))
    outer = F.lit(bytearray(b ^ 0x5C for b in raw))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
