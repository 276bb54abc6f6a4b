"""HMAC-SHA256 as a column expression."""

import hashlib

from pyspark.sql import Column, functions as F

_BLOCK = 64


def _pads(secret: bytes) -> tuple[bytes, bytes]:
    key = hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(secret: str, body: Column) -> Column:
    """Hex HMAC of the body. Only the two pads, not the secret, enter the plan."""
    inner, outer = _pads(secret.encode())
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), body.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def expected_signature(secret: str, body: Column) -> Column:
    return F.concat(F.lit("sha256="), hmac_sha256(secret, body))
