"""Signatures and keys of webhook requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def hmac_sha256(secret: bytes, body: Column) -> Column:
    """Lower-case hex of the keyed digest of body, from two digests over padded keys."""
    import hashlib

    key = hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret
    key = key.ljust(_BLOCK, b"\0")
    pad = lambda value: F.unhex(F.lit(bytes(k ^ value for k in key).hex()))
    inner = F.sha2(F.concat(pad(0x36), body.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def signed(secret: bytes, key: str, body: Column, given_key: Column, signature: Column) -> Column:
    """Whether the api key is the expected one and the signature, bare or after sha256=, fits body."""
    bare = F.lower(F.regexp_replace(F.trim(signature), "^sha256=", ""))
    return F.coalesce((given_key == key) & (bare == hmac_sha256(secret, body)), F.lit(False))


def client(api_key: Column, address: Column) -> Column:
    """Whose bucket a request draws on: its key's, or its address's if it has none."""
    return F.coalesce(F.concat(F.lit("key:"), F.nullif(F.trim(api_key), F.lit(""))), F.concat(F.lit("ip:"), address))
