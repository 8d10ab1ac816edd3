"""Keyed hashes, fingerprints and cache keys from built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: str, value: Column) -> Column:
    """HMAC-SHA256 as lower-case hex. The pads are made on the driver."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in raw).hex())) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the values joined by |; null is written out, so it differs from an empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("<null>")) for c in columns]), 256)


def cache_key(prefix: str, **fields: Column) -> Column:
    """The key of equal requests: SHA-256 of the fields as JSON in order of their names."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256))
