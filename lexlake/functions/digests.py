"""Checksums, digests and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST_VERSION = "bcs1"  # fixed value


def checksum(*columns) -> Column:
    """sha256 of the fields joined by |; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def snapshot_id(digest: Column) -> Column:
    """Version and 16 hex digits of a canonical text."""
    return F.concat(F.lit(f"{DIGEST_VERSION}_"), F.substring(F.sha2(digest, 256), 1, 16))


def canonical(fields: dict[str, Column]) -> Column:
    """JSON of the fields in name order, nulls written."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def weak_tag(key: str, changed: str) -> Column:
    return F.concat(F.lit('W/"'), F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col(changed).cast("string")), 256), 1, 32), F.lit('"'))


def percentage(part: Column, whole: Column) -> Column:
    """To one place, half to even; null of nothing."""
    return F.bround(100.0 * part / F.nullif(whole, F.lit(0)), 1)


def signature(body: str, time: str, secret: bytes) -> Column:
    """Hex HMAC-SHA256 of "time.body", block by block: two nested hashes of padded keys, as the standard defines it."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    message = F.concat_ws(".", F.col(time).cast("string"), F.col(body)).cast("binary")
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)
