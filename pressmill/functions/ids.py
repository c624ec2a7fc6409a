"""Deterministic ids and keys as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

#: Namespace of URLs for name-based ids (RFC 4122), as hexadecimal digits.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID of version 5; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    byte = F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), F.lower(F.hex(byte)), F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def article_id(given: Column | None, url: Column) -> Column:
    """The given id, or the UUID of the article's URL."""
    own = uuid5(url)
    return own if given is None else F.coalesce(F.nullif(given, F.lit("")), own)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(text: Column, method: str = "md5", secret: str | None = None) -> Column:
    """Key of a URL in the seen set: md5 (also for unknown methods), sha1, sha256, or hmac-sha256 with a secret."""
    if method == "sha1":
        return F.sha1(text)
    if method == "sha256":
        return F.sha2(text, 256)
    if method in ("hmac", "hmac-sha256"):
        if not secret:
            raise ValueError("hmac-sha256 needs a secret")
        return hmac_sha256(text, secret)
    return F.md5(text)


def hmac_sha256(text: Column, secret: str) -> Column:
    """HMAC with SHA-256: two nested digests over padded keys, without leaving the JVM."""
    key = secret.encode("utf-8")
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key).hex() for x in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer)), digest), 256)
