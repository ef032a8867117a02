"""Content hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def newline_variants(text: Column) -> dict[str, Column]:
    """SHA-256 of a text as it is, with LF and with CRLF line ends."""
    lf = F.regexp_replace(text, "\r\n?", "\n")
    return {"raw": sha256_text(text), "lf": sha256_text(lf), "crlf": sha256_text(F.regexp_replace(lf, "\n", "\r\n"))}


def hash_of_members(member: Column) -> Column:
    """Aggregate: SHA-256 over the distinct members, sorted, one to a line."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(member)), "\n"), 256)


def stable_order(policy: str, seed: int, *names: Column) -> Column:
    """A hash that orders names, the same on every run; the parts are joined by NUL."""
    return F.sha2(F.concat_ws("\0", F.lit(policy), F.lit(str(seed)), *names), 256)


def hash_of_json(record: Column, newline: bool = True) -> Column:
    """SHA-256 of a struct as JSON with fields in the order given (callers name them alphabetically), nulls included."""
    text = F.to_json(record, {"ignoreNullFields": "false"})
    return F.sha2(F.concat(text, F.lit("\n")) if newline else text, 256)


def hash64(hex_digest: Column) -> Column:
    """A 64-bit hash of 16 hex digits as a signed integer."""
    return F.conv(hex_digest, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
