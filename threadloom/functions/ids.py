"""Digests and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """JSON with keys in order and nulls kept; give nested structs their fields in order too."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def short_id(prefix: str, c: Column, most: int = 16) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(c, 256), 1, most))


def fnv1a32(c: Column) -> Column:
    """FNV-1a over UTF-8 bytes, unsigned 32 bit."""
    codes = F.filter(F.split(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "$1,"), ","), lambda x: x != "")
    step = lambda h, x: (h.bitwiseXOR(F.conv(x, 16, 10).cast("long")) * 16777619) % 4294967296
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)
