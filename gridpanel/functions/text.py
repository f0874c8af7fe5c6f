"""Text functions: names, keys, signatures and the detector of secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .indices import _c

# What a secret looks like, the first match names it.
SECRETS = (
    ("private key", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----"),
    ("Google API key", r"AIza[0-9A-Za-z_-]{20,}"),
    ("OpenAI-style key", r"sk-[0-9A-Za-z]{20,}"),
    ("assigned API token", r"(?i)(?:api[_-]?key|access[_-]?token|client[_-]?secret)\s*=\s*['\"][^'\"]{12,}['\"]"),
)
# Satellite codes, country labels, and the grammar of tile names.
SATELLITES = {"T": "Terra", "A": "Aqua", "Terra": "Terra", "Aqua": "Aqua"}
COUNTRIES = {"MMR": "MYM"}
TILE = r"^[NS]\d{2}[EW]\d{3}_[01]_[01]$"


def secret_kind(text) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECRETS):
        out = F.when(_c(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def mapped(value, names: dict[str, str], keep: bool = False) -> Column:
    """The value's name; unknown values are null, or stay if keep."""
    out = _c(value) if keep else F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(_c(value) == k, F.lit(v)).otherwise(out)
    return out


def safe_filename(text) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")


def split_camel(text) -> Column:
    return F.regexp_replace(_c(text), r"([a-z])([A-Z])", "$1 $2")


def column_name(name: str) -> str:
    return name.strip().replace("-", "_").replace(".", "_")


def signature(columns: list[str]) -> Column:
    """SHA-256 of the compact JSON array of the fields as text, null as the empty string."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 256)


def is_tile(name) -> Column:
    return _c(name).rlike(TILE)


def tile_bounds(name) -> Column:
    """west, south, east, north of a half-degree part of the one-degree tile named by its south-west corner; part x counts east, part y south."""
    n = _c(name)
    lat = F.substring(n, 2, 2).try_cast("double") * F.when(n.startswith("S"), -1.0).otherwise(1.0)
    lon = F.substring(n, 5, 3).try_cast("double") * F.when(F.substring(n, 4, 1) == "W", -1.0).otherwise(1.0)
    west = lon + F.substring(n, 9, 1).try_cast("double") * 0.5
    south = lat + F.when(F.substring(n, 11, 1) == "0", 0.5).otherwise(0.0)
    return F.when(is_tile(n), F.struct(west.alias("west"), south.alias("south"), (west + 0.5).alias("east"), (south + 0.5).alias("north")))


def bounds_ok(west, south, east, north) -> Column:
    w, s, e, n = (_c(x) for x in (west, south, east, north))
    return F.coalesce((w < e) & (s < n) & w.between(-180, 180) & e.between(-180, 180) & s.between(-90, 90) & n.between(-90, 90), F.lit(False))
