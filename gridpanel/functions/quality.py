"""Quality bits, masks and cleaning as column expressions. A masked value is null; NaN never reaches an aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indices import _c

# Class codes, bit positions and sentinels of the products.
RICE, ACTIVE_CROP = 3, 100
CLOUD_BITS = 3072
LIT_SATURATED, LAND_LIMIT, LIT_SCALE = 65535, 150, 0.1
NODATA = -9999


def bits(value, first: int, last: int) -> Column:
    """The bits first..last, inclusive, as a number."""
    if not 0 <= first <= last <= 30:
        raise ValueError(f"no such range of bits: {first}..{last}")
    return F.shiftright(_c(value), first).bitwiseAND((1 << (last - first + 1)) - 1)


def aqua_ok(qc) -> Column:
    """Retrieval not failed and the Aqua bit set."""
    return (bits(qc, 5, 7) != 4) & (bits(qc, 1, 1) == 1)


def terra_ok(qc) -> Column:
    return (bits(qc, 5, 7) != 4) & (bits(qc, 1, 1) == 0)


def fire_ok(fire_mask, qa) -> Column:
    """A detection of at least low confidence on a pixel with usable quality."""
    return (bits(fire_mask, 0, 3) >= 7) & (bits(qa, 0, 1) <= 2)


def cloud_free(qa60) -> Column:
    """Neither opaque clouds (bit 10) nor cirrus (bit 11)."""
    return _c(qa60).bitwiseAND(CLOUD_BITS) == 0


def masked(value, keep: Column) -> Column:
    return F.when(keep, _c(value))


def within(value, low: float | None = None, high: float | None = None) -> Column:
    """The value where it lies in low..high, else null."""
    v = _c(value)
    tests = [t for t in (None if low is None else v >= low, None if high is None else v <= high) if t is not None]
    return F.when(reduce(lambda a, b: a & b, tests), v) if tests else v


def finite(value, nodata: float | None = NODATA) -> Column:
    """Null for NaN, infinities and the no-data value."""
    v = _c(value).cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(~(bad | (v == nodata)) if nodata is not None else ~bad, v)


def class_is(value, code: int) -> Column:
    return _c(value) == code


def night_light(raw, quality, land, lit) -> Column:
    """One cleaned radiance: negative and missing are 0; saturated, poor or water null; scaled; unlit 0, which is decided last.

    NaN counts as missing; a missing land code as water.
    """
    value = finite(raw, None)
    value = F.when(value >= 0, value).otherwise(0.0)
    value = F.when((value >= LIT_SATURATED) | (_c(quality) == 1) | ~F.coalesce(finite(land, None) <= LAND_LIMIT, F.lit(False)), None).otherwise(value)
    return F.when(_c(lit) == 0, 0.0).otherwise(value * LIT_SCALE)


def all_valid(df: DataFrame, bands: list[str]) -> DataFrame:
    """Rows of which every band is there."""
    return df.dropna("any", subset=bands)
