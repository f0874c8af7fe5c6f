"""Band algebra and scalar features as column expressions.

Divisions by zero give null, as a masked pixel would; *_strict forms raise under
ANSI mode instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnus coefficients, LAI and EVI coefficients, metres per degree of latitude.
MAGNUS_B, MAGNUS_C = 17.625, 243.04
LAI_SLOPE, LAI_SHIFT = 3.618, -0.118
EVI_GAIN, EVI_RED, EVI_BLUE, EVI_SHIFT = 2.5, 6.0, 7.5, 1.0
METRES_PER_DEGREE = 111320.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized_difference(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.try_divide(a - b, a + b)


def ndvi(nir, red) -> Column:
    return normalized_difference(nir, red)


def ndvi_strict(nir, red) -> Column:
    nir, red = _c(nir), _c(red)
    return (nir - red) / (nir + red)


def rvi(vv, vh) -> Column:
    """Radar vegetation index of linear power."""
    vv, vh = _c(vv), _c(vh)
    return F.try_divide(vh * 4, vv + vh)


def rvi_strict(vv, vh) -> Column:
    vv, vh = _c(vv), _c(vh)
    return vh * 4 / (vv + vh)


def ratio(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def dprvi(vv, vh) -> Column:
    """Dual-polarisation index of q = VH / VV clipped to 0..1."""
    q = F.least(F.greatest(ratio(vh, vv), F.lit(0.0)), F.lit(1.0))
    return F.when(ratio(vh, vv).isNotNull(), q * (q + 3) / ((q + 1) * (q + 1)))


def evi(nir, red, blue, scale: float = 1e-4) -> Column:
    n, r, b = (_c(x) * scale for x in (nir, red, blue))
    return F.try_divide((n - r) * EVI_GAIN, n + r * EVI_RED - b * EVI_BLUE + EVI_SHIFT)


def lai(evi_: Column | str) -> Column:
    return _c(evi_) * LAI_SLOPE + LAI_SHIFT


def humidity(temperature, dewpoint) -> Column:
    """Relative humidity (0..1) of degrees Celsius; meant for monthly means, not for single days."""
    t, d = _c(temperature), _c(dewpoint)
    return F.exp(F.try_divide((d - t) * (MAGNUS_B * MAGNUS_C), (t + MAGNUS_C) * (d + MAGNUS_C)))


def wind_speed(u, v) -> Column:
    u, v = _c(u), _c(v)
    return F.sqrt(u * u + v * v)


def scaled(x, factor: float = 1.0, offset: float = 0.0) -> Column:
    return _c(x) * factor + offset


def log_floor(x, floor: float = 1e-4) -> Column:
    """ln(max(x, floor)); null stays null."""
    return F.when(_c(x).isNotNull(), F.log(F.greatest(_c(x), F.lit(floor))))


def log_shift(x, shift: float = 0.01) -> Column:
    """ln(x + shift); null where that is not positive."""
    return F.when(_c(x) + shift > 0, F.log(_c(x) + shift))


def squared(x) -> Column:
    return _c(x) * _c(x)


def plot_key(lon, lat, digits: int = 3) -> Column:
    """lon_lat, both rounded half to even, in their shortest form."""
    text = lambda x: F.bround(_c(x).cast("double"), digits).cast("string")
    return F.concat_ws("_", text(lon), text(lat))


def period(year, month) -> Column:
    """YYYY-MM."""
    return F.format_string("%d-%02d", _c(year).cast("int"), _c(month).cast("int"))


def hectares_to_metres2(x) -> Column:
    return _c(x) * 10000


def circle_radius(area) -> Column:
    return F.sqrt(_c(area) / F.pi())


def square_side(area) -> Column:
    return F.sqrt(_c(area))


def degrees_north(metres) -> Column:
    return _c(metres) / METRES_PER_DEGREE


def degrees_east(metres, lat) -> Column:
    return F.try_divide(_c(metres), F.cos(F.radians(_c(lat))) * METRES_PER_DEGREE)


def bbox_around(lon, lat, half_side) -> Column:
    """Box of west, south, east, north at half_side metres about a point."""
    lon, lat = _c(lon), _c(lat)
    dx, dy = degrees_east(half_side, lat), degrees_north(half_side)
    return F.struct((lon - dx).alias("west"), (lat - dy).alias("south"), (lon + dx).alias("east"), (lat + dy).alias("north"))
